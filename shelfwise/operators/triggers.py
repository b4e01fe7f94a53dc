"""Trigger words of a table, found in one pass over each text.

``functions.text.aspect_opinions`` takes a small dictionary and tests every trigger in every sentence. Here the triggers are
a table of any number of rows ``(category, aspect, trigger)``. Each task builds one Aho-Corasick automaton from it, with
the categories and aspects of a trigger as the automaton's values, and reads a text once, however many triggers there are.
A text's own category decides which of the values met count. The table is cut into parts whose measured size fits a
task; a text is read once for each part.

A sentence mentions an aspect when its lower-cased text contains one of the aspect's triggers, anywhere, also inside a
word. Null or empty triggers never match; a null category, of a text or of a trigger, matches nothing; repeated triggers
count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyarrow.compute import list_value_length
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.rounding import round_exact
from shelfwise.functions.text import Lexicon, bind, mean_of, sentences, sentiment
from shelfwise.operators.blocks import measure, text_slices
from shelfwise.sources.shared import MAX_BROADCAST_BYTES

#: Stands between the sentences of a text; where a text or a trigger holds it, ``INSTEAD`` does.
BREAK, INSTEAD = "\uffff", "\ufffe"
#: Sentences read at a time; each comes out once for every aspect that it mentions.
READ_SENTENCES = 8_192
#: An automaton takes some times the bytes of its triggers.
PART_BYTES = MAX_BROADCAST_BYTES // 8


class Automaton:
    """Triggers with the places of their categories and aspects; a trigger of several ones has several."""

    def __init__(self, table: pa.Table):
        held: dict[str, dict[str, set[str]]] = {}
        for category, aspect, trigger in zip(*(table[c].to_pylist() for c in ("category", "aspect", "trigger")), strict=True):
            held.setdefault(trigger, {}).setdefault(category, set()).add(aspect)
        self.machine = ahocorasick.Automaton()
        for trigger, values in held.items():
            self.machine.add_word(trigger, values)
        self.empty = not held
        if held:
            self.machine.make_automaton()

    def mentions(self, category: str, texts: list[str]) -> list[tuple[int, str]]:
        """Number of the sentence and aspect of every mention, each pair once, in order."""
        if self.empty:
            return []
        ends, at = [], -1
        for text in texts:
            at += len(text) + 1
            ends.append(at)
        found: set[tuple[int, str]] = set()
        sentence = 0
        for end, values in self.machine.iter(BREAK.join(texts)):
            while end > ends[sentence]:
                sentence += 1
            found.update((sentence, aspect) for aspect in values.get(category, ()))
        return sorted(found)


def _read(automaton: Automaton, batch: pa.RecordBatch, most: int = READ_SENTENCES) -> Iterator[pa.RecordBatch]:
    """Mentions of the texts of a batch, a few texts at a time: a sentence comes out once for each of its aspects."""
    for part in text_slices(list_value_length(batch.column("lowered")).to_pylist(), most):
        few = batch.slice(part.start, part.stop - part.start)
        rows, numbers, aspects = [], [], []
        categories, lowered = few.column("category").to_pylist(), few.column("lowered")
        for i, category in enumerate(categories):
            for number, aspect in automaton.mentions(category, lowered[i].as_py()):
                rows.append(i)
                numbers.append(number)
                aspects.append(aspect)
        lists, places = few.column("parts"), pa.array(rows, pa.int64())
        starts = lists.offsets.take(places).to_numpy() - lists.offsets[0].as_py() if rows else []
        content = lists.flatten().take(pa.array([s + n for s, n in zip(starts, numbers, strict=True)], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [few.column("id").take(places), pa.array(numbers, pa.int32()), pa.array(aspects, pa.string()), content],
            ["id", "sentence", "aspect", "content"],
        )


def _parts(triggers: DataFrame, part_bytes: int) -> list[pa.Table]:
    """The usable triggers in parts that fit a task, by a measurement of their size."""
    usable = triggers.select("category", "aspect", F.translate(F.lower("trigger"), BREAK, INSTEAD).alias("trigger"))
    usable = usable.filter(F.col("category").isNotNull() & F.col("aspect").isNotNull() & (F.col("trigger") != "")).distinct()
    parts = max(1, -(-measure(usable)[1] // part_bytes))
    return [usable.filter(F.pmod(F.xxhash64("trigger"), F.lit(parts)) == i).toArrow() for i in range(parts)]


def mentions(texts: DataFrame, triggers: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``id, sentence, aspect, content`` of every sentence of ``texts(id, category, body)`` that mentions an aspect.

    ``sentence`` counts from 0 among the sentences that are not blank; ``content`` is the sentence.
    """
    id_type = dict(texts.dtypes)["id"]
    cut = texts.select("id", "category", sentences(F.col("body")).alias("parts")).filter(F.size("parts") > 0)
    cut = cut.select("id", "category", "parts", F.transform("parts", lambda s: F.translate(F.lower(s), BREAK, INSTEAD)).alias("lowered"))

    def found(table: pa.Table) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(table)
            for batch in batches:
                yield from _read(automaton, batch)

        return cut.mapInArrow(run, f"id {id_type}, sentence int, aspect string, content string")

    parts = [found(table) for table in _parts(triggers, part_bytes)]
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).distinct()


def aspect_scores(texts: DataFrame, triggers: DataFrame, lexicon: Lexicon = Lexicon(), digits: int | None = 3, part_bytes: int = PART_BYTES) -> DataFrame:
    """``id, aspect, score, mentions``: mean sentiment of the sentences that mention the aspect, and their number.

    The sentences' scores are added up in their order. Ids are distinct in ``texts``.
    """
    scored = mentions(texts, triggers, part_bytes).select("id", "aspect", F.struct("sentence", sentiment(F.col("content"), lexicon).alias("score")).alias("one"))

    def mean(ones: Column) -> Column:
        return bind(F.transform(ones, lambda o: o["score"]), mean_of)

    # one entry for each sentence of one text
    gathered = scored.groupBy("id", "aspect").agg(F.sort_array(F.collect_list("one")).alias("ones"))
    return gathered.select("id", "aspect", round_exact(mean(F.col("ones")), digits).alias("score"), F.size("ones").alias("mentions"))
