"""Collocations of two and three words, from suffix subtrees built group by group.

The corpus is one string of words, cut where a piece ends; every word starts a suffix of at most three words. The
tree of those suffixes is partitioned vertically, as ERA does for strings larger than memory:

1. **Codes.** Texts become chunks of word codes, one language each, with a list of the chunk's distinct words and their
   counts. Those counts add up to the frequency of every word.
2. **Groups of prefixes.** A word that occurs fewer than ``least`` times can't stand in a phrase that counts, so it ends
   suffixes as a piece does. Other words are prefixes; consecutive ones share a group until its suffixes reach
   ``budget``. A prefix beyond the budget is extended: by its second word, dealt over as many groups as the budget
   asks for, and where that word is beyond the budget too, by its third. So a group's suffixes fit a task's memory
   however often one word, or one pair, occurs.
3. **Suffixes.** Each chunk sorts its suffixes once and sends equal ones as one leaf with a count, packed by group.
4. **Subtrees.** A task sorts the leaves of a group, adds up equal ones, and reads the counts of the inner nodes from the
   leaf totals below them. Only a prefix extended to its third word has its pair in several groups; those totals are
   added afterwards.

A phrase of words w is cut where its score ``a*a/(l*r)`` is least; products are exact decimals.

Defined results: a null or empty text has no words; a null language is ``und``; equal rows count as often as they
occur; rows without ``doc_id`` count like others; an empty table gives no rows; further columns are ignored. Ties of
score and count go by the phrase's UTF-8 bytes; of cuts with one score the earliest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.wordcodes import FIRST_WORD, PIECE_CODE, TEXT_CODE, fold_table, word_codes
from shelfwise.sources.shared import broadcast_if_small, shared_folder, write_shared

UNKNOWN = "und"
LEAST, SHARE, LIMIT = 10, 50, 2_000
#: Suffixes in a group, words in a chunk, and bytes of text encoded at a time.
BUDGET, CHUNK_WORDS, STEP_BYTES = 2_000_000, 3_000_000, 4_000_000
SCALE = 1_000_000

_TABLE = fold_table(b" \t", b".,;:!?\n\x0b\x0c\r")
_CODED = "chunk long, lang string, codes binary, code int, word binary, n long"
_CODED_ARROW = pa.schema(
    [("chunk", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("code", pa.int32()), ("word", pa.binary()), ("n", pa.int64())]
)
_BLOCKS = "partial boolean, group long, block binary"
_BLOCKS_ARROW = pa.schema([("partial", pa.bool_()), ("group", pa.int64()), ("block", pa.binary())])
_NODES = "w1 long, w2 long, w3 long, a long, partial boolean"
_NODES_ARROW = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("w3", pa.int64()), ("a", pa.int64()), ("partial", pa.bool_())])
_LEAF = np.dtype([("w1", "<u4"), ("w2", "<u4"), ("w3", "<u4"), ("n", "<u4")])


class _Chunk:
    """Word codes of one language, with the words that they stand for."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, codes: np.ndarray, words: pa.Array) -> None:
        own = np.empty(len(words) + FIRST_WORD, np.int32)
        own[PIECE_CODE] = own[TEXT_CODE] = 0  # one mark is enough: both end a suffix
        for i, word in enumerate(words.to_pylist(), FIRST_WORD):
            own[i] = self.place.setdefault(word, len(self.place) + 1)
        self.parts.append(own[codes])
        self.words += len(codes)

    def rows(self, number: int, lang: str) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(self.parts)
        counts = np.bincount(codes, minlength=len(self.place) + 1)[1:]
        n = len(self.place)
        none = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([lang]), pa.array([codes.tobytes()]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())],
            schema=_CODED_ARROW,
        )
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(number, n), pa.repeat(lang, n), none, pa.array(range(1, n + 1), pa.int32()), pa.array(list(self.place), pa.binary()), pa.array(counts, pa.int64())],
            schema=_CODED_ARROW,
        )


def code_words(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Chunks of ``docs(lang, text)`` as rows with ``codes``, and their distinct words as rows with ``word``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Chunk] = {}
        task, made = TaskContext.get().partitionId(), 0

        def flush(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang in langs:
                chunk = held.pop(lang)
                if chunk.place:
                    yield from chunk.rows((task << 32) + made, lang)
                    made += 1

        for batch in batches:
            waiting: dict[str, list[bytes]] = {}
            size: dict[str, int] = {}
            last = batch.num_rows - 1
            langs = batch.column("lang").to_pylist()
            for i, lang in enumerate(langs):
                text = batch.column("text")[i].as_py()
                if text:
                    waiting.setdefault(lang, []).append(text.encode())
                    size[lang] = size.get(lang, 0) + len(text)
                for due in list(waiting) if i == last else [lang] if size.get(lang, 0) >= STEP_BYTES else []:
                    held.setdefault(due, _Chunk()).add(*word_codes(waiting.pop(due), _TABLE))
                    size[due] = 0
                    if held[due].words >= chunk_words:
                        yield from flush([due])
        yield from flush(list(held))

    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").mapInArrow(run, _CODED)


def _groups(counted: DataFrame, budget: int) -> DataFrame:
    """Numbers and groups of ``counted(lang, word, f)``: ``group`` of a whole prefix, ``pieces`` of one beyond the budget."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        number, group, room = 0, 0, budget
        for frame in frames:
            groups = np.empty(len(frame), np.int64)
            for i, f in enumerate(frame["f"].tolist()):
                if f <= budget:
                    if f > room:
                        group, room = group + 1, budget
                    room -= f
                groups[i] = group
            pieces = np.where(frame["f"] > budget, -(-frame["f"] // budget), 0)
            places = np.arange(number, number + len(frame))
            number += len(frame)
            yield frame.assign(part=task, place=places, group=(task << 32) + groups, pieces=pieces)

    return counted.mapInPandas(run, "lang string, word binary, f long, part int, place long, group long, pieces long")


def _numbered(grouped: DataFrame) -> DataFrame:
    """A number for each frequent word, from 1 and without gaps, by the counts of the table's parts."""
    counts = grouped.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))  # a row for each task that wrote
    return grouped.join(F.broadcast(starts), "part").select(
        (F.col("start") + F.col("place") + 1).alias("id"), "lang", "word", "f", "group", "pieces"
    )


def _mix(*words: np.ndarray) -> np.ndarray:
    """A hash of columns of numbers, spread over 63 bits."""
    with np.errstate(over="ignore"):
        out = np.uint64(0x9E3779B97F4A7C15)
        for column in words:
            out = (out ^ column.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
    return out >> np.uint64(1)


def _sum_equal(leaves: np.ndarray) -> np.ndarray:
    """Leaves in the order of their words, equal ones added up."""
    pair = leaves["w1"].astype(np.uint64) << np.uint64(32) | leaves["w2"]
    order = np.lexsort((leaves["w3"], pair))
    pair, third = pair[order], leaves["w3"][order]
    first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])])
    out = np.empty(len(first), [("w1", "<u4"), ("w2", "<u4"), ("w3", "<u4"), ("n", "<i8")])
    out["w1"], out["w2"], out["w3"] = pair[first] >> np.uint64(32), pair[first] & np.uint64(0xFFFFFFFF), third[first]
    out["n"] = np.add.reduceat(leaves["n"][order].astype(np.int64), first)
    return out


def _chunk_leaves(coded: pa.Table, words: pa.Table) -> pa.Table:
    """The suffixes of a chunk as packed leaves by group; ``words`` are its frequent words."""
    if not coded.num_rows or not words.num_rows:
        return _BLOCKS_ARROW.empty_table()
    codes = np.frombuffer(coded["codes"][0].as_py(), np.int32)
    code = words["code"].to_numpy()
    size = max(int(codes.max()), int(code.max())) + 1
    ids, group, pieces = np.zeros(size, np.uint32), np.zeros(size, np.int64), np.zeros(size, np.int64)
    ids[code], group[code], pieces[code] = words["id"].to_numpy(), words["group"].to_numpy(), words["pieces"].to_numpy()
    string = np.concatenate([ids[codes], np.zeros(2, np.uint32)])
    code_of = np.zeros(len(string), np.int32)
    code_of[: len(codes)] = codes
    at = np.flatnonzero(string[:-2])
    leaves = np.empty(len(at), _LEAF)
    leaves["w1"], leaves["w2"], leaves["n"] = string[at], string[at + 1], 1
    leaves["w3"] = np.where(leaves["w2"] > 0, string[at + 2], 0)
    merged = _sum_equal(leaves)

    # words of a merged leaf by their number: the chunk's groups and pieces
    known = np.argsort(ids[code])
    held = ids[code][known]

    def of(values: np.ndarray, word: np.ndarray) -> np.ndarray:
        place = np.searchsorted(held, word).clip(max=len(held) - 1)
        return np.where(word > 0, values[code][known][place], 0)

    parts = of(pieces, merged["w1"])
    target = of(group, merged["w1"])
    partial = np.zeros(len(merged), bool)
    large = np.flatnonzero(parts > 0)
    if len(large):
        w1, w2, w3, k = merged["w1"][large], merged["w2"][large], merged["w3"][large], parts[large].astype(np.uint64)
        third = of(pieces, w2) > 0
        deal = np.where(third, _mix(w2, w3), _mix(w2)) % k
        target[large] = -1 - (_mix(w1, deal) >> np.uint64(1)).astype(np.int64)
        partial[large] = third
    key = np.lexsort((target, partial))
    merged, target, partial = merged[key], target[key], partial[key]
    first = np.flatnonzero(np.r_[True, (target[1:] != target[:-1]) | (partial[1:] != partial[:-1])]) if len(key) else np.zeros(0, int)
    packed = merged.astype(_LEAF)
    blocks = [packed[a:b].tobytes() for a, b in zip(first, [*first[1:], len(key)], strict=True)]
    return pa.table([pa.array(partial[first]), pa.array(target[first]), pa.array(blocks, pa.binary())], schema=_BLOCKS_ARROW)


def _subtrees(least: int):
    """Nodes of two and three words of a group, as far as they count."""

    def run(table: pa.Table) -> pa.Table:
        partial = table["partial"][0].as_py()
        # the words' prefixes of the group: leaf totals first, then each pair from the leaves below it
        triples = _sum_equal(np.concatenate([np.frombuffer(b.as_py(), _LEAF) for b in table["block"]]))
        pair = triples["w1"].astype(np.uint64) << np.uint64(32) | triples["w2"]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        pairs = triples[first].copy()
        pairs["n"], pairs["w3"] = np.add.reduceat(triples["n"], first), 0
        triples = triples[(triples["w3"] > 0) & (triples["n"] >= least)]
        pairs = pairs[(pairs["w2"] > 0) & ((pairs["n"] >= least) | partial)]
        nodes = np.concatenate([pairs, triples])
        own = np.r_[np.full(len(pairs), partial), np.zeros(len(triples), bool)]
        columns = [pa.array(nodes[c].astype(np.int64)) for c in ("w1", "w2", "w3", "n")]
        return pa.table([*columns, pa.array(own)], schema=_NODES_ARROW)

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET, chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words ``(id, lang, word, f)``, phrases ``(w1, w2, w3, a)`` of at least ``least`` occurrences (``w3`` 0 in a pair),
    and all words ``n`` by ``lang``."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/coded"
    coded = code_words(docs, chunk_words)
    coded.write.option("compression", "zstd").parquet(path)
    coded = spark.read.schema(coded.schema).parquet(path)
    chunks = coded.filter("codes is not null").select(F.col("chunk").alias("stream"), "codes")
    held = coded.filter("word is not null").select("chunk", "lang", "code", "word", "n")

    counted = held.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    totals = write_shared(held.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = write_shared(_numbered(write_shared(_groups(counted.filter(F.col("f") >= least), budget), "groups")), "words")
    if words.agg(F.count(F.lit(1))).first()[0] >= 1 << 32:
        raise ValueError("more frequent words than 32 bits can number")
    known = held.select("chunk", "lang", "word", "code").join(words, ["lang", "word"]).select("chunk", "code", "id", "group", "pieces")
    blocks = chunks.groupBy("stream").cogroup(known.groupBy("chunk")).applyInArrow(_chunk_leaves, _BLOCKS)
    nodes = write_shared(blocks.groupBy("partial", "group").applyInArrow(_subtrees(least), _NODES), "nodes")
    added = nodes.filter("partial").groupBy("w1", "w2", "w3").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return words, nodes.filter("not partial").drop("partial").unionByName(added), totals


def _score(a: str, left: str, right: str) -> Column:
    """``floor(SCALE * a * a / (l * r))`` in exact decimals."""
    count, l, r = (F.col(c).cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", count * count * F.lit(SCALE).cast("decimal(7,0)"), l * r)


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    share: int = SHARE,
    limit: int = LIMIT,
    budget: int = BUDGET,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """The ``limit`` best phrases of each language of ``docs(text, lang)``: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts, ``n`` all words of the language. A pair is left out where a
    phrase of three words around it has ``share`` percent of its occurrences or more.
    """
    words, phrases, totals = phrase_counts(docs, least, budget, chunk_words)
    phrases = write_shared(phrases, "phrases")
    pairs = phrases.filter("w3 = 0")
    triples = phrases.filter("w3 > 0")

    def word(i: int, with_lang: bool = False) -> DataFrame:
        lang = ["lang"] if with_lang else []
        return words.select(F.col("id").alias(f"w{i}"), F.col("word").cast("string").alias(f"t{i}"), F.col("f").alias(f"f{i}"), *lang)

    def pair(i: int) -> DataFrame:
        return pairs.select(F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{i + 1}"), F.col("a").alias(f"p{i}"))

    around = triples.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    around = around.groupBy("p.w1", "p.w2").agg(F.max("a").alias("longer"))
    kept = pairs.drop("w3").join(around, ["w1", "w2"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    kept = kept.join(word(1, True), "w1").join(word(2), "w2")
    two = kept.select(
        "lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score")
    )
    whole = triples.join(word(1, True), "w1").join(word(3), "w3").join(word(2).drop("f2"), "w2").join(pair(1), ["w1", "w2"]).join(pair(2), ["w2", "w3"])
    cuts = F.array_sort(
        F.array(
            F.struct(_score("a", "f1", "p2").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("p2").alias("r")),
            F.struct(_score("a", "p1", "f3").alias("score"), F.lit(2).alias("k"), F.col("p1").alias("l"), F.col("f3").alias("r")),
        )
    )
    three = whole.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", cuts[0].alias("cut"))
    three = three.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)
    return ranked.join(broadcast_if_small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
