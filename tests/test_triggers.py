"""Triggers by automaton against testing each one."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import triggers

TABLE = "category string, aspect string, trigger string"
TEXTS = "id long, category string, body string"


def corpus(seed=1, count=80):
    rng = random.Random(seed)
    letters = "abcde É"
    texts = [(i, rng.choice(["x", "y", None]), "".join(rng.choice(letters + ".!") for _ in range(rng.randint(0, 60)))) for i in range(count)]
    table = [(rng.choice("xy"), f"a{rng.randint(0, 6)}", "".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))) for _ in range(150)]
    return texts + [(900, "x", None), (901, "x", "Good￿bad. AB"), (902, "z", "abc")], table


def brute(texts, table):
    import re

    out = set()
    for i, category, body in texts:
        parts = [p.strip(" \t\n\r\x0b\x0c") for p in re.split("[.!?]+", body or "")]
        for n, part in enumerate(p for p in parts if p):
            for c, aspect, trigger in table:
                if c == category and trigger and trigger.lower() in part.lower():
                    out.add((i, n, aspect, part))
    return out


@pytest.mark.parametrize("part_bytes", [triggers.PART_BYTES, 400])
def test_mentions_equal_testing_each_trigger(spark, part_bytes):
    texts, table = corpus()
    found = triggers.mentions(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(table * 2, TABLE), part_bytes)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(texts, table)


def test_scores_equal_those_of_the_dictionary(spark):
    texts, table = corpus(2)
    lexicon = text.Lexicon(polarity={"a": 1.5, "b": -2.0, "cc": 0.5}, intensifiers={"d": 2.0}, negations=["e"])
    keywords = {}
    for category, aspect, trigger in table:
        keywords.setdefault(category, {}).setdefault(aspect, []).append(trigger.lower())
    frame = spark.createDataFrame(texts, TEXTS)
    expected = frame.select("id", F.explode(text.aspect_opinions(F.col("body"), F.col("category"), keywords, lexicon)).alias("aspect", "score"))
    found = triggers.aspect_scores(frame, spark.createDataFrame(table, TABLE), lexicon)
    assert sorted(tuple(r) for r in found.drop("mentions").collect()) == sorted(tuple(r) for r in expected.collect())


def test_unusable_triggers_and_no_rows(spark):
    texts = spark.createDataFrame([(1, "x", "some words. more")], TEXTS)
    bad = spark.createDataFrame([(None, "a", "some"), ("x", "a", ""), ("x", "a", None), ("x", None, "some")], TABLE)
    assert triggers.mentions(texts, bad).count() == 0
    good = spark.createDataFrame([("x", "a", "WORD"), ("x", "b", "more")], TABLE)
    assert sorted((r["sentence"], r["aspect"], r["content"]) for r in triggers.mentions(texts, good).collect()) == [(0, "a", "some words"), (1, "b", "more")]
    assert triggers.aspect_scores(texts.limit(0), good).count() == 0


def test_a_batch_is_read_a_few_texts_at_a_time():
    table = pa.table({"category": ["en"], "aspect": ["a"], "trigger": ["x"]})
    parts = [[f"X{i}", "none", "xx"] for i in range(10)]
    lowered = [[s.lower() for s in each] for each in parts]
    batch = pa.RecordBatch.from_pydict({"id": list(range(10)), "category": ["en"] * 10, "parts": parts, "lowered": lowered})
    read = list(triggers._read(triggers.Automaton(table), batch, most=6))
    assert [b.num_rows for b in read] == [4] * 5
    found = [tuple(r.values()) for r in pa.Table.from_batches(read).to_pylist()]
    assert found == [(i, n, "a", parts[i][n]) for i in range(10) for n in (0, 2)]
