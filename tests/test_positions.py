"""Numbers of rows over the whole table."""

import random

from pyspark.sql import functions as F

from shelfwise.operators.positions import number_rows


def test_numbers_follow_the_order(spark):
    rng = random.Random(3)
    values = [(i, rng.choice([None, 0.5, 1.0, 2.5]), rng.choice("abc")) for i in range(500)]
    rows = spark.createDataFrame(values, "id int, score double, word string").repartition(7)
    found = number_rows(rows, [F.desc_nulls_last("score"), F.asc("word"), F.asc("id")])
    expected = sorted(values, key=lambda v: (v[1] is None, -(v[1] or 0), v[2], v[0]))
    assert {r["id"]: r["position"] for r in found.collect()} == {v[0]: i for i, v in enumerate(expected, 1)}
    assert found.columns == ["id", "score", "word", "position"]


def test_numbers_without_an_order_have_no_gap(spark):
    rows = spark.range(1_000).repartition(9).filter("id % 3 = 0")
    assert sorted(r["n"] for r in number_rows(rows, name="n", first=0).collect()) == list(range(334))


def test_no_rows(spark):
    assert number_rows(spark.range(0), [F.asc("id")]).count() == 0


def test_repeated_rows_get_distinct_numbers(spark):
    rows = spark.createDataFrame([(1,)] * 50, "id int")
    assert sorted(r["position"] for r in number_rows(rows, [F.asc("id")]).collect()) == list(range(1, 51))
