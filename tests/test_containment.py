"""The containment join by rare grams against testing every pair."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import containment, photos

PHRASES, TEXTS = "phrase string, category string", "id long, category string, text string"


def rows(seed=1):
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("abcé ") for _ in range(rng.randint(a, b)))
    texts = [(i, rng.choice(["x", "y", None]), word(0, 25)) for i in range(200)] + [(500, "x", None), (3, "x", "abc")]
    phrases = [(word(1, 6), rng.choice(["x", "y", "z"])) for _ in range(150)]
    return texts, phrases + [("", "x"), (None, "x"), ("abc", None), phrases[0], ("ab", "x")]


@pytest.mark.parametrize("size", [1, 3])
def test_equal_testing_every_pair(spark, size):
    texts, phrases = rows()
    found = containment.contained(spark.createDataFrame(phrases, PHRASES), spark.createDataFrame(texts, TEXTS), size)
    expected = [(p, i) for p, c in phrases for i, d, t in texts if c is not None and c == d and p is not None and t is not None and p in t]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_phrases_lie_under_their_rarest_gram(spark):
    phrases = spark.createDataFrame([(1, "abcd", "x"), (2, "ab", "x"), (3, "zzzz", "x")], "number long, phrase string, category string")
    grams = spark.createDataFrame([("x", "abc")] * 3 + [("x", "bcd"), ("x", "ab"), ("y", "bcd")], "category string, gram string")
    assert sorted((r["number"], r["gram"]) for r in containment.file_phrases(phrases, grams).collect()) == [(1, "bcd"), (2, "ab")]


def test_same_rows_as_the_join_by_category(spark):
    texts, phrases = rows(2)
    nouns = spark.createDataFrame([p for p in phrases if p[0]], "noun string, category string")
    products = spark.createDataFrame(texts, "id long, category string, title string")
    found, expected = (sorted(tuple(r) for r in f(nouns, products).collect()) for f in (containment.products_of_nouns, photos.products_of_nouns))
    assert found == expected


def test_the_category_alone_is_no_key(spark):
    texts, phrases = rows(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = containment.contained(spark.createDataFrame(phrases, PHRASES).where("phrase <> ''"), spark.createDataFrame(texts, TEXTS))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(category" in plan and "gram" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nothing_to_find(spark):
    texts = spark.createDataFrame([(1, "x", "abc")], TEXTS)
    none = spark.createDataFrame([], PHRASES)
    assert containment.contained(none, texts).count() == 0
    assert containment.contained(spark.createDataFrame([("abc", "x")], PHRASES), texts.where(F.lit(False))).count() == 0
