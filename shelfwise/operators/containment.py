"""A join on containment: which texts contain which phrases of the same category.

``photos.products_of_nouns`` joins on the category alone and tests every pair in it, which few categories can't spread.
Here each phrase is filed under one of its own grams, the one that the fewest texts of its category hold, and meets only
texts with that gram; what meets is verified. The join's key is ``(category, gram)``, so its partitions are as many as there
are grams, and no side has to be broadcast.

A phrase shorter than a gram is filed under itself. An empty phrase is contained in every text of its category. A null
phrase, text or category meets nothing. Repeated phrases and texts give repeated rows, as in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.shared import write_shared

GRAM = 3


def _grams(text: str, sizes: list[int]) -> Column:
    """Distinct runs of characters of each size."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (n - 1), F.lit(1)))
        held = F.transform(starts, lambda at: F.substring(F.col(text), at, F.lit(n)))
        return F.when(F.char_length(text) >= n, held).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[runs(n) for n in sizes])))


def file_phrases(phrases: DataFrame, grams: DataFrame, size: int = GRAM) -> DataFrame:
    """``phrases(number, phrase, category)`` with the rarest of their grams among ``grams(category, gram)``, one row for each text.

    A phrase with a gram that no text of its category holds is left out: nothing contains it.
    """
    own = F.when(F.char_length("phrase") >= size, _grams("phrase", [size])).otherwise(F.array("phrase"))
    asked = phrases.select("number", "category", F.explode(own).alias("gram"))
    counted = grams.join(asked.select("category", "gram").distinct(), ["category", "gram"], "left_semi")
    counted = counted.groupBy("category", "gram").agg(F.count(F.lit(1)).alias("texts"))
    held = asked.join(counted, ["category", "gram"], "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = held.groupBy("number").agg(F.min(F.struct("texts", "gram")).alias("rarest")).filter("rarest.texts > 0")
    return phrases.join(rarest, "number").select("number", "phrase", "category", F.col("rarest.gram").alias("gram"))


def contained(phrases: DataFrame, texts: DataFrame, size: int = GRAM) -> DataFrame:
    """``phrase, id`` of every row of ``texts(id, category, text)`` that contains a phrase of ``phrases(phrase, category)``."""
    known = phrases.select("phrase", "category").where("phrase is not null and category is not null")
    known = write_shared(known.withColumn("number", F.monotonically_increasing_id()), "phrases")
    texts = texts.select("id", "category", "text").where("text is not null and category is not null")
    lengths = known.where("phrase <> ''").select(F.least(F.char_length("phrase"), F.lit(size)).alias("n")).distinct()
    sizes = sorted(r["n"] for r in lengths.collect())  # at most ``size`` numbers
    empty = known.where("phrase = ''").join(texts, "category").select("phrase", "id")
    if not sizes:
        return empty
    spread = texts.select("id", "category", "text", F.explode(_grams("text", sizes)).alias("gram"))
    filed = write_shared(file_phrases(known.where("phrase <> ''"), spread.select("category", "gram"), size), "filed")
    met = spread.join(filed, ["category", "gram"]).where(F.contains("text", "phrase"))
    return met.select("phrase", "id").unionByName(empty)


def products_of_nouns(nouns: DataFrame, products: DataFrame) -> DataFrame:
    """The rows of ``photos.products_of_nouns`` for any number of nouns: ``noun, id``."""
    named = products.select("id", "category", F.col("title").alias("text"))
    return contained(nouns.select(F.col("noun").alias("phrase"), "category"), named).withColumnRenamed("phrase", "noun")
