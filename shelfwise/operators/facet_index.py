"""A bitmap index of facets: lists of many selections, and the facets of each list, without reading the products again.

Products are numbered; a facet's value has one bitmap of ``BITS`` numbers for each bucket in which it occurs. A selection
is a set of facet values: products match that have one of the chosen values of every facet that the selection names,
so its list is an AND over facets of an OR over values, bucket by bucket. The facets of a list are the values whose bitmaps
meet it, with the number of products that do.

Bitmaps are Spark's: built, united and intersected by aggregates with a partial step, so nothing is gathered but bitmaps of
one bucket. A product without a value of a facet has no bit there; a selection that names an unknown value only has an
empty list.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.positions import number_rows
from shelfwise.sources.shared import write_shared

FACETS = ("brand", "material")


@dataclass(frozen=True)
class FacetIndex:
    """Products with their ``position``, and ``(facet, value, bucket, bits)``."""

    products: DataFrame
    bitmaps: DataFrame


def build_facet_index(products: DataFrame, facets: tuple[str, ...] = FACETS) -> FacetIndex:
    """An index of ``products(id, ...)`` over the columns ``facets``; values are compared as strings."""
    numbered = write_shared(number_rows(products, [F.asc("id")], first=0), "numbered_products")
    entries = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    values = numbered.select("position", F.inline(entries)).filter("value is not null")
    return FacetIndex(numbered, write_shared(_bitmaps(values, "facet", "value"), "bitmaps"))


def _bitmaps(rows: DataFrame, *keys: str) -> DataFrame:
    """One bitmap of ``position`` for each bucket of each group."""
    bucket, bit = F.bitmap_bucket_number("position").alias("bucket"), F.bitmap_bit_position("position").alias("bit")
    return rows.select(*keys, bucket, bit).groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def with_condition(index: FacetIndex, conditions: Mapping[str, Column]) -> FacetIndex:
    """The index with conditions on other columns as facets of their own, with the value ``true``.

    ``{"cheap": F.col("price") <= 100}`` makes a facet ``cheap`` that selections can name.
    """
    entries = F.array(*[F.struct(F.lit(name).alias("facet"), F.when(condition, "true").alias("value")) for name, condition in conditions.items()])
    rows = index.products.select("position", F.inline(entries)).filter("value is not null")
    return FacetIndex(index.products, index.bitmaps.unionByName(write_shared(_bitmaps(rows, "facet", "value"), "conditions")))


def lists(index: FacetIndex, selections: DataFrame) -> DataFrame:
    """``selection, bucket, bits`` of ``selections(selection, facet, value)``: the products that match, as bitmaps."""
    wanted = selections.select("selection", "facet", F.col("value").cast("string").alias("value")).distinct()
    needed = wanted.groupBy("selection").agg(F.count_distinct("facet").alias("needed"))
    either = wanted.join(index.bitmaps, ["facet", "value"]).groupBy("selection", "facet", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = either.groupBy("selection", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    # a facet without a bit in a bucket has no row there: the intersection is empty
    met = both.join(needed, "selection").filter("n = needed and bitmap_count(bits) > 0")
    return met.select("selection", "bucket", "bits")


def list_sizes(index: FacetIndex, selections: DataFrame) -> DataFrame:
    """``selection, n`` of every selection, also of those without a product."""
    sizes = lists(index, selections).groupBy("selection").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return selections.select("selection").distinct().join(sizes, "selection", "left").select("selection", F.coalesce("n", F.lit(0)).alias("n"))


def facets_of(index: FacetIndex, selections: DataFrame) -> DataFrame:
    """``selection, facet, value, n``: the values that occur in each selection's list, and in how many products."""
    found = lists(index, selections).withColumnRenamed("bits", "listed")
    meeting = found.join(index.bitmaps, "bucket").select("selection", "facet", "value", "bucket", F.explode(F.array("listed", "bits")).alias("bits"))
    common = meeting.groupBy("selection", "facet", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    return common.groupBy("selection", "facet", "value").agg(F.sum("n").alias("n")).filter("n > 0")


def products_of(index: FacetIndex, selections: DataFrame) -> DataFrame:
    """The products of each selection's list, with ``selection``."""
    found = lists(index, selections)
    bucket, bit = F.bitmap_bucket_number("position"), F.bitmap_bit_position("position")
    placed = index.products.withColumn("bucket", bucket).withColumn("bit", bit).join(found, "bucket")
    # the bit of a position: bytes count from the left, bits of a byte from the right
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("getbit", byte, (F.col("bit") % 8).cast("int")) == 1
    return placed.filter(held).drop("bucket", "bit", "bits")
