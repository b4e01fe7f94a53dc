"""Catalog browsing: category pages, facets, filters, sorts and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import slugify
from shelfwise.operators.positions import number_rows

SORTS = {
    "relevance": [F.asc, "rank"],
    "rating": [F.desc, "rating"],
    "price-asc": [F.asc, "price"],
    "price-desc": [F.desc, "price"],
}


def in_category(products: DataFrame, slug: str) -> DataFrame:
    return products.where(slugify(F.col("category")) == slug)


def by_id(products: DataFrame, product_id) -> DataFrame:
    return products.where(F.col("id") == product_id)


def filter_products(
    products: DataFrame,
    min_rating: float = 0.0,
    max_price: float | None = None,
    brands: Sequence[str] = (),
    materials: Sequence[str] = (),
) -> DataFrame:
    """Facet filter; ``None`` or an empty list switches a facet off."""
    kept = products.where(F.col("rating") >= min_rating)
    if max_price is not None:
        kept = kept.where(F.col("price") <= max_price)
    if brands:
        kept = kept.where(F.col("brand").isin(list(brands)))
    if materials:
        kept = kept.where(F.col("material").isin(list(materials)))
    return kept


def facets(products: DataFrame) -> DataFrame:
    """``(facet, value)`` for every brand and material that occurs in the list, in order."""
    values = F.inline(
        F.array(
            F.struct(F.lit("brand").alias("facet"), F.col("brand").alias("value")),
            F.struct(F.lit("material").alias("facet"), F.col("material").alias("value")),
        )
    )
    return products.select(values).distinct().orderBy("facet", "value")


def price_ceiling(products: DataFrame) -> DataFrame:
    """One row: the highest price of the list rounded up, 0 for an empty list."""
    highest = F.coalesce(F.max("price"), F.lit(0.0))
    return products.agg(F.ceil(F.greatest(highest, F.lit(0.0))).alias("price_max"))


def sort_products(products: DataFrame, sort: str) -> DataFrame:
    direction, column = SORTS[sort]
    return products.orderBy(direction(column), "id")


def positions(products: DataFrame, sort: str, *more_keys: str) -> DataFrame:
    """Products with their ``position`` in a sort, from 1. ``more_keys`` end ties of rows that share an id."""
    direction, column = SORTS[sort]
    return number_rows(products, [direction(column), F.asc("id"), *[F.asc(k) for k in more_keys]])


def top_by(products: DataFrame, score: Column, limit: int) -> DataFrame:
    return products.orderBy(score.desc(), "id").limit(limit)


def top_rated(products: DataFrame, limit: int = 10) -> DataFrame:
    return top_by(products, F.col("rating") * F.col("rating_count"), limit)


def newest(products: DataFrame, limit: int = 10) -> DataFrame:
    return top_by(products, F.col("created_at"), limit)


def browse(products: DataFrame, slug: str, sort: str = "rating", **filters) -> DataFrame:
    """A category page: the products of the category that pass the facet filter, sorted."""
    return sort_products(filter_products(in_category(products, slug), **filters), sort)
