"""Bitmaps of facets against filtering the products."""

import random

from pyspark.sql import functions as F

from shelfwise.operators import browse, facet_index

PRODUCTS = "id long, brand string, material string, price double, rating double"


def catalog(spark, count=400):
    rng = random.Random(2)
    rows = [(i * 3, rng.choice(["a", "b", "c", None]), rng.choice(["wood", "iron", "wool"]), round(rng.uniform(1, 99), 2), 1 + i % 5) for i in range(count)]
    return rows, spark.createDataFrame([(*r[:4], float(r[4])) for r in rows], PRODUCTS).repartition(5)


def test_lists_and_facets_equal_filters(spark):
    rows, products = catalog(spark)
    index = facet_index.build_facet_index(products)
    index = facet_index.with_condition(index, {"cheap": F.col("price") <= 30, "good": F.col("rating") >= 4})
    chosen = {
        1: {"brand": ["a"]}, 2: {"brand": ["a", "c"], "material": ["iron"]}, 3: {"brand": ["zzz"]}, 4: {"brand": ["b"], "material": ["none"]},
        5: {"material": ["wood", "wool"], "cheap": ["true"], "good": ["true"]}, 6: {"brand": ["a", "zzz"]},
    }
    selections = spark.createDataFrame([(s, f, v) for s, its in chosen.items() for f, vs in its.items() for v in vs], "selection int, facet string, value string")
    sizes = {r["selection"]: r["n"] for r in facet_index.list_sizes(index, selections.unionByName(selections)).collect()}
    shown = {}
    for r in facet_index.products_of(index, selections).collect():
        shown.setdefault(r["selection"], set()).add(r["id"])
    facets = {(r["selection"], r["facet"], r["value"]): r["n"] for r in facet_index.facets_of(index, selections).collect()}
    for s, its in chosen.items():
        kept = browse.filter_products(
            products, 4.0 if "good" in its else 0.0, 30.0 if "cheap" in its else None, its.get("brand", ()), its.get("material", ())
        ).collect()
        assert sizes[s] == len(kept) and shown.get(s, set()) == {r["id"] for r in kept}
        for facet in ("brand", "material"):
            values = {r[facet] for r in kept if r[facet]}
            assert {v for (t, f, v) in facets if (t, f) == (s, facet)} == values
            assert all(facets[s, facet, v] == sum(r[facet] == v for r in kept) for v in values)


def test_more_products_than_a_bitmap_holds(spark):
    products = spark.range(70_000).select("id", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("brand"), (F.col("id") % 1_000).cast("string").alias("material"))
    index = facet_index.build_facet_index(products)
    selections = spark.createDataFrame([(1, "brand", "odd"), (1, "material", "7"), (2, "material", "8"), (2, "brand", "odd")], "selection int, facet string, value string")
    assert {r["selection"]: r["n"] for r in facet_index.list_sizes(index, selections).collect()} == {1: 70, 2: 0}
    assert sorted(r["id"] for r in facet_index.products_of(index, selections).collect()) == list(range(7, 70_000, 1_000))


def test_no_products_and_no_selections(spark):
    _, products = catalog(spark, 5)
    index = facet_index.build_facet_index(products.limit(0))
    one = spark.createDataFrame([(1, "brand", "a")], "selection int, facet string, value string")
    assert [tuple(r) for r in facet_index.list_sizes(index, one).collect()] == [(1, 0)]
    assert facet_index.facets_of(index, one).count() == 0
    assert facet_index.facets_of(facet_index.build_facet_index(products), one.limit(0)).count() == 0
