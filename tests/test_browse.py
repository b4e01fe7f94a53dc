from datetime import date

import pytest

from shelfwise.operators import browse


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        ("P1", "Home & Kitchen", "Acme", "Steel", 20.5, 4.5, 10, date(2026, 1, 1)),
        ("P2", "Home & Kitchen", "Bolt", "Wood", 10.0, 4.5, 50, date(2026, 1, 3)),
        ("P3", "Home & Kitchen", "Acme", "Wood", 99.1, 3.0, 900, date(2026, 1, 2)),
        ("P4", "Books", "Bolt", "Paper", 5.0, 5.0, 1, date(2026, 1, 3)),
    ]
    return spark.createDataFrame(
        rows,
        "id string, category string, brand string, material string, price double, rating double, "
        "rating_count int, created_at date",
    )


def ids(frame):
    return [r["id"] for r in frame.collect()]


def test_category_page(products):
    assert ids(browse.browse(products, "home-and-kitchen")) == ["P1", "P2", "P3"]
    assert ids(browse.browse(products, "home-and-kitchen", "price-asc")) == ["P2", "P1", "P3"]
    assert ids(browse.browse(products, "home-and-kitchen", "price-desc", brands=["Acme"])) == ["P3", "P1"]
    assert ids(browse.browse(products, "garden")) == []


def test_filters(products):
    assert ids(browse.filter_products(products)) == ["P1", "P2", "P3", "P4"]
    assert ids(browse.filter_products(products, min_rating=4.5, max_price=10.0)) == ["P2", "P4"]
    assert ids(browse.filter_products(products, materials=["Wood"], brands=["Bolt"])) == ["P2"]


def test_facets_of_the_current_list(products):
    listed = browse.in_category(products, "home-and-kitchen")
    assert [tuple(r) for r in browse.facets(listed).collect()] == [
        ("brand", "Acme"), ("brand", "Bolt"), ("material", "Steel"), ("material", "Wood"),
    ]
    assert browse.price_ceiling(listed).first()["price_max"] == 100
    assert browse.price_ceiling(products.limit(0)).first()["price_max"] == 0


def test_top_lists_and_lookup(products):
    assert ids(browse.top_rated(products, 2)) == ["P3", "P2"]
    assert ids(browse.newest(products, 3)) == ["P2", "P4", "P3"]
    assert ids(browse.by_id(products, "P3")) == ["P3"]


def test_unknown_sort(products):
    with pytest.raises(KeyError):
        browse.sort_products(products, "weight")
