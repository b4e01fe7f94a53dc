"""The jobs from JSON files to result tables."""

import json

import pytest

from shelfwise import jobs
from shelfwise.plans import search

PRODUCTS = [
    {"id": f"P{i}", "title": f"Compact Lamp {i}", "description": "good light", "category": "Electronics", "brand": "Acme",
     "seller_id": "S", "price": 10.0 + i, "currency": "USD", "rating": 4.0, "rating_count": 10, "tags": ["a"],
     "material": "Steel", "created_at": "2026-01-02"}
    for i in range(3)
]
GENUINE = "The battery is excellent and it has lasted me for many long days and nights. The price is not good"
REVIEWS = [
    {"id": f"R{i}", "product_id": f"P{i % 3}", "author": f"A{i}", "rating": 5, "title": "t", "body": GENUINE + f" {i}x",
     "verified_purchase": True, "helpful_votes": i, "created_at": "2026-02-01", "is_fake_synthetic": False}
    for i in range(4)
] + [
    {"id": f"F{i}", "product_id": f"P{i}", "author": "spam", "rating": 5, "title": "t", "body": "Wow!! Amazing!!",
     "verified_purchase": False, "helpful_votes": 0, "created_at": f"2026-02-0{i + 1}", "is_fake_synthetic": True}
    for i in range(3)
]
TRANSACTIONS = [
    {"id": f"T{i}", "product_id": "P1", "buyer_id": "B", "quantity": 1, "amount": 20.0, "payment_method": "card",
     "shipping_region": "US", "billing_region": "US", "buyer_account_age_days": 90,
     "created_at": f"2026-01-01T10:0{i}", "is_fraud_synthetic": True}
    for i in range(5)
] + [
    {"id": "T9", "product_id": "P1", "buyer_id": "C", "quantity": 1, "amount": 20.0, "payment_method": "card",
     "shipping_region": "EU", "billing_region": "US", "buyer_account_age_days": 3,
     "created_at": "2026-01-01T10:00", "is_fraud_synthetic": True},
]
HISTORY = [
    {"product_id": p, "date": f"2026-01-{d:02d}", "units_sold": u, "stock_level": s, "stockout": False, "restocked": False}
    for p, u, s in [("P1", 5, 10), ("P2", 1, 400)]
    for d in range(1, 29)
]
INPUTS = [
    {"product_id": "P1", "elasticity": 2.0, "marginal_cost": 10.0, "reference_price": 25.0, "reference_quantity": 100},
    {"product_id": "P2", "elasticity": 2.0, "marginal_cost": 10.0, "reference_price": 20.0, "reference_quantity": 100},
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    tables = {"products": PRODUCTS, "reviews": REVIEWS, "transactions": TRANSACTIONS, "inventory_history": HISTORY,
              "pricing_inputs": INPUTS}
    for name, rows in tables.items():
        (root / f"{name}.json").write_text(json.dumps(rows, indent=2), encoding="utf-8")
    return str(root)


def manifest(spark, path):
    row = spark.read.json(path).first().asDict()
    return row | json.loads(row["parameters"])


def test_review_job(spark, folder, tmp_path):
    jobs.review_job(spark, folder, str(tmp_path))
    rows = {r["review_id"]: r for r in spark.read.parquet(f"{tmp_path}/review_analysis").collect()}
    assert rows["F0"]["fake_score"] == 1.0 and not rows["R0"]["likely_fake"]
    assert rows["R0"]["aspects"] == {"battery life": 3.0, "price": -1.5}
    assert rows["R0"]["sentiment_score"] == 0.75
    summary = {r["product_id"]: r for r in spark.read.parquet(f"{tmp_path}/product_review_summary").collect()}
    assert (summary["P0"]["review_count"], summary["P0"]["likely_fake_count"]) == (3, 1)
    assert summary["P0"]["avg_sentiment"] == 0.75
    described = manifest(spark, f"{tmp_path}/reviews_manifest")
    assert (described["precision"], described["recall"], described["f1"]) == (1.0, 1.0, 1.0)
    assert (described["num_reviews"], described["num_products"], described["lexicon_size"]) == (7, 3, 112)
    assert described["fake_score_threshold"] == 0.5


def test_fraud_job(spark, folder, tmp_path):
    jobs.fraud_job(spark, folder, str(tmp_path))
    rows = {r["transaction_id"]: r for r in spark.read.parquet(f"{tmp_path}/fraud_scores").collect()}
    assert rows["T0"]["fraud_score"] == 0.55 and rows["T0"]["indicators"]["velocity"] == 1.0
    assert rows["T9"]["fraud_score"] == 0.3 and not rows["T9"]["likely_fraud"]
    described = manifest(spark, f"{tmp_path}/fraud_manifest")
    assert (described["precision"], described["recall"], described["num_transactions"]) == (1.0, 0.833, 6)


def test_inventory_job(spark, folder, tmp_path):
    jobs.inventory_job(spark, folder, str(tmp_path), out_fmt="json")
    rows = {r["product_id"]: r for r in spark.read.json(f"{tmp_path}/inventory_forecasts").collect()}
    assert (rows["P1"]["avg_daily_forecast"], rows["P1"]["reorder_point"], rows["P1"]["needs_reorder"]) == (5.0, 35.0, True)
    assert rows["P2"]["days_of_supply"] == 400.0
    described = manifest(spark, f"{tmp_path}/inventory_manifest")
    assert (described["num_products"], described["num_products_needing_reorder"], described["alpha"]) == (2, 1, 0.3)


def test_pricing_job(spark, folder, tmp_path):
    jobs.pricing_job(spark, folder, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/pricing_recommendations").count() == 2
    described = manifest(spark, f"{tmp_path}/pricing_manifest")
    assert [described[k] for k in ("raise", "lower", "near-optimal", "num_products")] == [0, 1, 1, 2]


def test_embedding_job(spark, folder, tmp_path):
    jobs.embedding_job(spark, folder, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/embeddings").count() == 3
    described = manifest(spark, f"{tmp_path}/embeddings_manifest")
    assert (described["num_products"], described["dim"], described["model"]) == (3, 64, "hashed-tokens")


def test_search_job(spark, folder, tmp_path):
    jobs.embedding_job(spark, folder, str(tmp_path))
    jobs.search_job(spark, folder, str(tmp_path))
    index = search.open_index(spark, str(tmp_path / "search_index"))
    figures = spark.read.json(str(tmp_path / "search_manifest")).first()
    assert figures["n_docs"] == index.count() > 0 and figures["dim"] == len(index.first()["vector"])
    assert json.loads(figures["parameters"])["k1"] == 1.5
    queries = spark.createDataFrame([(1, index.first()["terms"][0]["term"], index.first()["vector"])], "qid long, text string, vector array<double>")
    assert search.hybrid_search(index, queries, 3).count() == min(3, index.count())
