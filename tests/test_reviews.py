from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwise.plans import reviews

DAY = date(2026, 3, 1)
SCHEMA = "id string, product_id string, author string, body string, created_at date, helpful_votes int"
PLAIN = "The battery is good and the price is good but I would have liked another colour here"
BURST = [("p1", 0), ("p2", 3), ("p3", 7)]


def review(i, product="p1", author="x", body=None, day=0, votes=0):
    return (f"r{i}", product, author, PLAIN + str(i) if body is None else body, DAY + timedelta(days=day), votes)


@pytest.fixture(scope="module")
def products(spark):
    rows = [("p1", "Electronics"), ("p2", "Books"), ("p3", "Toys"), ("p4", "Toys")]
    return spark.createDataFrame(rows, "id string, category string")


def analyzed(spark, products, rows, **arguments):
    frame = reviews.analyze_reviews(spark.createDataFrame(rows, SCHEMA), products, **arguments)
    return {r["review_id"]: r for r in frame.collect()}


def test_a_text_counts_as_copied_from_three_on(spark, products):
    rows = [review(i, author=f"a{i}", body="same words again") for i in range(3)]
    rows += [review(i, author=f"a{i}", body="twice only here") for i in range(3, 5)]
    got = analyzed(spark, products, rows)
    assert [got[f"r{i}"]["duplicate_text"] for i in range(5)] == [1.0, 1.0, 1.0, 0.0, 0.0]


@pytest.mark.parametrize("last_day, burst", [(7, 1.0), (8, 0.0)])
def test_burst_spans_the_whole_history(spark, products, last_day, burst):
    rows = [review(0), review(1, "p2", day=2), review(2, "p3", day=last_day)]
    assert {r["author_burst"] for r in analyzed(spark, products, rows).values()} == {burst}


def test_burst_needs_three_products(spark, products):
    rows = [review(0), review(1, "p2"), review(2, "p2"), review(3, "p1")]
    assert {r["author_burst"] for r in analyzed(spark, products, rows).values()} == {0.0}


def test_scores_and_threshold(spark, products):
    rows = [review(i, p, "spam", "Buy now!! wow", d) for i, (p, d) in enumerate(BURST)]
    rows += [review(9, "p1", "calm", "Buy now!! wow")]
    got = analyzed(spark, products, rows)
    assert got["r0"]["fake_score"] == 1.0 and got["r0"]["likely_fake"]
    assert got["r9"]["fake_score"] == 0.65
    assert got["r0"]["generic_text"] == 1.0


def test_review_of_unknown_product_has_no_category_and_is_left_out(spark, products):
    assert analyzed(spark, products, [review(0, "nowhere")]) == {}


def test_kept_columns_and_digits(spark, products):
    got = analyzed(spark, products, [review(0, body="good nice great", votes=4)], digits=None, keep=["helpful_votes"])
    assert got["r0"]["sentiment_score"] == 1.5 and got["r0"]["helpful_votes"] == 4


def analysis(spark, rows):
    return spark.createDataFrame(
        rows,
        "review_id string, product_id string, sentiment_score double, aspects map<string,double>, "
        "likely_fake boolean, fake_score double",
    )


def test_summary_uses_genuine_reviews(spark):
    rows = [
        ("a", "p", 1.0, {"price": 1.0, "size": 2.0}, False, 0.0),
        ("b", "p", 2.0, {"price": 0.0}, False, 0.0),
        ("c", "p", -9.0, {"price": -9.0, "fit": -9.0}, True, 0.9),
        ("d", "q", -3.0, {"fit": -1.0}, True, 0.9),
        ("e", "q", -2.0, {}, True, 0.9),
    ]
    got = {r["product_id"]: r.asDict(recursive=True) for r in reviews.summarize_products(analysis(spark, rows)).collect()}
    assert got["p"] == {
        "product_id": "p", "review_count": 3, "avg_sentiment": 1.5, "likely_fake_count": 1,
        "aspects": [
            {"aspect": "price", "avg_sentiment": 0.5, "mentions": 2},
            {"aspect": "size", "avg_sentiment": 2.0, "mentions": 1},
        ],
    }
    # every review of q is flagged, so all of them count
    assert got["q"]["avg_sentiment"] == -2.5 and got["q"]["likely_fake_count"] == 2
    assert got["q"]["aspects"] == [{"aspect": "fit", "avg_sentiment": -1.0, "mentions": 1}]


def test_badges(spark):
    rows = [("a", "p", 1.0, {"price": 0.3, "size": 0.31, "fit": -0.4}, False, 0.0)]
    badges = reviews.aspect_badges(reviews.summarize_products(analysis(spark, rows))).orderBy("position").collect()
    assert [(r["aspect"], r["polarity"]) for r in badges] == [
        ("fit", "negative"), ("price", "neutral"), ("size", "positive"),
    ]


def test_reviews_of_a_product_by_helpful_votes(spark):
    rows = spark.createDataFrame([review(0, votes=1), review(1, votes=5), review(2, "p2", votes=9)], SCHEMA)
    scores = analysis(spark, [("r1", "p1", 0.5, {}, False, 0.1)])
    listed = reviews.product_reviews(rows, scores, "p1").collect()
    assert [(r["id"], r["sentiment_score"]) for r in listed] == [("r1", 0.5), ("r0", None)]


def test_text_copies_shuffle_digests_only(spark):
    frame = spark.createDataFrame([review(0)], SCHEMA)
    plan = reviews.text_copies(frame).select(F.sum("copies"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [digest" in plan and "Aggregate [body" not in plan
