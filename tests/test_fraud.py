import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwise.operators.evaluate import evaluate_flags
from shelfwise.plans import fraud

START = datetime(2026, 1, 1, 12, 0)
SCHEMA = (
    "id string, buyer_id string, amount double, shipping_region string, billing_region string, "
    "buyer_account_age_days int, created_at timestamp_ntz, is_fraud boolean"
)


def transaction(i, minutes=0, buyer="b", amount=10.0, ship="US", bill="US", age=100, is_fraud=False):
    return (f"t{i}", buyer, amount, ship, bill, age, START + timedelta(minutes=minutes), is_fraud)


def scored(spark, rows, **arguments):
    frame = fraud.score_fraud(spark.createDataFrame(rows, SCHEMA), **arguments)
    return {r["id"]: r for r in frame.collect()}


def test_window_includes_both_ends(spark):
    got = scored(spark, [transaction(0), transaction(1, 15), transaction(2, 31)])
    assert [got[t]["nearby"] for t in ("t0", "t1", "t2")] == [1, 1, 0]


def test_levels_and_identical_times(spark):
    rows = [transaction(i) for i in range(3)] + [transaction(3 + i, 60 * 24 + i) for i in range(4)]
    rows += [transaction(9, 0, buyer="other")]
    got = scored(spark, rows)
    assert [got[f"t{i}"]["velocity"] for i in range(3)] == [0.6] * 3
    assert [got[f"t{i}"]["velocity"] for i in range(3, 7)] == [1.0] * 4
    assert got["t9"]["velocity"] == 0.0


@pytest.mark.parametrize("minutes", [1, 15, 240])
def test_counts_equal_a_plain_loop(spark, minutes):
    rng = random.Random(minutes)
    # one buyer has most rows, close together and across many buckets
    rows = [
        transaction(i, rng.randint(-3000, 3000), buyer="hot" if rng.random() < 0.7 else f"b{rng.randint(0, 5)}")
        for i in range(500)
    ]
    got = scored(spark, rows, minutes=minutes)
    assert len(got) == 500
    for row in rows:
        near = sum(r[1] == row[1] and abs(r[6] - row[6]) <= timedelta(minutes=minutes) for r in rows) - 1
        assert got[row[0]]["nearby"] == near


def test_a_transaction_without_buyer_is_kept(spark):
    assert scored(spark, [transaction(0, buyer=None)])["t0"]["velocity"] == 0.0


@pytest.mark.parametrize("age, risk", [(14, 1.0), (15, 0.4)])
def test_region_risk(spark, age, risk):
    got = scored(spark, [transaction(0, ship="EU", age=age), transaction(1, buyer="c", age=age)])
    assert (got["t0"]["region_risk"], got["t1"]["region_risk"]) == (risk, 0.0)


@pytest.mark.parametrize("age, amount, flag", [(14, 150.0, 1.0), (14, 149.99, 0.0), (15, 150.0, 0.0)])
def test_new_account_high_value(spark, age, amount, flag):
    assert scored(spark, [transaction(0, age=age, amount=amount)])["t0"]["new_account_high_value"] == flag


def test_all_indicators_together_exceed_one(spark):
    rows = [transaction(i, i, amount=200.0, ship="EU", age=3) for i in range(4)]
    row = scored(spark, rows)["t0"]
    assert row["fraud_score"] == 1.1 and row["likely_fraud"]


def test_threshold_includes_its_value(spark):
    got = scored(spark, [transaction(0, ship="EU", age=3), transaction(1, buyer="c", ship="EU", age=3, amount=150.0)])
    assert (got["t0"]["fraud_score"], got["t0"]["likely_fraud"]) == (0.3, False)
    assert (got["t1"]["fraud_score"], got["t1"]["likely_fraud"]) == (0.55, True)


def test_report_counts_a_missing_score_as_zero(spark):
    rows = spark.createDataFrame([transaction(i) for i in range(3)], SCHEMA)
    scores = spark.createDataFrame([("t1", 0.4, False)], "transaction_id string, fraud_score double, likely_fraud boolean")
    assert [r["id"] for r in fraud.fraud_report(rows, scores, 2).collect()] == ["t1", "t0"]


def test_report_filled_by_scores_alone(spark):
    rows = spark.createDataFrame([transaction(i) for i in range(5)], SCHEMA)
    scores = [("t4", 0.9, True), ("t1", 0.4, False), ("t3", 0.4, False), ("gone", 0.95, True), ("t0", None, None)]
    scores = spark.createDataFrame(scores, "transaction_id string, fraud_score double, likely_fraud boolean")
    for limit, expected in ((2, ["t4", "t1"]), (3, ["t4", "t1", "t3"]), (5, ["t4", "t1", "t3", "t0", "t2"])):
        assert [r["id"] for r in fraud.fraud_report(rows, scores, limit).collect()] == expected


def test_published_shape(spark):
    table = fraud.fraud_scores_table(fraud.score_fraud(spark.createDataFrame([transaction(0)], SCHEMA)))
    row = table.first().asDict(recursive=True)
    assert row == {
        "transaction_id": "t0", "fraud_score": 0.0, "likely_fraud": False,
        "indicators": {"velocity": 0.0, "region_risk": 0.0, "new_account_high_value": 0.0},
    }


def test_evaluation(spark):
    rows = [(True, True)] * 3 + [(True, False)] + [(False, True)] * 2 + [(False, False)] * 4
    row = evaluate_flags(spark.createDataFrame(rows, "flag boolean, truth boolean"), "flag", "truth").first()
    assert tuple(row)[:4] == (3, 1, 2, 4)
    assert (row["precision"], row["recall"], row["f1"]) == (0.75, 0.6, 0.667)


def test_evaluation_without_positives(spark):
    row = evaluate_flags(spark.createDataFrame([(False, False)], "flag boolean, truth boolean"), "flag", "truth").first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_velocity_spreads_one_buyer_over_buckets(spark):
    frame = spark.createDataFrame([transaction(i, i * 7) for i in range(400)], SCHEMA)
    plan = fraud.nearby_counts(frame)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(buyer_id" in plan and "bucket" in plan
    assert frame.select(F.col("buyer_id")).distinct().count() == 1
