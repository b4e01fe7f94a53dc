"""Holt's method as a scan against the fold over days."""

import datetime
import random

import pytest

from shelfwise.operators import trend
from shelfwise.plans import inventory

HISTORY = "product_id string, date date, units_sold int, stock_level int, stockout boolean"


def history(seed, products=6, length=150):
    rng, rows = random.Random(seed), []
    for p in range(products):
        day = datetime.date(2024, 1, 1)
        for _ in range(rng.choice([1, 2, 3, length])):
            day += datetime.timedelta(days=rng.choice([1, 1, 1, 2, 40]))
            for _ in range(rng.choice([1, 1, 2])):
                rows.append((f"p{p}", day, rng.randint(0, 9) * rng.choice([0, 1, 1]), 5, rng.random() < 0.2))
    rows += [("zero", datetime.date(2024, 2, d), 0, 0, d % 2 == 0) for d in range(1, 20)]
    return rows + [("nostock", datetime.date(2024, 2, d), 4, 0, None) for d in range(1, 4)]


@pytest.mark.parametrize("bucket", [2, 7, 64])
def test_scan_equals_the_fold(spark, bucket):
    rows = spark.createDataFrame(history(1), HISTORY).repartition(5)
    folded = inventory.with_holt(inventory.with_seasonal_index(inventory.daily_series(rows)), 0.4, 0.2)
    expected = {r["product_id"]: (r["level"], r["trend"]) for r in folded.collect() if r["product_id"] != "nostock"}
    found = {r["product_id"]: (r["level"], r["trend"]) for r in trend.holt_scan(trend.daily_demand(rows), 0.4, 0.2, bucket).collect()}
    found.pop("nostock")
    assert set(found) == set(expected)
    for p, state in expected.items():
        assert found[p] == pytest.approx(state, rel=1e-9, abs=1e-9)


def test_demand_equals_that_of_the_series(spark):
    rows = spark.createDataFrame(history(2, 2, 30), HISTORY)
    series = inventory.with_seasonal_index(inventory.daily_series(rows)).collect()
    expected = {
        (s["product_id"], d["date"]): d["units"] / (s["seasonal_index"][d["weekday"]] or 1.0) for s in series for d in s["days"]
    }
    found = {(r["product_id"], r["date"]): r["demand"] for r in trend.daily_demand(rows).collect()}
    assert found == pytest.approx(expected)


def test_no_days(spark):
    assert trend.holt_scan(trend.daily_demand(spark.createDataFrame([], HISTORY))).count() == 0


def test_arrays_stay_short(spark):
    rows = spark.createDataFrame([("p", datetime.date(2000, 1, 1) + datetime.timedelta(days=i), i % 7, 5, i % 11 == 0) for i in range(2_000)], HISTORY)
    found = trend.holt_scan(trend.daily_demand(rows), bucket=4).first()
    folded = inventory.with_holt(inventory.with_seasonal_index(inventory.daily_series(rows))).first()
    assert (found["level"], found["trend"]) == pytest.approx((folded["level"], folded["trend"]), rel=1e-9)
