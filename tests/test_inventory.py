import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from registry import views
from shelfwise.plans import inventory
from shelfwise.sources import tables

MONDAY = date(2026, 1, 5)
SCHEMA = "product_id string, date date, units_sold int, stock_level int, stockout boolean"


def history(spark, units, stockouts=(), stock=50, product="p", step=1):
    rows = [
        (product, MONDAY + timedelta(days=i * step), u, stock - i, i in stockouts) for i, u in enumerate(units)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def loop(units, stockouts=(), alpha=0.3, beta=0.1):
    """Level, trend and mean 14-day forecast of a gapless series that starts on a Monday."""
    mean = statistics.fmean(units) or 1e-6
    index = []
    for weekday in range(7):
        same = units[weekday::7]
        index.append(statistics.fmean(same) / mean if same else 1.0)
    demand = [u / (index[i % 7] or 1.0) for i, u in enumerate(units)]
    level, trend = demand[0], demand[1] - demand[0] if len(demand) > 1 else 0.0
    for i in range(1, len(demand)):
        seen = level + trend if i in stockouts else demand[i]
        level, before = alpha * seen + (1 - alpha) * (level + trend), level
        trend = beta * (level - before) + (1 - beta) * trend
    ahead = [max(0.0, (level + h * trend) * index[(len(units) - 1 + h) % 7]) for h in range(1, 15)]
    return level, trend, statistics.fmean(ahead)


@pytest.mark.parametrize("stockouts", [(), (0,), (1,), (3, 4, 5)])
def test_forecast_equals_a_plain_loop(spark, stockouts):
    rng = random.Random(len(stockouts))
    units = [rng.randint(0, 30) for _ in range(41)]
    frame = history(spark, units, stockouts)
    level, trend, mean = loop(units, stockouts)
    state = inventory.with_holt(inventory.with_seasonal_index(inventory.daily_series(frame))).first()
    assert (state["level"], state["trend"]) == (level, trend)
    row = inventory.forecast_inventory(frame).first()
    assert row["avg_daily_forecast"] == round(mean, 2)
    assert row["demand_std_dev"] == round(statistics.pstdev(units), 2)
    point = mean * 7 + 1.65 * statistics.pstdev(units) * 7**0.5
    assert row["reorder_point"] == round(point, 1)
    assert row["current_stock"] == 10 and row["needs_reorder"] == (10 <= point)
    assert row["days_of_supply"] == round(10 / mean, 1)
    assert row["stockout_days_observed"] == len(stockouts)


def test_one_and_two_day_series(spark):
    one = inventory.with_holt(inventory.with_seasonal_index(inventory.daily_series(history(spark, [6])))).first()
    assert (one["level"], one["trend"]) == (6.0, 0.0)
    assert one["seasonal_index"] == [1.0] * 7
    assert inventory.forecast_inventory(history(spark, [6])).first()["avg_daily_forecast"] == 6.0
    level, trend, _ = loop([4, 8])
    two = inventory.with_holt(inventory.with_seasonal_index(inventory.daily_series(history(spark, [4, 8])))).first()
    assert (two["level"], two["trend"]) == (level, trend)


def test_missing_weekday_counts_as_average(spark):
    # every second day for three days: Monday, Wednesday, Friday
    row = inventory.with_seasonal_index(inventory.daily_series(history(spark, [2, 4, 6], step=2))).first()
    assert row["seasonal_index"] == [0.5, 1.0, 1.0, 1.0, 1.5, 1.0, 1.0]


def test_no_sales_mean_endless_supply(spark):
    row = inventory.forecast_inventory(history(spark, [0] * 14)).first()
    assert row["days_of_supply"] == -1 and row["avg_daily_forecast"] == 0 and not row["needs_reorder"]


def test_rows_of_one_day_are_combined(spark):
    twice = history(spark, [3, 5]).unionAll(history(spark, [1, 0]))
    units = [d["units"] for d in inventory.daily_series(twice).first()["days"]]
    assert units == [4.0, 5.0]


def test_report_order(spark):
    rows = [("a", 3.0), ("b", -1.0), ("c", 1.0)]
    forecasts = spark.createDataFrame(rows, "product_id string, days_of_supply double")
    products = spark.createDataFrame([("a", "x")], "id string, title string")
    listed = inventory.supply_report(forecasts, products).collect()
    assert [(r["product_id"], r["title"]) for r in listed] == [("b", None), ("c", None), ("a", "x")]
    last = inventory.supply_report(forecasts, products, 2, endless_last=True).collect()
    assert [r["product_id"] for r in last] == ["c", "a"]


def test_reorder_count(spark):
    frame = spark.createDataFrame([(True,), (False,), (True,)], "needs_reorder boolean")
    assert tuple(inventory.reorder_count(frame).first()) == (3, 2)


def test_days_are_grouped_in_partitions_by_number_of_rows(spark, tmp_path, monkeypatch):
    """The rows of a day lie together from the start: no task's share grows with the table."""
    lines = [(p, datetime(2024, 1, 1 + d), 1.0 + d, "R" if p == d else "N") for p in range(6) for d in range(5) for _ in range(2)]
    folder = tmp_path / "in"
    schema = "l_partkey long, l_shipdate timestamp, l_quantity double, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(str(folder / "lineitem.parquet"))
    monkeypatch.setattr(tables.deal, "__kwdefaults__", {"rows": 5})
    days = views.inventory_history(spark, str(folder)).groupBy("product_id", "date").agg(F.sum("units_sold").alias("units"))
    assert days.rdd.getNumPartitions() == 12
    found = {(r["product_id"], r["date"].day): r["units"] for r in days.collect()}
    assert found == {(p, 1 + d): 2 + 2 * d for p in range(6) for d in range(5)}
