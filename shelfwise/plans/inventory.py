"""Demand forecast and reorder points from daily inventory history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.rounding import round_exact
from shelfwise.functions.text import bind, mean_of


def daily_series(history: DataFrame) -> DataFrame:
    """One row per product with its days in order.

    Rows are combined per product and day first, with a partial step before the shuffle; for a table that
    already has one row per product and day this changes nothing. A series is then bounded by the number
    of days in the history, however many rows a product has.
    """
    days = history.groupBy("product_id", "date").agg(
        F.sum("units_sold").cast("double").alias("units"),
        F.max("stock_level").alias("stock"),
        F.bool_or("stockout").alias("stockout"),
    )
    weekday = F.weekday("date")
    day = F.struct("date", weekday.alias("weekday"), "units", "stock", "stockout")
    weekday_means = [F.avg(F.when(weekday == k, F.col("units"))) for k in range(7)]
    return days.groupBy("product_id").agg(
        F.sort_array(F.collect_list(day)).alias("days"),
        F.avg("units").alias("mean"),
        F.array(*weekday_means).alias("weekday_means"),
        F.stddev_pop("units").alias("std_dev"),
        F.count_if("stockout").alias("stockout_days_observed"),
    )


def with_seasonal_index(series: DataFrame) -> DataFrame:
    """Adds ``seasonal_index``: seven factors from Monday on, mean units of the weekday over the mean of
    all days; 1 for a weekday without a day."""
    base = F.when(F.col("mean") == 0, fixed.NO_DEMAND).otherwise(F.col("mean"))
    return series.withColumn(
        "seasonal_index", F.transform("weekday_means", lambda m: F.coalesce(m / base, F.lit(1.0)))
    )


def with_holt(series: DataFrame, alpha: float = fixed.HOLT_ALPHA, beta: float = fixed.HOLT_BETA) -> DataFrame:
    """Adds ``level`` and ``trend`` of the deseasonalised series.

    A stockout day only shows what was in stock, so the running estimate takes its place. The first day
    has no estimate yet and always counts as observed.
    """

    def deseasonalised(index: Column) -> Column:
        def one(day: Column) -> Column:
            factor = F.get(index, day["weekday"])
            demand = day["units"] / F.when(factor == 0, 1.0).otherwise(factor)
            return F.struct(demand.alias("demand"), day["stockout"].alias("stockout"))

        return F.transform("days", one)

    def update(state: Column, day: Column) -> Column:
        estimate = state["level"] + state["trend"]
        seen = F.when(day["stockout"], estimate).otherwise(day["demand"])
        level = alpha * seen + (1 - alpha) * estimate
        trend = beta * (level - state["level"]) + (1 - beta) * state["trend"]
        return F.struct(level.alias("level"), trend.alias("trend"))

    demand = series.withColumn("_demand", bind(F.col("seasonal_index"), deseasonalised))
    first = F.get("_demand", F.lit(0))["demand"]
    second = F.get("_demand", F.lit(1))["demand"]
    start = F.struct(first.alias("level"), F.coalesce(second - first, F.lit(0.0)).alias("trend"))
    rest = F.slice("_demand", F.lit(2), F.greatest(F.size("_demand") - 1, F.lit(0)))
    return (
        demand.withColumn("_state", F.aggregate(rest, start, update))
        .withColumn("level", F.col("_state.level"))
        .withColumn("trend", F.col("_state.trend"))
        .drop("_demand", "_state")
    )


def forecast_inventory(
    history: DataFrame,
    alpha: float = fixed.HOLT_ALPHA,
    beta: float = fixed.HOLT_BETA,
    horizon_days: int = fixed.HORIZON_DAYS,
    lead_time_days: int = fixed.LEAD_TIME_DAYS,
    service_level_z: float = fixed.SERVICE_LEVEL_Z,
    rounded: bool = True,
) -> DataFrame:
    """``history(product_id, date, units_sold, stock_level, stockout)`` to one forecast row per product.

    Endless supply, where no demand is expected, is written as -1.
    """
    series = with_holt(with_seasonal_index(daily_series(history)), alpha, beta)
    last = F.element_at("days", -1)

    def ahead(index: Column) -> Column:
        def day(h: Column) -> Column:
            factor = F.get(index, F.pmod(last["weekday"] + h, F.lit(7)))
            return F.greatest(F.lit(0.0), (F.col("level") + h * F.col("trend")) * factor)

        return F.transform(F.sequence(F.lit(1), F.lit(horizon_days)), day)

    forecast = bind(bind(F.col("seasonal_index"), ahead), mean_of)
    demand, point, stock = F.col("_demand"), F.col("_point"), F.col("current_stock")
    two, one = (2, 1) if rounded else (None, None)
    return (
        series.withColumn("_demand", forecast)
        .withColumn("current_stock", last["stock"])
        .withColumn(
            "_point",
            demand * lead_time_days + service_level_z * F.col("std_dev") * F.sqrt(F.lit(float(lead_time_days))),
        )
        .select(
            "product_id",
            "current_stock",
            round_exact(demand, two).alias("avg_daily_forecast"),
            F.lit(horizon_days).alias("forecast_horizon_days"),
            round_exact(F.col("std_dev"), two).alias("demand_std_dev"),
            round_exact(point, one).alias("reorder_point"),
            F.when(demand > fixed.NO_DEMAND, round_exact(F.try_divide(stock, demand), one))
            .otherwise(-1.0)
            .alias("days_of_supply"),
            (stock <= point).alias("needs_reorder"),
            "stockout_days_observed",
        )
    )


def reorder_count(forecasts: DataFrame) -> DataFrame:
    return forecasts.agg(
        F.count(F.lit(1)).alias("num_products"),
        F.count_if("needs_reorder").alias("num_products_needing_reorder"),
    )


def supply_report(
    forecasts: DataFrame,
    products: DataFrame,
    limit: int = fixed.INVENTORY_REPORT_ROWS,
    endless_last: bool = False,
) -> DataFrame:
    """The products that run out first. Endless supply is -1 and sorts first unless ``endless_last``."""
    order = [F.asc("days_of_supply"), F.asc("product_id")]
    if endless_last:
        order.insert(0, (F.col("days_of_supply") < 0).asc())
    # a unique id, so the join cannot change which rows come first: it needs the ``limit`` first ones alone
    top = forecasts.orderBy(*order).limit(limit)
    named = products.withColumnRenamed("id", "product_id").join(F.broadcast(top.select("product_id")), "product_id", "left_semi")
    return top.join(named, "product_id", "left").orderBy(*order)
