"""Level and trend of long series as an associative scan.

A day of Holt's method turns ``(level, trend)`` into an affine function of itself, so days compose: a day seen gives

    level' = a d + (1 - a)(level + trend),   trend' = b (level' - level) + (1 - b) trend

and a stockout day ``level' = level + trend, trend' = trend``. Days are composed within time buckets, the buckets'
maps again within larger ones, until one map a product is left; it is applied to the state that the first two days
give. No array holds more than ``BUCKET`` maps, however long the history, and a product's days spread over many tasks.

The result is that of ``plans.inventory.with_holt`` but for the rounding of sums in another order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.sources.shared import write_shared

#: Maps composed at a time.
BUCKET = 64

_PARTS = ("ll", "lt", "tl", "tt", "l", "t")  # level and trend from level and trend, and what is added


def daily_demand(history: DataFrame) -> DataFrame:
    """``product_id, date, demand, stockout``: units of a day over its weekday's factor (``plans.inventory``).

    Sums only: by product and day, then by product and weekday.
    """
    days = history.groupBy("product_id", "date").agg(F.sum("units_sold").cast("double").alias("units"), F.bool_or("stockout").alias("stockout"))
    days = write_shared(days.withColumn("weekday", F.weekday("date")), "days")
    means = days.groupBy("product_id").agg(F.avg("units").alias("mean"), *[F.avg(F.when(F.col("weekday") == k, F.col("units"))).alias(f"m{k}") for k in range(7)])
    base = F.when(F.col("mean") == 0, fixed.NO_DEMAND).otherwise(F.col("mean"))
    factors = means.select("product_id", F.array(*[F.coalesce(F.col(f"m{k}") / base, F.lit(1.0)) for k in range(7)]).alias("factors"))
    factor = F.get("factors", F.col("weekday"))
    joined = days.join(factors, "product_id")
    return joined.select("product_id", "date", (F.col("units") / F.when(factor == 0, 1.0).otherwise(factor)).alias("demand"), "stockout")


def _day_map(alpha: float, beta: float) -> Column:
    """The map of a day."""
    seen = {"ll": 1 - alpha, "lt": 1 - alpha, "tl": -alpha * beta, "tt": 1 - alpha * beta}
    unseen = {"ll": 1.0, "lt": 1.0, "tl": 0.0, "tt": 1.0}
    known = ~F.coalesce(F.col("stockout"), F.lit(False))
    parts = [F.when(known, F.lit(seen[p])).otherwise(F.lit(unseen[p])).alias(p) for p in ("ll", "lt", "tl", "tt")]
    added = [F.when(known, F.lit(alpha) * F.col("demand")).otherwise(0.0).alias("l"), F.when(known, F.lit(alpha * beta) * F.col("demand")).otherwise(0.0).alias("t")]
    return F.struct(*parts, *added)


def _then(first: Column, second: Column) -> Column:
    """The map of ``first`` followed by ``second``."""
    def row(to: str) -> tuple[Column, Column]:
        return second[f"{to}l"], second[f"{to}t"]

    out = []
    for to in ("l", "t"):
        by_level, by_trend = row(to)
        out += [(by_level * first["ll"] + by_trend * first["tl"]).alias(f"{to}l"), (by_level * first["lt"] + by_trend * first["tt"]).alias(f"{to}t")]
    added = [(row(to)[0] * first["l"] + row(to)[1] * first["t"] + second[to]).alias(to) for to in ("l", "t")]
    return F.struct(*out, *added)


def _identity() -> Column:
    values = {"ll": 1.0, "lt": 0.0, "tl": 0.0, "tt": 1.0, "l": 0.0, "t": 0.0}
    return F.struct(*[F.lit(values[p]).alias(p) for p in _PARTS])


def holt_scan(days: DataFrame, alpha: float = fixed.HOLT_ALPHA, beta: float = fixed.HOLT_BETA, bucket: int = BUCKET) -> DataFrame:
    """``product_id, level, trend`` after the last of ``days(product_id, date, demand, stockout)``, one row a product and day.

    The first day always counts as seen; a series of one day has trend 0.
    """
    days = write_shared(days.select("product_id", "date", "demand", "stockout"), "days")
    first = write_shared(days.groupBy("product_id").agg(F.min(F.struct("date", "demand")).alias("first")), "first")
    rest = days.join(first, "product_id").filter(F.col("date") > F.col("first.date"))
    second = rest.groupBy("product_id").agg(F.min(F.struct("date", "demand")).alias("second"))
    # days are numbered by the calendar: gaps leave buckets with fewer maps, not with other ones
    number = F.date_diff("date", F.col("first.date")).cast("long")
    maps = rest.select("product_id", number.alias("at"), _day_map(alpha, beta).alias("map"))
    span = rest.agg(F.max(F.date_diff("date", F.col("first.date")))).first()[0] or 0
    while span >= 1:
        gathered = maps.groupBy("product_id", F.floor(F.col("at") / bucket).alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "map"))).alias("held"))
        maps = gathered.select("product_id", "at", F.aggregate("held", _identity(), lambda state, one: _then(state, one["map"])).alias("map"))
        span //= bucket
    state = first.join(second, "product_id", "left").join(maps.drop("at"), "product_id", "left")
    level = F.col("first.demand")
    trend = F.coalesce(F.col("second.demand") - level, F.lit(0.0))
    whole = F.coalesce("map", _identity())
    return state.select(
        "product_id",
        (whole["ll"] * level + whole["lt"] * trend + whole["l"]).alias("level"),
        (whole["tl"] * level + whole["tt"] * trend + whole["t"]).alias("trend"),
    )
