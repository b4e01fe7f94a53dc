"""Rule-based fraud scores of transactions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.scores import (
    new_account_high_value,
    region_risk,
    velocity_indicator,
    weighted_sum,
)
from shelfwise.sources.shared import write_shared

BUCKET_WINDOWS = 4


def micros(timestamp: Column) -> Column:
    """Microseconds of a zone-less timestamp, whatever the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, timestamp.cast("timestamp_ntz"))


def nearby_counts(transactions: DataFrame, minutes: int = fixed.VELOCITY_MINUTES) -> DataFrame:
    """Other transactions of the same buyer within ``minutes`` before or after, both ends included.

    Returns ``(buyer_id, created_at, nearby)``, one row per buyer and moment. Transactions are first
    counted per buyer and moment, with a partial count before the shuffle. Time is then cut into buckets
    of a few window lengths, and a moment close to an edge also goes to the bucket beyond it. The frames
    thus run per buyer and bucket: a buyer with a third of all rows spreads over all buckets.

    The count around a moment is what lies up to its end of the window less what lies before its start. Both
    frames only grow, so Spark adds each row once; a frame that slides would be summed anew for every row.
    """
    reach = minutes * 60 * 1_000_000
    width = reach * BUCKET_WINDOWS
    moments = (
        transactions.groupBy("buyer_id", "created_at")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("us", micros(F.col("created_at")))
    )
    first, last = F.floor((F.col("us") - reach) / width), F.floor((F.col("us") + reach) / width)
    order = Window.partitionBy("buyer_id", "bucket").orderBy("us")
    up_to_end = F.sum("n").over(order.rangeBetween(Window.unboundedPreceding, reach))
    before_start = F.sum("n").over(order.rangeBetween(Window.unboundedPreceding, -reach - 1))
    return (
        moments.withColumn("bucket", F.explode_outer(F.sequence(first, last)))
        .withColumn("nearby", up_to_end - F.coalesce(before_start, F.lit(0)) - 1)
        .where(F.col("bucket") == F.floor(F.col("us") / width))
        .select("buyer_id", "created_at", "nearby")
    )


def velocity(transactions: DataFrame, minutes: int = fixed.VELOCITY_MINUTES) -> DataFrame:
    """Transactions with ``nearby`` and the velocity indicator in [0, 1]."""
    counts = nearby_counts(transactions, minutes)
    return (
        transactions.join(counts, ["buyer_id", "created_at"], "left")
        .withColumn("nearby", F.coalesce("nearby", F.lit(0)))
        .withColumn("velocity", velocity_indicator(F.col("nearby")))
    )


def score_fraud(
    transactions: DataFrame,
    minutes: int = fixed.VELOCITY_MINUTES,
    weights: Mapping[str, float] = fixed.FRAUD_WEIGHTS,
    threshold: float = fixed.FRAUD_THRESHOLD,
    new_account_days: int = fixed.NEW_ACCOUNT_DAYS,
    high_value: float = fixed.HIGH_VALUE_AMOUNT,
    digits: int | None = 3,
) -> DataFrame:
    """Transactions with the three indicators, ``fraud_score`` and ``likely_fraud``."""
    age = F.col("buyer_account_age_days")
    return (
        velocity(transactions, minutes)
        .withColumn(
            "region_risk",
            region_risk(F.col("shipping_region"), F.col("billing_region"), age, new_account_days),
        )
        .withColumn(
            "new_account_high_value",
            new_account_high_value(age, F.col("amount"), new_account_days, high_value),
        )
        .withColumn(
            "fraud_score",
            weighted_sum([F.col(name) for name in weights], list(weights.values()), digits),
        )
        .withColumn("likely_fraud", F.col("fraud_score") >= threshold)
    )


def fraud_scores_table(scored: DataFrame) -> DataFrame:
    """The published shape: id, score, flag and the nested indicators."""
    return scored.select(
        F.col("id").alias("transaction_id"),
        "fraud_score",
        "likely_fraud",
        F.struct("velocity", "region_risk", "new_account_high_value").alias("indicators"),
    )


def fraud_report(transactions: DataFrame, scores: DataFrame, limit: int = fixed.FRAUD_REPORT_ROWS) -> DataFrame:
    """The transactions with the highest scores; one without a score counts as 0."""
    order = [F.coalesce("fraud_score", F.lit(0.0)).desc(), F.asc("id")]
    named = scores.select(F.col("transaction_id").alias("id"), "fraud_score", "likely_fraud")
    # scores above 0 come before everything without a score: the report needs no other join if they fill it
    first = write_shared(named.filter("fraud_score > 0").orderBy(*order).limit(limit), "top_scores")
    found = write_shared(transactions.join(F.broadcast(first), "id").orderBy(*order).limit(limit), "report")
    if found.count() == limit:
        return found.orderBy(*order)
    # ranked on two columns; the others are fetched for the ``limit`` rows of the report alone
    top = transactions.select("id").join(named, "id", "left").orderBy(*order).limit(limit)
    return transactions.join(F.broadcast(top), "id").orderBy(*order)
