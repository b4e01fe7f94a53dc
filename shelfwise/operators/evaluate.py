"""Confusion matrix of a flag against known labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.rounding import round_exact


def evaluate_flags(df: DataFrame, flag: str, truth: str, digits: int | None = 3) -> DataFrame:
    """One row with the four counts, precision, recall and F1; an undefined ratio is 0."""
    flagged, true = F.col(flag), F.col(truth)
    counts = df.agg(
        F.count_if(flagged & true).alias("true_positives"),
        F.count_if(flagged & ~true).alias("false_positives"),
        F.count_if(~flagged & true).alias("false_negatives"),
        F.count_if(~flagged & ~true).alias("true_negatives"),
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    tp = F.col("true_positives")
    ratios = counts.withColumn("precision", ratio(tp, tp + F.col("false_positives"))).withColumn(
        "recall", ratio(tp, tp + F.col("false_negatives"))
    )
    precision, recall = F.col("precision"), F.col("recall")
    return (
        ratios.withColumn("f1", ratio(2 * precision * recall, precision + recall))
        .withColumn("precision", round_exact(precision, digits))
        .withColumn("recall", round_exact(recall, digits))
        .withColumn("f1", round_exact(F.col("f1"), digits))
    )
