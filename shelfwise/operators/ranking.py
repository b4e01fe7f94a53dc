"""Second-stage ranking: business boosts and diversification of near-duplicates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.scores import popularity_boost, rating_boost
from shelfwise.functions.text import diversity_key


def rerank(
    candidates: DataFrame,
    limit: int = fixed.DEFAULT_LIMIT,
    weights: Mapping[str, float] = fixed.SEARCH_WEIGHTS,
    max_rating_count: int = fixed.MAX_RATING_COUNT,
) -> DataFrame:
    """Best ``limit`` rows per query of ``(qid, id, base_score, category, title, rating, rating_count)``.

    Every pick lowers the later rows with the same diversity key by the diversity weight, so the r-th best
    row of a key is lowered r - 1 times, whatever else is picked in between. A row behind ``limit`` better
    rows of its own key cannot be picked: both windows therefore keep ``limit`` rows per group already
    before the shuffle, and a key with a third of all rows stays small.
    """
    if min(weights.values()) < 0:
        raise ValueError("ranking weights must not be negative")
    boosted = (
        candidates.withColumn("rating_boost", rating_boost(F.col("rating"), weights["rating"]))
        .withColumn(
            "popularity_boost",
            popularity_boost(F.col("rating_count"), weights["popularity"], max_rating_count),
        )
        .withColumn("final_score", F.col("base_score") + F.col("rating_boost") + F.col("popularity_boost"))
        .withColumn("diversity_key", diversity_key(F.col("category"), F.col("title")))
    )
    within_key = Window.partitionBy("qid", "diversity_key").orderBy(F.desc("final_score"), "id")
    penalty = F.lit(float(weights["diversity"])) * (F.col("_place") - 1)
    picked = (
        boosted.withColumn("_place", F.row_number().over(within_key))
        .where(F.col("_place") <= limit)
        .withColumn("diversity_penalty", penalty)
        .withColumn("adjusted_score", F.col("final_score") - F.col("diversity_penalty"))
    )
    order = Window.partitionBy("qid").orderBy(F.desc("adjusted_score"), "id")
    return (
        picked.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .drop("_place", "diversity_key")
    )
