"""Review analysis: sentiment, aspect opinions, fake-review scores and product summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.rounding import round_exact
from shelfwise.functions.scores import polarity_class, weighted_sum
from shelfwise.functions.text import Lexicon, aspect_opinions, generic_text_score, sentiment
from shelfwise.operators.positions import number_rows
from shelfwise.sources.shared import broadcast_if_small, write_shared

DIGEST_BITS = 256


def text_copies(reviews: DataFrame, body: str = "body", min_copies: int = 1) -> DataFrame:
    """``(digest, copies)`` of the texts that occur at least ``min_copies`` times.

    Only the digest is shuffled, not the text, and a text with a third of all copies is counted down to one
    row per map task before the shuffle.
    """
    return _copies(reviews.select(F.sha2(F.col(body), DIGEST_BITS).alias("digest")), min_copies)


def _copies(digests: DataFrame, min_copies: int) -> DataFrame:
    counts = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    return counts.where(F.col("copies") >= min_copies)


def author_bursts(
    reviews: DataFrame,
    min_reviews: int = fixed.BURST_REVIEWS,
    min_products: int = fixed.BURST_PRODUCTS,
    max_days: int = fixed.BURST_DAYS,
) -> DataFrame:
    """Per author: reviews, distinct products, days from first to last review, and the burst flag.

    The whole history of an author counts, not a sliding window. The distinct count is aggregated per author
    and product first, so a busy author never meets in one task row by row.
    """
    return (
        reviews.groupBy("author", "product_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("created_at").alias("first"),
            F.max("created_at").alias("last"),
        )
        .groupBy("author")
        .agg(
            F.sum("n").alias("reviews"),
            F.count(F.lit(1)).alias("products"),
            F.date_diff(F.max("last"), F.min("first")).alias("span_days"),
        )
        .withColumn(
            "burst",
            (F.col("reviews") >= min_reviews)
            & (F.col("products") >= min_products)
            & (F.col("span_days") <= max_days),
        )
    )


def with_text_scores(
    reviews: DataFrame,
    keywords: Mapping[str, Mapping[str, Sequence[str]]] = fixed.ASPECT_KEYWORDS,
    lexicon: Lexicon = Lexicon(),
    digits: int | None = 3,
) -> DataFrame:
    """Everything that follows from the text of one review and its category, computed in its row."""
    return (
        reviews.withColumn("sentiment_score", round_exact(sentiment(F.col("body"), lexicon), digits))
        .withColumn(
            "aspects", aspect_opinions(F.col("body"), F.col("category"), keywords, lexicon, digits)
        )
        .withColumn("generic_text", generic_text_score(F.col("body"), F.size("aspects") > 0))
        .withColumn("digest", F.sha2("body", DIGEST_BITS))
    )


def analyze_reviews(
    reviews: DataFrame,
    products: DataFrame,
    keywords: Mapping[str, Mapping[str, Sequence[str]]] = fixed.ASPECT_KEYWORDS,
    lexicon: Lexicon = Lexicon(),
    weights: Mapping[str, float] = fixed.FAKE_WEIGHTS,
    threshold: float = fixed.FAKE_THRESHOLD,
    min_copies: int = fixed.DUPLICATE_COPIES,
    burst: Mapping[str, int] | None = None,
    digits: int | None = 3,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per review of a known product: sentiment, aspect map, the three fake indicators, score, flag.

    The text is read once, and not shuffled as long as the categories of the products fit a checked
    broadcast. Its scores and its digest are written to a narrow table, and the copy counts, the author bursts
    and the joins work on that. Both joined sides hold only the flagged keys, one row each, and Spark picks the
    join by their measured size. ``keep`` names review columns to carry along.
    """
    categories = broadcast_if_small(products.select(F.col("id").alias("product_id"), "category"))
    scored = write_shared(
        with_text_scores(reviews.join(categories, "product_id", "left"), keywords, lexicon, digits).select(
            F.col("id").alias("review_id"),
            "product_id",
            "category",
            "author",
            "created_at",
            "sentiment_score",
            "aspects",
            "generic_text",
            "digest",
            *keep,
        ),
        "review_scores",
    )
    copied = _copies(scored, min_copies).select("digest", F.lit(1.0).alias("duplicate_text"))
    bursting = author_bursts(scored, **(burst or {})).where("burst")
    bursting = bursting.select("author", F.lit(1.0).alias("author_burst"))
    return (
        scored.where("category is not null")
        .join(copied, "digest", "left")
        .join(bursting, "author", "left")
        .fillna(0.0, ["duplicate_text", "author_burst"])
        .withColumn(
            "fake_score", weighted_sum([F.col(name) for name in weights], list(weights.values()), digits)
        )
        .withColumn("likely_fake", F.col("fake_score") >= threshold)
        .drop("digest", "category", "created_at")
    )


def summarize_products(analysis: DataFrame, digits: int | None = 3) -> DataFrame:
    """One row per product with its mean sentiment and aspects, taken over the reviews that are not likely
    fake, or over all of them where every one is.

    A review becomes one row for itself and one per aspect; both pools are summed per (product, aspect)
    before the shuffle. What is then gathered per product is one entry per aspect name.
    """
    genuine = ~F.col("likely_fake")
    own = F.struct(F.lit(None).cast("string").alias("key"), F.col("sentiment_score").alias("value"))
    per_aspect = (
        analysis.select(
            "product_id",
            "likely_fake",
            F.inline_outer(F.concat(F.array(own), F.map_entries("aspects"))).alias("aspect", "score"),
        )
        .groupBy("product_id", "aspect")
        .agg(
            F.sum("score").alias("all_sum"),
            F.count(F.lit(1)).alias("all_n"),
            F.coalesce(F.sum(F.when(genuine, F.col("score"))), F.lit(0.0)).alias("genuine_sum"),
            F.count_if(genuine).alias("genuine_n"),
        )
    )
    totals = F.max(F.when(F.col("aspect").isNull(), F.struct("all_sum", "all_n", "genuine_sum", "genuine_n")))
    aspects = F.collect_list(
        F.when(
            F.col("aspect").isNotNull(), F.struct("aspect", "all_sum", "all_n", "genuine_sum", "genuine_n")
        )
    )
    only_fake = F.col("total.genuine_n") == 0

    def pooled(entry, side: str):
        return F.when(only_fake, entry[f"all_{side}"]).otherwise(entry[f"genuine_{side}"])

    listed = F.transform(
        F.filter("found", lambda a: pooled(a, "n") > 0),
        lambda a: F.struct(
            (-pooled(a, "n")).alias("order"),
            a["aspect"].alias("aspect"),
            round_exact(pooled(a, "sum") / pooled(a, "n"), digits).alias("avg_sentiment"),
            pooled(a, "n").alias("mentions"),
        ),
    )
    total = F.col("total")
    return (
        per_aspect.groupBy("product_id")
        .agg(totals.alias("total"), aspects.alias("found"))
        .select(
            "product_id",
            total["all_n"].alias("review_count"),
            round_exact(pooled(total, "sum") / pooled(total, "n"), digits).alias("avg_sentiment"),
            F.transform(
                F.sort_array(listed),
                lambda a: F.struct(
                    a["aspect"].alias("aspect"),
                    a["avg_sentiment"].alias("avg_sentiment"),
                    a["mentions"].alias("mentions"),
                ),
            ).alias("aspects"),
            (total["all_n"] - total["genuine_n"]).alias("likely_fake_count"),
        )
    )


def aspect_badges(summaries: DataFrame) -> DataFrame:
    """Aspects as rows in display order, with their polarity class."""
    listed = summaries.select("product_id", F.posexplode_outer("aspects").alias("position", "entry"))
    return listed.where("position is not null").select(
        "product_id", "position", "entry.*", polarity_class(F.col("entry.avg_sentiment")).alias("polarity")
    )


def product_reviews(reviews: DataFrame, analysis: DataFrame, product_id=None) -> DataFrame:
    """Reviews with their analysis where there is one, most helpful first, for one product or for all."""
    wanted = reviews if product_id is None else reviews.where(F.col("product_id") == product_id)
    scores = analysis.select(
        F.col("review_id").alias("id"), "sentiment_score", "aspects", "fake_score", "likely_fake"
    )
    return wanted.join(scores, "id", "left").orderBy("product_id", F.desc("helpful_votes"), "id")


def review_positions(reviews: DataFrame) -> DataFrame:
    """Reviews with their ``position`` in the order of ``product_reviews`` over all products."""
    return number_rows(reviews, [F.asc("product_id"), F.desc("helpful_votes"), F.asc("id")])
