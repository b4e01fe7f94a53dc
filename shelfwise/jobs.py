"""The offline jobs: read stored tables, write result tables and a manifest each.

Every job takes the folder of its inputs and the folder for its results. Inputs are read as ``fmt``
(``json`` for one array per file, ``jsonl``, or ``parquet``), results are Parquet unless ``out_fmt`` says
otherwise. What several results are computed from is written once to the shared folder of the session.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.text import Lexicon, embedding_text
from shelfwise.operators.embed import Encoder, embed_products, hashed_encoder
from shelfwise.operators.evaluate import evaluate_flags
from shelfwise.plans.fraud import fraud_scores_table, score_fraud
from shelfwise.plans.inventory import forecast_inventory, reorder_count
from shelfwise.plans.pricing import label_counts, price_products
from shelfwise.plans.reviews import analyze_reviews, summarize_products
from shelfwise.plans.search import build_index, index_figures
from shelfwise.sources.shared import write_shared
from shelfwise.sources.tables import columnar_embeddings, read_table, run_manifest, write_table


def _input(spark: SparkSession, folder: str, name: str, fmt: str) -> DataFrame:
    suffix = {"json": ".json", "jsonl": ".jsonl"}.get(fmt, "")
    return read_table(spark, name, f"{folder}/{name}{suffix}", fmt)


def _n_rows(df: DataFrame):
    return df.agg(F.count(F.lit(1))).scalar()


def review_job(spark: SparkSession, source: str, target: str, fmt: str = "json", out_fmt: str = "parquet") -> None:
    """``review_analysis``, ``product_review_summary`` and ``reviews_manifest``."""
    started = datetime.now(timezone.utc)
    products = _input(spark, source, "products", fmt)
    reviews = _input(spark, source, "reviews", fmt)
    analysis = write_shared(analyze_reviews(reviews, products, keep=["is_fake_synthetic"]), "review_analysis")
    write_table(
        analysis.select("review_id", "product_id", "sentiment_score", "aspects", "fake_score", "likely_fake"),
        f"{target}/review_analysis",
        out_fmt,
    )
    write_table(summarize_products(analysis), f"{target}/product_review_summary", out_fmt, order_by="product_id")
    counts = evaluate_flags(analysis, "likely_fake", "is_fake_synthetic").select(
        "*",
        _n_rows(reviews).alias("num_reviews"),
        _n_rows(products).alias("num_products"),
        F.lit(Lexicon().size).alias("lexicon_size"),
    )
    parameters = {"fake_score_threshold": fixed.FAKE_THRESHOLD, "fake_heuristic_weights": fixed.FAKE_WEIGHTS}
    write_table(run_manifest(counts, parameters, started), f"{target}/reviews_manifest", "json")


def fraud_job(spark: SparkSession, source: str, target: str, fmt: str = "json", out_fmt: str = "parquet") -> None:
    """``fraud_scores`` and ``fraud_manifest``."""
    started = datetime.now(timezone.utc)
    transactions = _input(spark, source, "transactions", fmt)
    scored = write_shared(score_fraud(transactions), "fraud_scores")
    write_table(fraud_scores_table(scored), f"{target}/fraud_scores", out_fmt)
    counts = evaluate_flags(scored, "likely_fraud", "is_fraud_synthetic").select(
        "*", _n_rows(scored).alias("num_transactions")
    )
    parameters = {
        "weights": fixed.FRAUD_WEIGHTS,
        "fraud_score_threshold": fixed.FRAUD_THRESHOLD,
        "velocity_minutes": fixed.VELOCITY_MINUTES,
    }
    write_table(run_manifest(counts, parameters, started), f"{target}/fraud_manifest", "json")


def inventory_job(spark: SparkSession, source: str, target: str, fmt: str = "json", out_fmt: str = "parquet") -> None:
    """``inventory_forecasts`` and ``inventory_manifest``."""
    started = datetime.now(timezone.utc)
    forecasts = write_shared(forecast_inventory(_input(spark, source, "inventory_history", fmt)), "forecasts")
    write_table(forecasts, f"{target}/inventory_forecasts", out_fmt, order_by="product_id")
    parameters = {
        "alpha": fixed.HOLT_ALPHA,
        "beta": fixed.HOLT_BETA,
        "forecast_horizon_days": fixed.HORIZON_DAYS,
        "assumed_lead_time_days": fixed.LEAD_TIME_DAYS,
        "service_level_z": fixed.SERVICE_LEVEL_Z,
    }
    write_table(run_manifest(reorder_count(forecasts), parameters, started), f"{target}/inventory_manifest", "json")


def pricing_job(spark: SparkSession, source: str, target: str, fmt: str = "json", out_fmt: str = "parquet") -> None:
    """``pricing_recommendations`` and ``pricing_manifest``."""
    started = datetime.now(timezone.utc)
    priced = price_products(_input(spark, source, "pricing_inputs", fmt))
    write_table(priced, f"{target}/pricing_recommendations", out_fmt)
    counts = label_counts(priced).groupBy().pivot("recommendation", fixed.PRICE_LABELS).agg(F.first("products"))
    counts = counts.withColumn("num_products", _n_rows(priced))
    parameters = {
        "curve_multipliers": fixed.CURVE_MULTIPLIERS,
        "raise_threshold_pct": fixed.RAISE_PCT,
        "lower_threshold_pct": fixed.LOWER_PCT,
    }
    write_table(run_manifest(counts, parameters, started), f"{target}/pricing_manifest", "json")


def embedding_job(
    spark: SparkSession,
    source: str,
    target: str,
    fmt: str = "json",
    make_encoder: Callable[[], Encoder] = hashed_encoder,
    model: str = "hashed-tokens",
) -> None:
    """``embeddings`` as rows, ``product_embeddings`` as columnar JSON records, and ``embeddings_manifest``."""
    started = datetime.now(timezone.utc)
    write_table(embed_products(_input(spark, source, "products", fmt), make_encoder), f"{target}/embeddings")
    vectors = spark.read.parquet(f"{target}/embeddings")
    write_table(columnar_embeddings(vectors, model), f"{target}/product_embeddings", "json")
    counts = vectors.agg(F.count(F.lit(1)).alias("num_products"), F.max(F.size("vector")).alias("dim"))
    parameters = {"model": model, "embedded_fields": ["title", "description"]}
    write_table(run_manifest(counts, parameters, started), f"{target}/embeddings_manifest", "json")


def search_job(spark: SparkSession, source: str, target: str, fmt: str = "json") -> None:
    """``search_index`` of the products with the vectors of ``target/embeddings``, and ``search_manifest``."""
    started = datetime.now(timezone.utc)
    products = _input(spark, source, "products", fmt)
    texts = products.select("id", embedding_text(F.col("title"), F.col("description")).alias("text"))
    index = build_index(texts, spark.read.parquet(f"{target}/embeddings"), f"{target}/search_index")
    parameters = {"k1": fixed.BM25_K1, "b": fixed.BM25_B, "alpha": fixed.FUSION_ALPHA, "limit": fixed.DEFAULT_LIMIT}
    write_table(run_manifest(index_figures(index), parameters, started), f"{target}/search_manifest", "json")
