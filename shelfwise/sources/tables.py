"""Reading and writing the domain tables: JSON at the edges, Parquet in between."""

from __future__ import annotations

import json
import platform
from collections.abc import Iterable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.sources.schemas import ATTRIBUTION_MAP, SCHEMAS


MAX_SPREAD_PARTITIONS = 64
#: Rows that a task groups at a time.
GROUPED_ROWS = 400_000


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "json") -> DataFrame:
    """Scan a domain table with its fixed schema.

    ``json`` is one JSON array per file, ``jsonl`` one record per line (splittable), ``parquet`` columnar.
    """
    reader = spark.read.schema(SCHEMAS[name]).option("mode", "FAILFAST")
    if fmt == "json":
        return reader.option("multiLine", True).json(path)
    return reader.json(path) if fmt == "jsonl" else reader.parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy work on a small input at least one partition per core.

    Only an input of fewer than ``MAX_SPREAD_PARTITIONS`` partitions is shuffled, whatever the number of cores: at
    128 MB each that is at most 8 GB.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= min(cores, MAX_SPREAD_PARTITIONS) else df.repartition(cores, key)


def deal(df: DataFrame, *keys: str, rows: int = GROUPED_ROWS) -> DataFrame:
    """Rows of equal keys together, about ``rows`` in a partition, for a grouping that meets nearly as many keys as rows.

    The partitions grow in number with the table, not in size; adaptive execution joins none of them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), *keys)


def read_embeddings(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Columnar embedding records (parallel ``ids`` and ``vectors``) as one row per item."""
    artifact = read_table(spark, "product_embeddings", path, fmt)
    pairs = F.inline(F.arrays_zip("ids", "vectors")).alias("id", "vector")
    return artifact.select(pairs)


def columnar_embeddings(vectors: DataFrame, model: str, max_items: int = 1_000) -> DataFrame:
    """``vectors(id, vector)`` as columnar records of about ``max_items`` items, so no record grows with the
    table; ``read_embeddings`` takes one record or many."""
    records = -(-vectors.count() // max_items)
    item = F.struct("id", "vector")
    return (
        vectors.groupBy(F.pmod(F.xxhash64("id"), F.lit(max(records, 1))).alias("record"))
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select(
            F.lit(model).alias("model"),
            F.size(F.get("items", F.lit(0))["vector"]).alias("dim"),
            F.col("items.id").alias("ids"),
            F.col("items.vector").alias("vectors"),
        )
    )


def attribution_entries(documents: DataFrame) -> DataFrame:
    """``documents(value)``, JSON objects keyed by noun, to one row per entry with its position."""
    entries = F.posexplode(F.map_entries(F.from_json("value", ATTRIBUTION_MAP))).alias("position", "entry")
    return documents.select(entries).select("position", F.col("entry.key").alias("noun"), "entry.value.*")


def read_attribution(spark: SparkSession, path: str) -> DataFrame:
    return attribution_entries(spark.read.text(path, wholetext=True))


def write_attribution(entries: DataFrame, path: str) -> None:
    """Entries as the keyed JSON that ``read_attribution`` reads, in the order of their nouns.

    A noun has one entry in a file. Where ``nouns_with_products`` cut a noun's products into several entries, those are in
    further files.
    """
    fields = ["commons_title", "source_url", "artist", "license", "license_url", "extension"]
    entry = F.struct(*fields, F.col("product_ids").cast("array<string>").alias("product_ids")).alias("entry")
    part = F.row_number().over(Window.partitionBy("noun").orderBy(F.get("product_ids", F.lit(0))))
    numbered = entries.withColumn("part", part).select("part", "noun", entry)
    documents = numbered.groupBy("part").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("noun", "entry"))))).alias("value"))
    documents.repartition("part").write.mode("overwrite").partitionBy("part").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The one object of a manifest file as a one-row frame, or ``None`` when there is no file."""
    if not _exists(spark, path):
        return None
    return spark.read.option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", order_by: str | None = None) -> None:
    """Write a result table. ``order_by`` sorts for the export only."""
    ordered = df if order_by is None else df.orderBy(order_by)
    writer = ordered.write.mode("overwrite")
    writer.json(path) if fmt == "json" else writer.parquet(path)


def file_positions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a sorted Parquet export with their ``position`` in it, from 1: by the files' names, then by their rows."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each file
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = rows.join(F.broadcast(starts), "_file").withColumn("position", F.col("_start") + F.col("_row") + 1)
    return placed.drop("_file", "_row", "_start")


def run_manifest(counts: DataFrame, parameters: Mapping[str, object], started_at: datetime | None = None) -> DataFrame:
    """One row that describes a run: the figures of the one-row frame ``counts``, the parameters, the time.

    The figures stay lazy; writing the manifest computes them.
    """
    now = datetime.now(timezone.utc)
    seconds = F.lit(None).cast("double") if started_at is None else F.lit((now - started_at).total_seconds())
    return counts.select(
        "*",
        F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters"),
        F.lit((started_at or now).isoformat()).alias("generated_at"),
        seconds.alias("build_duration_seconds"),
        F.lit(platform.python_version()).alias("python_version"),
    )


def publish(
    spark: SparkSession,
    sources: Mapping[str, str],
    destination: str,
    fmt: str = "parquet",
    optional: Iterable[str] = (),
    formats: Mapping[str, str] | None = None,
) -> list[str]:
    """Copy stored tables to one place under their own names and return the names that were written.

    ``sources`` maps a name to a path, ``formats`` a name to ``json`` where that path holds JSON lines, such as a manifest;
    those stay JSON, the Parquet ones are written as ``fmt``. All required sources are checked before the first is written.
    """
    formats = formats or {}
    skippable = set(optional)
    present = {name: _exists(spark, path) for name, path in sources.items()}
    missing = [name for name, found in present.items() if not found and name not in skippable]
    if missing:
        raise FileNotFoundError(f"no table at {', '.join(sources[name] for name in missing)}")
    written = [name for name, found in present.items() if found]
    for name in written:
        if formats.get(name) == "json":
            write_table(spark.read.json(sources[name]), f"{destination}/{name}", "json")
        else:
            write_table(spark.read.parquet(sources[name]), f"{destination}/{name}", fmt)
    return written
