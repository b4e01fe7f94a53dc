"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Whether Spark removes a query's shuffle files when it ends, not when the driver's garbage is next collected.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Power of two of the groups that a task sums in the faster of Spark's two tables; 16 without this.
FAST_GROUPS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD_BYTES = 64


def shared_folder(spark: SparkSession) -> str:
    """A new sub-folder of ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, which stays the context's checkpoint
    directory; on a cluster the folder has to be one that all executors reach.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shelfwise-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/shelfwise-{uuid.uuid4().hex}"


@contextmanager
def many_groups(spark: SparkSession, power: int = 20) -> Iterator[None]:
    """For writes that sum by very many keys, a million of them in the faster table; more still go to the other one."""
    before = spark.conf.get(FAST_GROUPS, None)
    spark.conf.set(FAST_GROUPS, str(power))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FAST_GROUPS)
        else:
            spark.conf.set(FAST_GROUPS, before)


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark a frame of plain columns for a broadcast join when its measured size allows it.

    A larger one comes back as it is and Spark shuffles both sides. Worth the count where the other side of
    the join carries long texts.
    """
    widths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
    size = df.agg(F.sum(sum(widths, F.lit(ROW_OVERHEAD_BYTES)))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several later passes read, and continue from the written table.

    The table stands for the frame from then on, so the shuffle files of the write are removed as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
