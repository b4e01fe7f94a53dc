"""Session defaults for local runs and tests; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

from shelfwise.sources.shared import CHECKPOINT_DIR


def local_session(cores: int | str = "*", name: str = "shelfwise") -> SparkSession:
    """A session on this machine; its shared folder is a temporary one unless the surroundings name another."""
    partitions = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SHELFWISE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
    )
    if not SparkConf().contains(CHECKPOINT_DIR):
        builder = builder.config(CHECKPOINT_DIR, tempfile.mkdtemp(prefix="shelfwise-"))
    return builder.getOrCreate()
