"""Global numbers of rows without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.sources.shared import write_shared

_ROWS_BITS = 33  # of monotonically_increasing_id: the partition stands above them, the row in it below


def number_rows(rows: DataFrame, order: Sequence[Column] = (), name: str = "position", first: int = 1) -> DataFrame:
    """``rows`` with a gapless number, in the order given or, without one, in any.

    The rows are dealt by range and sorted in their partition, and written with the partition's number and their
    place in it. One count per partition, summed up in their order, turns places into global numbers. Ties in
    ``order`` get distinct numbers; give a unique last key where the numbers must not depend on the run. The order
    keys may be descending and may put nulls first or last.
    """
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = F.monotonically_increasing_id()
    placed = write_shared(
        rows.withColumn("_part", F.shiftright(numbered, _ROWS_BITS)).withColumn("_at", numbered.bitwiseAND((1 << _ROWS_BITS) - 1)),
        "numbered",
    )
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # one row per partition of the table
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_at") + first
    return placed.join(F.broadcast(starts), "_part").withColumn(name, number).drop("_part", "_at", "_start")
