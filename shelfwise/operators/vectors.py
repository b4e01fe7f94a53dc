"""Exact nearest neighbours by cosine over unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.operators import blocks
from shelfwise.sources.shared import broadcast_if_small

# Scores are rounded this far before they are ranked, so that rows with the same content tie on every
# partitioning and the id decides.
RANK_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays in double precision; cosine when both are unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def top_per_query(scored: DataFrame, score: str, limit: int) -> DataFrame:
    """Rank the rows of each query by score, then id, and keep the first ``limit``."""
    order = Window.partitionBy("qid").orderBy(F.desc(score), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def nearest(
    vectors: DataFrame,
    targets: DataFrame,
    limit: int = fixed.NEIGHBOUR_LIMIT,
    exclude_self: bool = True,
    max_queries: int = blocks.MAX_SHIPPED_QUERIES,
    max_cell_rows: int = blocks.MAX_CELL_ROWS,
) -> DataFrame:
    """Best ``limit`` rows of ``vectors(id, vector)`` for each row of ``targets(qid, vector)``."""

    def work(batches: Iterator[pa.RecordBatch], queries: pa.Table) -> Iterator[pa.RecordBatch]:
        if not queries.num_rows:
            return
        qids = blocks.id_array(queries["qid"])
        matrix = blocks.vector_matrix(queries["vector"])
        by_id = np.argsort(qids)
        best = blocks.TopRows(len(qids), limit)
        for batch in blocks.row_blocks(batches, len(qids)):
            ids = blocks.id_array(batch.column("id"))
            score = np.round(matrix @ blocks.vector_matrix(batch.column("vector")).T, RANK_DIGITS)
            if exclude_self:
                at = by_id[np.searchsorted(qids, ids, sorter=by_id).clip(max=len(qids) - 1)]
                own = np.flatnonzero(qids[at] == ids)
                score[at[own], own] = -np.inf
            best.add(ids, score)
        columns = best.columns()
        if columns is not None:
            query, ids, score = columns
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[query]), pa.array(ids), pa.array(score)], ["qid", "id", "score"]
            )

    id_type = dict(vectors.dtypes)["id"]
    qid_type = dict(targets.dtypes)["qid"]
    local = blocks.score_blocks(
        vectors.select("id", "vector").where(F.col("vector").isNotNull()),
        targets.select("qid", "vector").where(F.col("vector").isNotNull()),
        work,
        f"qid {qid_type}, id {id_type}, score double",
        max_queries,
        max_cell_rows,
    )
    return top_per_query(local, "score", limit)


def similar_items(
    vectors: DataFrame, ids: DataFrame | None = None, limit: int = fixed.NEIGHBOUR_LIMIT, **sizes: int
) -> DataFrame:
    """Neighbours of the items in ``ids(id)``, or of all items; unknown ids give no rows."""
    wanted = vectors if ids is None else vectors.join(ids, "id", "left_semi")
    return nearest(vectors, wanted.withColumnRenamed("id", "qid"), limit, **sizes)


def align(products: DataFrame, vectors: DataFrame) -> DataFrame:
    """Products with their vector, matched by id; either side without the other is left out."""
    return products.join(vectors.select("id", "vector"), "id")


def min_max_normalize(df: DataFrame, group: list[str], value: str, output: str) -> DataFrame:
    """Scale a column to [0, 1] within each group; a flat group gives 0.

    The extremes are aggregated with a partial step on the map side and joined back, so a group of any
    size is never sorted or held in one task.
    """
    extremes = df.groupBy(*group).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    span = F.col("_high") - F.col("_low")
    scaled = F.when(span < fixed.FLAT_RANGE, 0.0).otherwise((F.col(value) - F.col("_low")) / span)
    return df.join(broadcast_if_small(extremes), group).withColumn(output, scaled).drop("_low", "_high")
