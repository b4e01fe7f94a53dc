"""Exact nearest neighbours with metric pruning.

**Cells.** A bounded sample of the vectors are pivots; every vector lies in the cell of the pivot that it points most
towards. Of each vector two numbers are kept: its length ``along`` the pivot, and ``across`` it. For any query
``q . x <= (q along)(x along) + (q across)(x across)``, which for unit vectors is the triangle inequality of angles. Sorted by
cell and ``along``, the vectors are numbered and cut into shelves, which tasks read, and within them into blocks of one
cell; a shelf's and a block's extremes bound the score of everything in them.

**Search.** A query visits the shelf with the highest bound, then the second, then two, four, ... more in the order of
their bounds, as long as those reach its k-th best score so far. So the rows that come back grow with the logarithm of the
number of shelves. Within a shelf blocks come best first, and the threshold rises from block to block, so most are
skipped where the vectors lie in clusters. Where they don't (uniform directions in many dimensions) nothing can be
skipped, and a task multiplies matrices as ``vectors.nearest`` does. Scores and ties are those of ``vectors.nearest``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.operators import blocks
from shelfwise.operators.positions import number_rows
from shelfwise.operators.vectors import RANK_DIGITS, top_per_query
from shelfwise.sources.shared import broadcast_if_small, write_shared

#: Pivots at most; the number is the root of the number of vectors.
MOST_PIVOTS = 4_096
#: Vectors in a shelf and in a block, and queries that meet a shelf in one task.
SHELF_ROWS, BLOCK_ROWS, TASK_QUERIES = 4_096, 64, 8_192
#: Added to every bound for what rounding takes.
SLACK = 10.0**-RANK_DIGITS


@dataclass(frozen=True)
class Cells:
    """Vectors ``(id, vector, cell, along, across, position, shelf)``, their unit pivots, and the extremes of each shelf and cell."""

    rows: DataFrame
    pivots: np.ndarray
    extremes: pa.Table


def _units(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros becomes some direction."""
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    out = matrix / np.where(norm == 0, 1, norm)
    out[norm[:, 0] == 0, 0] = 1.0
    return out


def _chain(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order in which similar ones stand near each other: by the nearest of a few of them, then by how near."""
    few = pivots[: int(np.ceil(np.sqrt(len(pivots))))]
    near = pivots @ few.T
    return pivots[np.lexsort((-near.max(axis=1), near.argmax(axis=1)))]


def split(matrix: np.ndarray, pivots: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the rows along and across the pivots of their cells."""
    along = (matrix * pivots[cell]).sum(axis=1)
    across = np.sqrt(np.maximum((matrix * matrix).sum(axis=1) - along * along, 0))
    return along, across


def build_cells(vectors: DataFrame, most_pivots: int = MOST_PIVOTS, shelf_rows: int = SHELF_ROWS) -> Cells:
    """Deal ``vectors(id, vector)`` out to cells; null vectors are left out."""
    vectors = vectors.select("id", "vector").where("vector is not null")
    count = vectors.count()
    wanted = min(most_pivots, max(1, int(np.ceil(np.sqrt(count)))))
    # the sample is bounded by ``most_pivots``
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).toArrow()
    pivots = _chain(_units(blocks.vector_matrix(sample["vector"]))) if sample.num_rows else np.zeros((0, 1))
    id_type, vector_type = (dict(vectors.dtypes)[c] for c in ("id", "vector"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.row_blocks([batch], len(pivots)):
                matrix = blocks.vector_matrix(part.column("vector"))
                cell = (matrix @ pivots.T).argmax(axis=1)
                along, across = split(matrix, pivots, cell)
                columns = [part.column("id"), part.column("vector"), pa.array(cell, pa.int32()), pa.array(along), pa.array(across)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "cell", "along", "across"])

    dealt = vectors.mapInArrow(deal, f"id {id_type}, vector {vector_type}, cell int, along double, across double")
    numbered = number_rows(write_shared(dealt, "dealt"), [F.asc("cell"), F.desc("along"), F.asc("id")], first=0)
    rows = numbered.withColumn("shelf", F.floor(F.col("position") / shelf_rows))
    # a row for each cell, and one more for each shelf
    extremes = rows.groupBy("shelf", "cell").agg(F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("across"))
    return Cells(rows, pivots, extremes.orderBy("shelf", "cell").toArrow())


def _bounds(along: np.ndarray, across: np.ndarray, low: np.ndarray, high: np.ndarray, most_across: np.ndarray) -> np.ndarray:
    """Query by group: what no member of the group can score above. ``along`` and ``across`` are the queries' for each group."""
    return np.maximum(along * low, along * high) + across * most_across + SLACK


def _query_parts(matrix: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    along = matrix @ pivots.T
    return along, np.sqrt(np.maximum((matrix * matrix).sum(axis=1, keepdims=True) - along * along, 0))


def nearest(
    cells: Cells, targets: DataFrame, limit: int = fixed.NEIGHBOUR_LIMIT, exclude_self: bool = True, task_queries: int = TASK_QUERIES
) -> tuple[DataFrame, DataFrame]:
    """Best ``limit`` vectors for each of ``targets(qid, vector)``: ``qid, id, score, rank``; and ``qid, pairs``, the scores computed."""
    qid_type, vector_type = (dict(targets.dtypes)[c] for c in ("qid", "vector"))
    targets = targets.select("qid", "vector").where("vector is not null")
    id_type, row_vector = (dict(cells.rows.dtypes)[c] for c in ("id", "vector"))
    shape = f"qid {qid_type}, id {id_type}, score double, shelf long, pairs long"
    if not len(cells.pivots):
        none = targets.sparkSession.createDataFrame([], shape)
        return top_per_query(none.select("qid", "id", "score"), "score", limit), none.select("qid", "pairs")
    pivots, extremes = cells.pivots, cells.extremes
    shelf, cell = extremes["shelf"].to_numpy(), extremes["cell"].to_numpy()
    low, high, across = (extremes[c].to_numpy() for c in ("low", "high", "across"))
    starts = np.flatnonzero(np.r_[True, shelf[1:] != shelf[:-1]])
    numbers = shelf[starts]

    def shelf_bounds(matrix: np.ndarray) -> np.ndarray:
        q_along, q_across = _query_parts(matrix, pivots)
        return np.maximum.reduceat(_bounds(q_along[:, cell], q_across[:, cell], low, high, across), starts, axis=1)

    def visits_of(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The shelves of the places ``first`` to ``last`` in the order of their bounds, as far as those reach the threshold."""
            for batch in batches:
                for part in blocks.row_blocks([batch], len(cell)):
                    bounds = shelf_bounds(blocks.vector_matrix(part.column("vector")))
                    order = np.argsort(-bounds, axis=1, kind="stable")[:, first:last]
                    threshold = part.column("threshold").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    query, place = np.nonzero(np.take_along_axis(bounds, order, axis=1) >= threshold[:, None])
                    rows = pa.array(query)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("qid").take(rows), part.column("vector").take(rows), pa.array(threshold[query]), pa.array(numbers[order[query, place]])],
                        ["qid", "vector", "threshold", "shelf"],
                    )

        return run

    visit = f"qid {qid_type}, vector {vector_type}, threshold double, shelf long"

    def score(visits: DataFrame) -> DataFrame:
        # queries of one shelf are cut into parts; equal parts of all shelves hold about as many
        in_shelf = visits.groupBy("shelf").agg(F.count(F.lit(1)).alias("n"))
        parts = broadcast_if_small(in_shelf.select("shelf", F.ceil(F.col("n") / task_queries).alias("parts")))
        asked = visits.join(parts, "shelf").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts"))).drop("parts")
        rows = cells.rows.join(parts, "shelf").withColumn("in_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        rows = rows.select(F.col("shelf").alias("in_shelf"), "in_part", "id", "vector", "cell", "along", "across", "position")
        both = rows.groupBy("in_shelf", "in_part").cogroup(asked.groupBy("shelf", "part"))
        return both.applyInArrow(lambda held, wanted: _score_shelf(held, wanted, pivots, limit, exclude_self, empty), shape)

    empty = targets.sparkSession.createDataFrame([], shape).toArrow()
    targets = write_shared(targets, "targets")
    best, works, first, last = targets.sparkSession.createDataFrame([], shape).select("qid", "id", "score"), [], 0, 1
    open_ = targets.withColumn("threshold", F.lit(None).cast("double"))
    while first < len(numbers):
        visits = write_shared(open_.mapInArrow(visits_of(first, last), visit), "visits")
        if visits.isEmpty():
            break  # bounds fall from place to place
        found = write_shared(score(visits), "found")
        works.append(found.groupBy("qid", "shelf").agg(F.max("pairs").alias("pairs")))
        both = best.unionByName(found.filter("id is not null").select("qid", "id", "score"))
        best = write_shared(top_per_query(both, "score", limit).drop("rank"), "best")
        threshold = best.groupBy("qid").agg(F.min("score").alias("threshold"), F.count(F.lit(1)).alias("n"))
        threshold = threshold.filter(F.col("n") >= limit).drop("n")
        # a query that this round had nothing to visit for is done
        open_ = targets.join(visits.select("qid").distinct(), "qid", "left_semi").join(threshold, "qid", "left")
        first, last = last, 2 * last
    if not works:
        return top_per_query(best, "score", limit), best.select("qid", F.lit(0).cast("long").alias("pairs")).limit(0)
    work = reduce(DataFrame.unionByName, works).groupBy("qid").agg(F.sum("pairs").alias("pairs"))
    return top_per_query(best, "score", limit), work


def _score_shelf(held: pa.Table, wanted: pa.Table, pivots: np.ndarray, limit: int, exclude_self: bool, empty: pa.Table) -> pa.Table:
    """The best rows of a shelf for each query that visits it, blocks of the highest bounds first."""
    if not held.num_rows or not wanted.num_rows:
        return empty
    held = held.sort_by("position")
    matrix, ids = blocks.vector_matrix(held["vector"]), blocks.id_array(held["id"])
    asked, qids = blocks.vector_matrix(wanted["vector"]), blocks.id_array(wanted["qid"])
    threshold = wanted["threshold"].to_numpy().copy()
    cell, along, across = (held[c].to_numpy() for c in ("cell", "along", "across"))
    changes = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    in_cell = np.arange(len(cell)) - np.repeat(changes, np.diff(np.r_[changes, len(cell)]))
    starts = np.flatnonzero(in_cell % BLOCK_ROWS == 0)
    ends = np.r_[starts[1:], len(cell)]
    of_block = cell[starts]
    own, code = np.unique(of_block, return_inverse=True)
    q_along, q_across = _query_parts(asked, pivots[own])
    low, high, most = np.minimum.reduceat(along, starts), np.maximum.reduceat(along, starts), np.maximum.reduceat(across, starts)
    bounds = _bounds(q_along[:, code], q_across[:, code], low, high, most)
    best = np.full((len(qids), limit), -np.inf)
    pairs = np.zeros(len(qids), np.int64)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for block in np.argsort(-bounds.max(axis=0), kind="stable"):
        open_ = np.flatnonzero(bounds[:, block] >= threshold)
        if not len(open_):
            continue
        rows = slice(starts[block], ends[block])
        score = asked[open_] @ matrix[rows].T
        pairs[open_] += score.shape[1]
        # most queries have no row here that reaches their threshold; what lies below it cannot raise it either
        near = np.flatnonzero(score.max(axis=1) >= threshold[open_] - SLACK)
        if not len(near):
            continue
        open_, score = open_[near], np.round(score[near], RANK_DIGITS)
        if exclude_self:
            score[qids[open_][:, None] == ids[rows][None, :]] = -np.inf
        query, row = np.nonzero((score >= threshold[open_][:, None]) & (score > -np.inf))
        kept.append((open_[query], starts[block] + row, score[query, row]))
        merged = np.concatenate([best[open_], score], axis=1)
        best[open_] = -np.partition(-merged, limit - 1, axis=1)[:, :limit]
        threshold[open_] = np.maximum(threshold[open_], best[open_].min(axis=1))
    query, row, score = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    still = score >= threshold[query]
    query, row, score = query[still], row[still], score[still]
    order = np.lexsort((ids[row], -score, query))
    place = np.arange(len(query)) - np.searchsorted(query[order], query[order], side="left")
    query, row, score = query[order][place < limit], row[order][place < limit], score[order][place < limit]
    # a visit that finds nothing has its pairs counted too
    bare = np.setdiff1d(np.flatnonzero(pairs), query)
    shelf = wanted["shelf"][0].as_py()
    found = pa.concat_arrays([held["id"].combine_chunks().take(pa.array(row)), pa.nulls(len(bare), held.schema.field("id").type)])
    who = np.r_[query, bare].astype(np.int64)
    columns = [
        wanted["qid"].combine_chunks().take(pa.array(who)), found, pa.array(np.r_[score, np.full(len(bare), -np.inf)]),
        pa.repeat(shelf, len(who)), pa.array(pairs[who]),
    ]
    return pa.table(columns, schema=empty.schema)


def similar_items(vectors: DataFrame, ids: DataFrame | None = None, limit: int = fixed.NEIGHBOUR_LIMIT) -> DataFrame:
    """Neighbours of the items in ``ids(id)``, or of all; the rows of ``vectors.similar_items``."""
    wanted = vectors if ids is None else vectors.join(ids, "id", "left_semi")
    return nearest(build_cells(vectors), wanted.withColumnRenamed("id", "qid"), limit)[0]
