"""Score a large table against a batch of queries without ever emitting one row per pair.

Each task multiplies a block of rows with a block of queries in numpy and keeps a bounded summary per
query (its extremes, or its best ``k`` rows). Spark partitions the rows and merges the summaries.

* Up to ``MAX_SHIPPED_QUERIES`` queries travel to every task and the rows stay where they are.
* More queries than that are cut into cells as well: rows and queries are hashed into a grid whose
  cells are all of bounded size, in rows and in bytes, and each cell is one task input. Both sides of a cell
  are large, so that neither is copied often. The result is the same.

What is sent or collected is measured first, by an aggregate; nothing is collected to find out its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SHIPPED_QUERIES = 2_048
MAX_SHIPPED_BYTES = 64 * 1024 * 1024
MAX_CELL_ROWS = 65_536
MAX_CELL_QUERIES = 16_384
MAX_CELL_BYTES = 256 * 1024 * 1024
#: Bytes of an entry of a list: a number of a vector, a term with its figures.
VALUE_BYTES, ENTRY_BYTES = 8, 48
MAX_BLOCK_ROWS = 1_024
MAX_BLOCK_VALUES = 4_000_000

Work = Callable[[Iterator[pa.RecordBatch], pa.Table], Iterator[pa.RecordBatch]]


def score_blocks(
    rows: DataFrame,
    queries: DataFrame,
    work: Work,
    schema: str,
    max_queries: int = MAX_SHIPPED_QUERIES,
    max_cell_rows: int = MAX_CELL_ROWS,
    max_cell_queries: int = MAX_CELL_QUERIES,
    max_cell_bytes: int = MAX_CELL_BYTES,
    narrow: Callable[[DataFrame, pa.Table], DataFrame] | None = None,
) -> DataFrame:
    """Run ``work`` over all (rows, queries) blocks. ``rows`` has an ``id``, ``queries`` a ``qid``.

    ``narrow`` may drop what shipped queries do not need from the rows before they go to Python.
    """
    n_queries, query_bytes = measure(queries)
    if n_queries <= max_queries and query_bytes <= MAX_SHIPPED_BYTES:
        shipped = queries.toArrow()
        narrowed = rows if narrow is None else narrow(rows, shipped)
        return narrowed.mapInArrow(lambda batches: work(batches, shipped), schema)

    n_rows, row_bytes = measure(rows)
    query_cells = max(1, -(-n_queries // max_cell_queries), -(-query_bytes // max_cell_bytes))
    row_cells = max(1, -(-n_rows // max_cell_rows), -(-row_bytes // max_cell_bytes))

    def cell(column: str, n: int):
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    row_side = rows.withColumn("row_cell", cell("id", row_cells)).withColumn("query_cell", every(query_cells))
    # columns of their own: rows and queries of one joined table share theirs, which a cogroup refuses as ambiguous
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    query_side = queries.withColumn("query_cell", cell("qid", query_cells)).withColumn(
        "row_cell", every(row_cells)
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(work(iter(left.to_batches()), right)) if left.num_rows and right.num_rows else []
        return pa.Table.from_batches(out) if out else empty

    empty = rows.sparkSession.createDataFrame([], schema).toArrow()
    keys = ["row_cell", "query_cell"]
    return row_side.groupBy(*keys).cogroup(query_side.groupBy(*keys)).applyInArrow(run, schema)


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows, and about how many bytes they take."""

    def width(field: T.StructField):
        if isinstance(field.dataType, T.ArrayType):
            nested = isinstance(field.dataType.elementType, (T.StructType, T.StringType))
            return F.size(field.name) * F.lit(ENTRY_BYTES if nested else VALUE_BYTES)
        return F.octet_length(field.name) if isinstance(field.dataType, T.StringType) else F.lit(VALUE_BYTES)

    widths = [F.coalesce(F.greatest(width(f), F.lit(0)), F.lit(0)).cast("long") for f in df.schema.fields]
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(sum(widths, F.lit(0).cast("long"))).alias("size")).first()
    return found["n"], found["size"] or 0


def row_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a matrix of ``width`` values per row stays within a fixed size."""
    n_rows = max(1, min(MAX_BLOCK_ROWS, MAX_BLOCK_VALUES // max(width, 1)))
    for batch in batches:
        for start in range(0, batch.num_rows, n_rows):
            yield batch.slice(start, n_rows)


def text_slices(sizes: Sequence[int], most: int, most_rows: int = MAX_BLOCK_ROWS) -> Iterator[slice]:
    """Slices of consecutive rows whose sizes add up to ``most`` or less; a larger row is alone."""
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and (held + size > most or at - start >= most_rows):
            yield slice(start, at)
            start, held = at, 0
        held += size
    if len(sizes) > start:
        yield slice(start, len(sizes))


def vector_matrix(column) -> np.ndarray:
    """List column of equally long vectors of finite numbers as a float64 matrix; others are refused."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"vectors of {lengths['min']} and {lengths['max']} dimensions cannot be compared")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(flat).all():
        raise ValueError("a vector with a null, infinite or undefined component cannot be compared")
    return flat.reshape(len(column), -1)


def list_entries(column) -> tuple[np.ndarray, pa.Array]:
    """Row number and value of every entry of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def id_array(column) -> np.ndarray:
    """Ids in a dtype that numpy can sort."""
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype(str) if values.dtype == object else values


class TopRows:
    """Best ``k`` rows per query by score, then by id; extra score matrices ride along.

    Rows below the k-th best score of any block seen so far cannot end up among the best, and neither can those that
    equal it but come after the k-th row's id, so only about ``k`` rows per query are ever held. A score of minus
    infinity leaves a row out.
    """

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.threshold = np.full(n_queries, -np.inf)
        self.last_id: np.ndarray | None = None  # of the k-th row, where ``full``
        self.full = np.zeros(n_queries, bool)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.pending = 0

    def add(self, ids: np.ndarray, score: np.ndarray, *extra: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Rows ``ids`` with their ``score`` for each query, or for the numbers ``queries`` of some, each once."""
        own = slice(None) if queries is None else queries
        if score.shape[1] >= self.k:
            kth = np.partition(score, -self.k, axis=1)[:, -self.k]
            self.full[own] &= kth <= self.threshold[own]
            self.threshold[own] = np.maximum(self.threshold[own], kth)
        threshold = self.threshold[own]
        wanted = score >= threshold[:, None]
        if self.last_id is not None and self.full[own].any():
            late = self.full[own][:, None] & (score == threshold[:, None]) & (ids[None, :] > self.last_id[own][:, None])
            wanted &= ~late
        query, row = np.nonzero(wanted & (score > -np.inf))
        if not len(query):
            return
        self.parts.append((query if queries is None else queries[query], ids[row], score[query, row], *(m[query, row] for m in extra)))
        self.pending += len(query)
        if self.pending > 4 * self.k * len(self.threshold):
            self._compact()

    def _compact(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        query, ids, score = columns[:3]
        order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        keep = order[place < self.k]
        self.parts = [tuple(c[keep] for c in columns)]
        self.pending = len(keep)
        query, ids, score = self.parts[0][:3]
        full = np.bincount(query, minlength=len(self.threshold)) >= self.k
        last = np.searchsorted(query, np.arange(len(self.threshold)), side="right") - 1
        lowest = np.where(full, score[last], -np.inf)
        self.last_id, self.full = ids[last], full & (lowest >= self.threshold)
        self.threshold = np.where(full, np.maximum(self.threshold, lowest), self.threshold)

    def columns(self) -> tuple[np.ndarray, ...] | None:
        if not self.parts:
            return None
        self._compact()
        return self.parts[0]
