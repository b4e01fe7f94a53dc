"""Hybrid search for a batch of queries: BM25 and cosine, each scaled per query, fused, ranked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.scores import keyword_share
from shelfwise.operators import blocks
from shelfwise.operators.bm25 import corpus_totals, count_documents, query_terms
from shelfwise.operators.vectors import RANK_DIGITS, top_per_query
from shelfwise.sources.shared import write_shared

MAX_LITERAL_TERMS = 5_000
EXTREMES = ["bm25_low", "bm25_high", "cosine_low", "cosine_high"]


def check_arguments(limit: int, alpha: float, max_limit: int = fixed.MAX_LIMIT) -> None:
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must lie between 1 and {max_limit}, not {limit}")
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha}")


def build_index(docs: DataFrame, vectors: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Write the search table ``(id, length, terms[, vector])`` once; all later passes read it.

    With ``vectors(id, vector)`` the corpus is what both sides know, matched by id. At a ``path`` the index stays
    for later sessions (``open_index``); without one it lies in the shared folder of this one.
    """
    indexed = count_documents(docs)
    if vectors is not None:
        indexed = indexed.join(vectors.select("id", "vector").where("vector is not null"), "id")
    if path is None:
        return write_shared(indexed, "search_index")
    indexed.write.mode("overwrite").parquet(path)
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """An index that ``build_index`` wrote."""
    return spark.read.parquet(path)


def index_figures(index: DataFrame) -> DataFrame:
    """One row: documents, mean length, and the dimensions of the vectors if the index has them."""
    dim = F.max(F.size("vector")) if "vector" in index.columns else F.lit(None).cast("int")
    return index.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"), dim.alias("dim"))


class _QueryBlock:
    """The terms of a block of queries as one flat list, their vectors as a matrix."""

    def __init__(self, queries: pa.Table, avg_length: float, k1: float, b: float):
        self.qids = blocks.id_array(queries["qid"])
        self.avg_length, self.k1, self.b = avg_length, k1, b
        query, entries = blocks.list_entries(queries["terms"])
        codes = pc.dictionary_encode(entries.field("term"))
        self.vocabulary = codes.dictionary
        self.code = codes.indices.to_numpy(zero_copy_only=False)
        # the entries by code: which queries ask for a term, and with what weight
        order = np.argsort(self.code, kind="stable")
        self.asking, self.weight = query[order], (entries.field("idf").to_numpy(zero_copy_only=False) * (k1 + 1))[order]
        self.many = np.bincount(self.code, minlength=len(self.vocabulary))
        self.first = np.cumsum(self.many) - self.many
        has_vectors = "vector" in queries.column_names
        self.vectors = blocks.vector_matrix(queries["vector"]) if has_vectors else None
        self.width = max(len(self.qids), len(self.code))

    def bm25(self, batch: pa.RecordBatch) -> np.ndarray:
        """Query-by-row BM25 scores of a block of indexed documents."""
        row, entries = blocks.list_entries(batch.column("terms"))
        code = pc.index_in(entries.field("term"), value_set=self.vocabulary)
        known = pc.is_valid(code).to_numpy(zero_copy_only=False)
        row, code = row[known], code.drop_null().to_numpy(zero_copy_only=False)
        tf = entries.field("tf").to_numpy(zero_copy_only=False)[known]
        length = batch.column("length").to_numpy(zero_copy_only=False)
        norm = self.k1 * (1 - self.b + self.b * length / self.avg_length)
        # one number for each query that asks for a term and each row that holds it, added up by query and row
        many = self.many[code]
        entry = np.repeat(self.first[code] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        part = np.repeat(tf / (tf + norm[row]), many) * self.weight[entry]
        place = self.asking[entry] * batch.num_rows + np.repeat(row, many)
        added = np.bincount(place, part, len(self.qids) * batch.num_rows)  # of whole numbers, if there is nothing to add
        return added.astype(float, copy=False).reshape(len(self.qids), batch.num_rows)

    def cosine(self, batch: pa.RecordBatch) -> np.ndarray:
        return self.vectors @ blocks.vector_matrix(batch.column("vector")).T


def _type_of(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def _resolve(index: DataFrame, queries: DataFrame, *carried: str) -> DataFrame:
    """Queries with the idf of their terms, written once because several passes read them."""
    no_terms = F.array().cast("array<struct<term:string,idf:double>>")
    resolved = queries.select("qid", *carried).join(query_terms(index, queries), "qid", "left")
    return write_shared(resolved.withColumn("terms", F.coalesce("terms", no_terms)), "queries")


def _asked_terms_only(rows: DataFrame, queries: pa.Table) -> DataFrame:
    """Leave the terms that no query asks for out of the rows, unless very many are asked for."""
    asked = pc.unique(blocks.list_entries(queries["terms"])[1].field("term")).to_pylist()
    if len(asked) > MAX_LITERAL_TERMS:
        return rows
    return rows.withColumn("terms", F.filter("terms", lambda t: t["term"].isin(asked)))


def bm25_batch(
    index: DataFrame,
    queries: DataFrame,
    limit: int = fixed.DEFAULT_LIMIT,
    k1: float = fixed.BM25_K1,
    b: float = fixed.BM25_B,
    **sizes: int,
) -> DataFrame:
    """Best ``limit`` documents per query of ``queries(qid, text)`` by BM25 alone."""
    avg_length = corpus_totals(index).first()["avg_length"]
    resolved = _resolve(index, queries)

    def work(batches: Iterator[pa.RecordBatch], table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        block = _QueryBlock(table, avg_length, k1, b)
        best = blocks.TopRows(len(block.qids), limit)
        for batch in blocks.row_blocks(batches, block.width):
            best.add(blocks.id_array(batch.column("id")), np.round(block.bm25(batch), RANK_DIGITS))
        columns = best.columns()
        if columns is not None:
            query, ids, score = columns
            arrays = [pa.array(block.qids[query]), pa.array(ids), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, ["qid", "id", "score"])

    schema = f"qid {_type_of(queries, 'qid')}, id {_type_of(index, 'id')}, score double"
    rows = index.select("id", "length", "terms")
    local = blocks.score_blocks(rows, resolved, work, schema, narrow=_asked_terms_only, **sizes)
    return top_per_query(local, "score", limit)


def hybrid_search(
    index: DataFrame,
    queries: DataFrame,
    limit: int = fixed.DEFAULT_LIMIT,
    alpha: float = fixed.FUSION_ALPHA,
    k1: float = fixed.BM25_K1,
    b: float = fixed.BM25_B,
    products: DataFrame | None = None,
    **sizes: int,
) -> DataFrame:
    """Best ``limit`` rows of an index with vectors for each of ``queries(qid, text, vector)``.

    Every document takes part: the scores are scaled over the whole corpus, and a document without a
    matching term keeps its semantic half. Blank queries are left out. The first pass finds each
    query's extremes, the second one fuses and keeps the best rows; both move only per-query summaries.
    """
    check_arguments(limit, alpha)
    queries = queries.where(F.btrim("text", F.lit(fixed.WHITESPACE)) != "")
    avg_length = corpus_totals(index).first()["avg_length"]
    resolved = _resolve(index, queries, "vector")
    rows = index.select("id", "length", "terms", "vector")
    qid_type, id_type = _type_of(queries, "qid"), _type_of(index, "id")

    def extremes(batches: Iterator[pa.RecordBatch], table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        block = _QueryBlock(table, avg_length, k1, b)
        low = np.full((2, len(block.qids)), np.inf)
        high = -low
        seen = False
        for batch in blocks.row_blocks(batches, block.width):
            seen = True
            for i, score in enumerate((block.bm25(batch), block.cosine(batch))):
                np.minimum(low[i], score.min(axis=1), out=low[i])
                np.maximum(high[i], score.max(axis=1), out=high[i])
        if seen:
            arrays = [pa.array(c) for c in (block.qids, low[0], high[0], low[1], high[1])]
            yield pa.RecordBatch.from_arrays(arrays, ["qid", *EXTREMES])

    schema = f"qid {qid_type}, " + ", ".join(f"{c} double" for c in EXTREMES)
    span = blocks.score_blocks(rows, resolved, extremes, schema, narrow=_asked_terms_only, **sizes)
    span = span.groupBy("qid").agg(
        *[(F.min if c.endswith("low") else F.max)(c).alias(c) for c in EXTREMES]
    )
    names = ["bm25_raw", "bm25_normalized", "semantic_raw_cosine", "semantic_normalized"]

    def fuse(batches: Iterator[pa.RecordBatch], table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        block = _QueryBlock(table, avg_length, k1, b)
        bounds = {c: table[c].to_numpy()[:, None] for c in EXTREMES}
        best = blocks.TopRows(len(block.qids), limit)

        def scaled(score: np.ndarray, side: str) -> np.ndarray:
            low, reach = bounds[f"{side}_low"], bounds[f"{side}_high"] - bounds[f"{side}_low"]
            flat = reach < fixed.FLAT_RANGE
            return np.where(flat, 0.0, (score - low) / np.where(flat, 1.0, reach))

        for batch in blocks.row_blocks(batches, block.width):
            bm25, cosine = block.bm25(batch), block.cosine(batch)
            keyword, semantic = scaled(bm25, "bm25"), scaled(cosine, "cosine")
            fused = np.round(alpha * keyword + (1 - alpha) * semantic, RANK_DIGITS)
            best.add(blocks.id_array(batch.column("id")), fused, bm25, keyword, cosine, semantic)
        columns = best.columns()
        if columns is not None:
            query, *rest = columns
            arrays = [pa.array(block.qids[query]), *[pa.array(c) for c in rest]]
            yield pa.RecordBatch.from_arrays(arrays, ["qid", "id", "fused", *names])

    schema = f"qid {qid_type}, id {id_type}, fused double, " + ", ".join(f"{c} double" for c in names)
    spanned = resolved.join(span, "qid")
    local = blocks.score_blocks(rows, spanned, fuse, schema, narrow=_asked_terms_only, **sizes)
    ranked = top_per_query(local, "fused", limit).withColumn(
        "keyword_share", keyword_share(F.col("bm25_normalized"), F.col("semantic_normalized"), alpha)
    )
    return ranked if products is None else ranked.join(products, "id")
