"""Keyword index and BM25 scores.

An indexed document is one row ``(id, length, terms)`` with the counted terms of the whole text, so the
score of a document is computed where the document lies, and no posting list is gathered anywhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.text import bind, search_tokens, term_counts
from shelfwise.operators.blocks import text_slices
from shelfwise.operators.vectors import RANK_DIGITS
from shelfwise.sources.shared import write_shared

#: Texts counted at a time, and their bytes.
COUNTED_ROWS, COUNTED_BYTES = 1_024, 2_000_000


def index_documents(docs: DataFrame, only_terms: Sequence[str] | None = None) -> DataFrame:
    """``docs(id, text)`` to ``(id, length, terms)``. ``only_terms`` keeps just the terms asked for; the
    length still counts every token."""

    def counted(tokens: Column) -> Column:
        if only_terms is None:
            kept = tokens
        elif only_terms:
            kept = F.filter(tokens, lambda t: t.isin(list(only_terms)))
        else:
            kept = F.array().cast("array<string>")
        return F.struct(F.size(tokens).alias("length"), term_counts(kept).alias("terms"))

    entry = bind(search_tokens(F.coalesce(F.col("text"), F.lit(""))), counted)
    return docs.select("id", entry.alias("entry")).select("id", "entry.length", "entry.terms")


def count_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``index_documents`` for a whole corpus, counted in Arrow batches.

    Counting all words of long texts takes a hash table a text; array expressions have to sort the words.
    """
    token = re.compile(fixed.SEARCH_TOKEN_PATTERN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for rows in text_slices(sizes, COUNTED_BYTES, COUNTED_ROWS):
                part = batch.slice(rows.start, rows.stop - rows.start)
                lengths, sizes, terms, counts = [], [0], [], []
                for text in part.column("text").to_pylist():
                    found = token.findall(text.lower()) if text else []
                    held = Counter(found)
                    lengths.append(len(found))
                    sizes.append(sizes[-1] + len(held))
                    terms.extend(held)
                    counts.extend(held.values())
                entries = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int32())], ["term", "tf"])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lengths, pa.int32()), lists], ["id", "length", "terms"])

    shape = f"id {dict(docs.dtypes)['id']}, length int, terms array<struct<term:string,tf:int>>"
    return docs.select("id", "text").mapInArrow(run, shape)


def postings(indexed: DataFrame) -> DataFrame:
    """One row per document and distinct term.

    The outer form of ``inline`` keeps Spark from testing the array for emptiness in a filter of its own,
    which would count the terms of every document a second time.
    """
    entries = indexed.select("id", "length", F.inline_outer("terms")).where("term is not null")
    return entries.select("term", "id", "tf", "length")


def corpus_totals(indexed: DataFrame) -> DataFrame:
    return indexed.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))


def idf(df: Column, n_docs: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def term_statistics(indexed: DataFrame) -> DataFrame:
    """Every term of the corpus with its document frequency and idf."""
    frequency = postings(indexed).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n_docs = indexed.agg(F.count(F.lit(1))).scalar()
    return frequency.withColumn("idf", idf(F.col("df"), n_docs))


def length_norm(length: Column, avg_length: Column, k1: float, b: float) -> Column:
    return k1 * (1 - b + b * length / avg_length)


def search_text(
    docs: DataFrame,
    query: str,
    limit: int = fixed.DEFAULT_LIMIT,
    k1: float = fixed.BM25_K1,
    b: float = fixed.BM25_B,
) -> DataFrame:
    """Best ``limit`` documents of ``docs(id, text)`` for one query text, with their BM25 score.

    The text is read once, into a narrow table with the length and the query's own terms of each document.
    The totals and the scores then come from that table. Documents without a match stay in with score 0.
    """
    terms = sorted(set(re.findall(fixed.SEARCH_TOKEN_PATTERN, query.lower())))
    tf = [f"tf{i}" for i in range(len(terms))]

    def occurrences(term: str) -> Column:
        hit = F.filter("terms", lambda t: t["term"] == term)
        return F.coalesce(F.get(hit, F.lit(0))["tf"], F.lit(0))

    found = [occurrences(term).alias(name) for term, name in zip(terms, tf, strict=True)]
    counted = write_shared(index_documents(docs, terms).select("id", "length", *found), "query_terms")
    totals = counted.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.avg("length").alias("avg_length"),
        *[F.count_if(F.col(name) > 0).alias(name) for name in tf],
    ).first()
    norm = length_norm(F.col("length"), F.lit(totals["avg_length"]), k1, b)
    score = F.lit(0.0)
    for name in tf:
        part = idf(F.lit(totals[name]), F.lit(totals["n_docs"])) * F.col(name) * (k1 + 1) / (F.col(name) + norm)
        score = score + F.when(F.col(name) > 0, part).otherwise(0.0)
    scored = counted.select("id", F.round(score, RANK_DIGITS).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def query_terms(indexed: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct terms of ``queries(qid, text)`` matched with the corpus: ``(qid, terms<term, idf>)``.

    Documents are counted by term before the join, with a partial step in each task, so a frequent term is one row
    per task when it meets the queried ones.
    """
    asked = queries.select("qid", F.explode_outer(F.array_distinct(search_tokens("text"))).alias("term")).where(
        "term is not null"
    )
    n_docs = indexed.agg(F.count(F.lit(1))).scalar()
    counted = postings(indexed).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    frequency = counted.join(asked.select("term").distinct(), "term", "left_semi")
    return (
        asked.join(frequency, "term")
        .withColumn("idf", idf(F.col("df"), n_docs))
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("terms"))
    )
