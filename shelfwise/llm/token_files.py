"""Token-ID output: Parquet files of token lists that can be read by row range or by column.

One row is one document: its ``row`` (a number that ascends over all files, with gaps between them), ``doc_id``, ``n_tokens``
and ``tokens`` (a list of 32-bit ids, the end id included). Files
hold ascending, disjoint ranges of ``doc_id``, so file names in order are the corpus in order. Token lists are
dictionary-encoded (a vocabulary fits one dictionary), the number columns delta-encoded, pages are cut by row
count, and the writer adds page indexes: a reader of some documents skips the pages of all others, and a reader of
the metadata never touches the token pages.

Defined results: a null text is the empty text and has only its end id; an empty table gives no rows; repeated
``doc_id`` stay, ordered by their text; a null ``doc_id`` comes first; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm import tokens
from shelfwise.sources.shared import shared_folder, write_shared

END_ID = 0
ROW_GROUP_BYTES = 32 * 1024 * 1024
PAGE_ROWS = 256
FILE_SCHEMA = "row long, doc_id long, n_tokens int, tokens array<int>"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``docs(row, doc_id, text)`` in their order as rows of the file format."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokens.tokenizer_path(tokenizer))
        for batch in batches:
            texts = batch.column("text")
            for a, b in tokens.in_batches(texts):
                ids, ends = encoder.encode(texts[a:b])
                ids = np.insert(ids, ends[1:], end_id).astype(np.int32)
                ends += np.arange(len(ends))
                lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids))
                sizes = pa.array(np.diff(ends), pa.int32())
                columns = [batch.column("row")[a:b], batch.column("doc_id")[a:b].cast(pa.int64()), sizes, lists]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("row", "doc_id", "text").mapInArrow(run, FILE_SCHEMA)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str = tokens.BYTE_BPE,
    end_id: int = END_ID,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every text and write the files in ascending ``doc_id``.

    One range shuffle carries the texts; ids are made after it, in file order. The sampling job before a range shuffle
    therefore reads texts at most, and encodes none.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.withColumn("row", F.monotonically_increasing_id())
    (
        encode_documents(ordered, tokenizer, end_id)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#row", "false")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` and ``n_tokens``, without reading a token page."""
    return spark.read.schema(FILE_SCHEMA).parquet(path).select("doc_id", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Token lists of the documents from ``first`` to ``last``; row groups and pages outside are skipped."""
    df = spark.read.schema(FILE_SCHEMA).parquet(path)
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    return df if last is None else df.filter(F.col("doc_id") <= last)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files alone; ``start`` counts the ids of all documents before.

    The lists are read once. Places within a file come from a window over that file's narrow rows, the files' own
    places from one row per file.
    """
    schema = pa.schema([("file", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("row"), batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())],
                schema=schema,
            )

    files = read_tokens(spark, path).select(F.col("_metadata.file_name").alias("file"), "row", "doc_id", "tokens")
    rows = write_shared(files.mapInArrow(run, "file string, row long, doc_id long, n_tokens long, ids_crc32 long"), "digests")
    # files hold disjoint ranges of rows, so their first rows order them
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"), F.min("row").alias("first")).select(
        "file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("file_start")
    )
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, "file").select(
        "doc_id",
        (F.col("file_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def token_files_round_trip(docs: DataFrame, tokenizer: str = tokens.BYTE_BPE, end_id: int = END_ID) -> DataFrame:
    """Write the files below the shared folder and return what ``token_digests`` reads from them."""
    path = f"{shared_folder(docs.sparkSession)}/token_files"
    write_token_files(docs, path, tokenizer, end_id)
    return token_digests(docs.sparkSession, path)
