"""Token totals by source, language and tokenizer version, maintained by signed changes.

A change is a counted document with a sign: an insert is +1, a delete -1, a revised count both, the old one and the
new one. Totals are sums of signs and of signed counts, so they can be kept up without reading the corpus again, in
any order of batches. A ``Rollup`` is a folder of two Parquet tables. ``deltas`` holds what each batch adds to each
total, one partition per batch; ``commits`` names the batches that are complete.

A batch is committed by writing its partition (over what an earlier, broken try left) and then its name. A committed
batch is never written again, so a repeated commit changes nothing, and readers see only named batches. ``compact``
replaces committed batches by one whose name is derived from theirs, under the same rule.

Defined results: a null text counts no tokens; null source and language are totals of their own; repeated rows count
as often as they occur; totals without documents and tokens are left out; an empty table is an empty batch, which is
committed all the same; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import tokens

KEYS = ["source", "lang", "tokenizer_version"]
COUNTED = ["doc_id", *KEYS, "n_tokens"]
_DELTAS = "source string, lang string, tokenizer_version string, documents long, tokens long, batch string"
_COMMITS = "replaces array<string>, batch string"


def count_tokens(docs: DataFrame, tokenizer: str = tokens.BYTE_BPE, version: str | None = None) -> DataFrame:
    """``doc_id, source, lang, tokenizer_version, n_tokens`` of ``docs(doc_id, text, source, lang)``."""
    name = version or tokenizer.rsplit(".", 1)[0]
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokens.tokenizer_path(tokenizer))
        for batch in batches:
            texts = batch.column("text")
            sizes = [np.diff(encoder.encode(texts[a:b])[1]) for a, b in tokens.in_batches(texts)]
            counts = pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]))
            columns = [batch.column(c) for c in ("doc_id", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*columns, counts], schema=schema)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
    )
    counted = rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")
    return counted.withColumn("tokenizer_version", F.lit(name)).select(*COUNTED)


def count_words(docs: DataFrame, pattern: str, version: str) -> DataFrame:
    """As ``count_tokens``, with the matches of a regular expression for tokens."""
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(pattern)).cast("long")
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), count.alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*COUNTED, F.lit(1).alias("sign"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*COUNTED, F.lit(-1).alias("sign"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old counts out, the new ones in; a key or a version may change as well as the number."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.deltas_path, self.commits_path = spark, f"{path}/deltas", f"{path}/commits"

    def create(self) -> Rollup:
        """Make the empty tables; an existing rollup stays as it is."""
        for path, schema in ((self.deltas_path, _DELTAS), (self.commits_path, _COMMITS)):
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return self

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(_COMMITS).option("recursiveFileLookup", False).parquet(self.commits_path)

    def committed(self) -> list[str]:
        """Names of the batches that count: complete, and not replaced by another."""
        rows = self._commits().filter("batch is not null").collect()
        replaced = {name for r in rows for name in r["replaces"] or []}
        return sorted({r["batch"] for r in rows} - replaced)

    def _known(self, batch: str) -> bool:
        return not self._commits().filter(F.col("batch") == batch).isEmpty()

    def _write(self, batch: str, deltas: DataFrame, replaces: list[str]) -> None:
        deltas.write.mode("overwrite").parquet(f"{self.deltas_path}/batch={batch}")
        mark = self.spark.createDataFrame([(replaces,)], "replaces array<string>").coalesce(1)
        mark.write.mode("overwrite").parquet(f"{self.commits_path}/batch={batch}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the signed ``changes`` under a name; False, and nothing done, if the name is committed already."""
        if self._known(batch):
            return False
        signed = F.col("sign").cast("long")
        deltas = changes.groupBy(*KEYS).agg(
            F.sum(signed).alias("documents"), F.sum(signed * F.coalesce("n_tokens", F.lit(0))).alias("tokens")
        )
        self._write(batch, deltas, [])
        return True

    def _deltas(self) -> DataFrame:
        names = self.committed()
        return self.spark.read.schema(_DELTAS).parquet(self.deltas_path).filter(F.col("batch").isin(names))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer_version, documents, tokens`` after all committed batches."""
        summed = self._deltas().groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter("documents <> 0 or tokens <> 0")

    def compact(self) -> str | None:
        """Replace the committed batches by one; their partitions stay until their owner clears them."""
        names = self.committed()
        if len(names) < 2:
            return None
        batch = f"compacted-{len(names)}-{names[-1]}"
        self._write(batch, self.totals(), names)
        return batch


def maintained_totals(
    spark: SparkSession, path: str, counts: list[DataFrame], removed: DataFrame, revised: dict[int, DataFrame] | None = None
) -> DataFrame:
    """Totals after one batch of inserts for each of ``counts``, a repeated one, and the deletes of ``removed(doc_id)``.

    Before the deletes, ``counts[i]`` is revised to ``revised[i]``, one batch each.
    """
    rollup = Rollup(spark, path).create()
    for i, counted in enumerate([*counts, counts[0]]):
        rollup.commit(f"load-{i % len(counts)}", inserts(counted))
    for i, newer in (revised or {}).items():
        rollup.commit(f"revise-{i}", revisions(counts[i], newer))
    counts = [(revised or {}).get(i, counted) for i, counted in enumerate(counts)]
    gone = removed.select("doc_id").distinct()
    for i, counted in enumerate(counts):
        rollup.commit(f"remove-{i}", deletes(counted.join(gone, "doc_id", "left_semi")))
    return rollup.totals()
