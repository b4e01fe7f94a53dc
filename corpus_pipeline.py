"""A training corpus from raw documents: five stages, each on what the one before it kept.

1. quality: documents that the classifier rejects go.
2. line_dedup: of lines that are equal or nearly so, one stays in the corpus; a document left without text goes.
3. near_duplicates: one document of each group of near copies stays.
4. decontamination: documents that hold a window of the benchmark go.
5. packing: the rest becomes sequences of token ids.

Each stage's result is written below ``spark.checkpoint.dir`` and read again, so a lost executor costs at most the
stage it worked on. The first four return the columns of ``documents``, the last the places of all pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import decontamination, lines, minhash, packing, quality
from shelfwise.llm.corpus import read
from shelfwise.sources.shared import write_shared

#: Word shingles of five words, and this share of them in common, make near copies. ``op9`` links at the 85 that its
#: contract names; a stage has none, so the usual 80 holds.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs, read(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_of_each(docs, NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier and the packing plan have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    rows = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = write_shared(stage(spark, rows, sf_dir), name)
    return rows
