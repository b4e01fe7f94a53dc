"""Quality scores: ridge regression on random Fourier features of document statistics, with isotonic calibration.

A document becomes some twenty numbers (lengths, shares of kinds of characters, repetition). Random cosines of the
standardised numbers stand for a Gaussian kernel. Each task sums its rows' normal equations; their sum has a fixed
size, whatever the corpus. The score is the ridge prediction, made a probability by isotonic regression on labelled
rows that the ridge has not seen.

Texts are read once: their statistics are written to a narrow table that training and scoring read.

Defined results: a null text is the empty text; an empty text is scored like any other; labelled rows without a
document or without a label are ignored, and a document with several labels counts with each; without any usable
label every score is 0.5, with labels of one class it is that class; an empty table gives no rows; further columns of
the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.shared import broadcast_if_small, write_shared

#: Cosines, the kernel's width in units of the root of the number of statistics, ridge weight per row, and seed.
FEATURES, WIDTH, RIDGE, SEED = 256, 0.6, 1e-4, 11
THRESHOLD = 0.3
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
#: Calibration groups scores into this many equal steps from -0.5 to 1.5.
STEPS, LOW, HIGH = 1_000, -0.5, 1.5
#: Rows that stand for the base rate in each calibration, so that few rows don't give certainty.
PRIOR = 2.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_KINDS = {
    "upper": [*range(65, 91)], "digit": [*range(48, 58)], "space": [32, 9], "line": [10], "stop": [*b".,;:?"],
    "shout": [*b"!"], "sign": [*b"#$%&*+=<>{}[]^~\\|/_@"], "quote": [*b"\"'()-"], "wide": [*range(128, 256)],
}
STATISTICS = [
    "log_bytes", "log_words", "word_length", "word_spread", "distinct_words", "top_word", "short_words",
    "log_line", "distinct_lines", "packed", "entropy", "capital_words", "marked_words", *_KINDS,
]


def statistics(text: str | None) -> np.ndarray:
    """The numbers of ``STATISTICS`` for a whole text."""
    text = text or ""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    size = max(len(data), 1)
    words = text.split()
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), float, len(words))
    many = max(len(words), 1)
    if words:
        held, times = np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_counts=True)
        repeated = [len(held) / many, times.max() / many]
    else:
        repeated = [1.0, 0.0]
    share = counts[counts > 0] / size
    values = [
        np.log1p(len(data)), np.log1p(len(words)), lengths.mean() if words else 0.0, lengths.std() if words else 0.0,
        *repeated, (lengths <= 3).sum() / many, np.log1p(size / len(lines)), len(set(lines)) / len(lines),
        len(zlib.compress(data, 1)) / size if data else 1.0, -(share * np.log(share)).sum(),
        sum(map(str.isupper, words)) / many, sum(not w[-1].isalnum() for w in words) / many,
    ]
    return np.array(values + [counts[kind].sum() / size for kind in _KINDS.values()])


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, statistics`` of ``docs(doc_id, text)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("statistics", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(values, pa.list_(pa.float64()))], schema=schema
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, statistics array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the cosines and the intercept
    steps: np.ndarray  # ridge predictions and the probabilities they stand for
    levels: np.ndarray

    def cosines(self, rows: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        count = len(self.weights) - 1
        turn = rng.normal(0, 1 / (WIDTH * np.sqrt(rows.shape[1])), (rows.shape[1], count))
        phase = rng.uniform(0, 2 * np.pi, count)
        inside = np.clip((rows - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / count) * np.cos(inside @ turn + phase)
        return np.hstack([waves, np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.cosines(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return np.full(len(rows), 0.5)
        return np.clip(np.interp(self.raw(rows), self.steps, self.levels), 0, 1)


def fold(folds: int = FOLDS) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to ``values`` by weighted least squares (pooled neighbours)."""
    blocks: list[list[float]] = []  # sum, weight, members
    for value, weight in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([value * weight, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, weight, members = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + weight, blocks[-1][2] + members]
    return np.concatenate([np.zeros(0), *[np.full(int(m), s / w) for s, w, m in blocks]])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), -1)


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the products of ``rows(statistics, label)``' cosines, by task and then by line of the matrix."""
    size = len(model.weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                waves = model.cosines(_matrix(batch.column("statistics")))
                label = np.array(batch.column("label"), float)[:, None]
                total += waves.T @ np.hstack([waves, label])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total))], names=["line", "sums"])

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": frame["line"].iloc[:1], "sums": [np.sum(frame["sums"].to_list(), axis=0)]})

    schema = "line int, sums array<double>"
    lines = rows.mapInArrow(add, schema).groupBy("line").applyInPandas(combine, schema).collect()
    total = np.zeros((size, size + 1))
    for line in lines:
        total[line["line"]] = line["sums"]
    return total[:, :-1], total[:, -1]


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """A model from ``labelled(statistics, label, fold)``; nothing but sums of fixed size comes to the driver."""
    count = len(STATISTICS)
    value = [F.col("statistics")[i] for i in range(count)]
    sums = labelled.agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"),
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(value)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(value)],
    ).first()
    n, ones = sums["n"], sums["ones"] or 0
    mean = np.array([sums[f"m{i}"] or 0.0 for i in range(count)])
    scale = np.array([sums[f"s{i}"] or 0.0 for i in range(count)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(features + 1), np.zeros(0), np.zeros(0))
    if not n:
        return model
    if ones in (0, n):
        model.steps, model.levels = np.array([0.0, 1.0]), np.full(2, ones / n)
        return model
    for own in (F.col("fold") != CALIBRATION, F.lit(True)):  # all rows, if the folds leave none
        products, target = normal_equations(labelled.filter(own), model)
        if products[-1, -1]:
            break
    penalty = np.eye(features + 1) * ridge * products[-1, -1]
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(products + penalty, target)

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = model.raw(np.array(frame["statistics"].to_list()))
            at = np.clip((raw - LOW) / (HIGH - LOW) * STEPS, 0, STEPS - 1).astype(int)
            yield pd.DataFrame({"step": at, "raw": raw, "label": frame["label"].astype(float)})

    unseen = labelled.filter(F.col("fold") == CALIBRATION)
    steps = (unseen if not unseen.isEmpty() else labelled).select("statistics", "label").mapInPandas(
        step, "step int, raw double, label double"
    )
    steps = steps.groupBy("step").agg(F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count(F.lit(1)).alias("n"))
    frame = steps.toPandas().sort_values("step")
    levels = isotonic(frame["label"].to_numpy(), frame["n"].to_numpy(float))
    pooled = pd.Series(frame["n"].to_numpy(float)).groupby(levels).transform("sum").to_numpy()
    model.steps, model.levels = frame["raw"].to_numpy(), (levels * pooled + PRIOR * ones / n) / (pooled + PRIOR)
    model.levels = np.maximum.accumulate(model.levels)
    return model


def quality_scores(
    docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, folds: int = FOLDS
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of ``docs(doc_id, text)``; rows of the held-out fold are never learned."""
    known = write_shared(document_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "statistics")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    marks = marks.filter("label is not null").withColumn("fold", fold(folds)).filter(F.col("fold") != HELD_OUT)
    model = fit(write_shared(known.join(marks, "doc_id").select("statistics", "label", "fold"), "labelled"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(_matrix(batch.column("statistics")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], schema=schema)

    scored = known.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold(folds) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that the classifier rejects; a row without ``doc_id`` stays.

    Rows that share a ``doc_id`` stay if any of them is accepted.
    """
    scores = write_shared(quality_scores(docs, labels, threshold=threshold), "scores")
    rejected = scores.groupBy("doc_id").agg(F.max("predicted").alias("best")).filter("best = 0 and doc_id is not null")
    return docs.join(broadcast_if_small(rejected.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
