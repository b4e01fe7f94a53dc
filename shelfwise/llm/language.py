"""Language identification by a convolutional network over bytes.

A text, in lower case, is cut into windows of a fixed number of bytes, the last one padded. Filters of several widths
run over the bytes of a window; each keeps its largest response; a softmax over those gives the languages. A filter's
first layer is a table of weights by position and byte, so a response is a sum of table rows. A document's prediction
is the mean log probability of all its windows, each weighted by the bytes it holds.

The network is trained in numpy on the driver, on windows of a bounded sample: about ``SAMPLE`` documents, shared out
equally among the languages, ``WINDOWS`` places of the whole text each. Prediction reads every window of every text.

Defined results: a null text, and one without a letter (of Unicode's kinds L), is ``und`` with score 0, and so is everything if no row has a
language to learn from; rows without a language are predicted but not learnt from; repeated rows count as often as
they occur; of equal probabilities the language first in the alphabet counts; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1
#: Documents to learn from, windows of each, and bytes of a window.
SAMPLE, WINDOWS, WINDOW = 6_000, 4, 256
#: Filters of each width; passes over the sample, windows in a step, and the step's size.
WIDTHS, FILTERS, PASSES, BATCH, RATE = (2, 3, 4), 12, 4, 64, 0.004
SEED = 5
#: Windows that a task computes at a time.
AT_ONCE = 256


def fold(folds: int = FOLDS) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def windows_of(text: str, size: int = WINDOW) -> np.ndarray:
    """All windows of a text, zeros behind the last byte."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    count = max(-(-len(data) // size), 1)
    padded = np.zeros(count * size, np.uint8)
    padded[: len(data)] = data
    return padded.reshape(count, size)


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # one per width: (width, 256, filters)
    bias: np.ndarray
    out: np.ndarray  # (all filters, languages)
    out_bias: np.ndarray

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter, and where it stands."""
        best, places = [], []
        for table in self.tables:
            steps = rows.shape[1] - len(table) + 1
            total = table[0][rows[:, :steps]]
            for j in range(1, len(table)):
                total += table[j][rows[:, j : j + steps]]
            place = total.argmax(axis=1)
            places.append(place)
            best.append(np.take_along_axis(total, place[:, None, :], axis=1)[:, 0])
        return np.concatenate(best, axis=1) + self.bias, np.concatenate(places, axis=1)

    def strongest(self, rows: np.ndarray) -> np.ndarray:
        best = []
        for table in self.tables:
            steps = rows.shape[1] - len(table) + 1
            total = table[0][rows[:, :steps]]
            for j in range(1, len(table)):
                total += table[j][rows[:, j : j + steps]]
            best.append(total.max(axis=1))
        return np.concatenate(best, axis=1) + self.bias

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        return _log_softmax(np.maximum(self.strongest(rows), 0) @ self.out + self.out_bias)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = SEED) -> Network:
    """Adam on the mean log loss of ``rows`` (windows) and ``labels`` (numbers of languages)."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    net = Network(
        languages,
        [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(total, np.float32),
        rng.normal(0, 0.3, (total, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    weights = [*net.tables, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(PASSES):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            x, y = rows[chosen], labels[chosen]
            best, places = net.pooled(x)
            hidden = np.maximum(best, 0)
            slope = np.exp(_log_softmax(hidden @ net.out + net.out_bias))
            slope[np.arange(len(y)), y] -= 1
            slope /= len(y)
            back = (slope @ net.out.T) * (best > 0)
            changes = []
            for k, table in enumerate(net.tables):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                change = np.zeros_like(table)
                for j in range(len(table)):
                    np.add.at(change[j], (np.take_along_axis(x, places[:, own] + j, axis=1), np.arange(FILTERS)), back[:, own])
                changes.append(change)
            changes += [back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
            step += 1
            for w, d, m, v in zip(weights, changes, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def sample_windows(docs: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """``doc_id, lang, windows`` of about ``sample`` documents of ``docs(doc_id, text, lang)``, equally by language."""
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    if not counts:
        return pd.DataFrame({"doc_id": [], "lang": [], "windows": []})
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / len(counts) / r["n"]))])
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_003)) / F.lit(1_000_003)
    chosen = docs.filter(draw < share[F.col("lang")]).limit(2 * sample)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("windows", pa.list_(pa.binary()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = text.lower().encode()
                rng = np.random.default_rng(abs(doc_id or 0))
                places = rng.integers(0, max(len(data) - WINDOW, 0) + 1, WINDOWS).tolist()
                # some shorter ones, as short texts have
                sizes = np.where(rng.random(WINDOWS) < 0.4, rng.integers(12, WINDOW, WINDOWS), WINDOW).tolist()
                cuts.append(sorted({data[p : p + n] for p, n in zip(places, sizes, strict=True)}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(cuts, pa.list_(pa.binary()))], schema=schema
            )

    return chosen.mapInArrow(cut, "doc_id long, lang string, windows array<binary>").toPandas()


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network learnt from ``docs(doc_id, text, lang)``; None if none has a language and letters."""
    frame = sample_windows(docs.filter("lang is not null").filter(F.col("text").rlike(r"\p{L}")), sample)
    frame = frame.sort_values(["doc_id", "lang"], kind="stable")
    languages = sorted(set(frame["lang"]))
    if not languages:
        return None
    pairs = [(w, languages.index(lang)) for lang, cuts in zip(frame["lang"], frame["windows"], strict=True) for w in cuts if len(w)]
    rows = np.zeros((len(pairs), WINDOW), np.uint8)
    for i, (data, _) in enumerate(pairs):
        rows[i, : len(data)] = np.frombuffer(data, np.uint8)
    return train(rows, np.array([y for _, y in pairs]), languages)


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each whole text."""
    asked = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    sums = np.zeros((len(texts), len(net.languages)))
    held: list[tuple[int, np.ndarray]] = []
    count = 0

    def flush() -> None:
        rows = np.concatenate([w for _, w in held])
        owner = np.repeat([i for i, _ in held], [len(w) for _, w in held])
        for at in range(0, len(rows), AT_ONCE):
            part = rows[at : at + AT_ONCE]
            filled = (part > 0).sum(axis=1, keepdims=True)
            np.add.at(sums, owner[at : at + AT_ONCE], filled * net.log_probabilities(part))
        held.clear()

    for i in asked:
        held.append((i, windows_of(texts[i])))
        count += len(held[-1][1])
        if count >= 8 * AT_ONCE:
            flush()
            count = 0
    if held:
        flush()
    for i in asked:
        mean = sums[i] / max(len(texts[i].lower().encode()), 1)
        chance = np.exp(_log_softmax(mean[None])[0])
        best = int(chance.argmax())
        languages[i], scores[i] = net.languages[best], float(chance[best])
    return languages, scores


def identify_languages(docs: DataFrame, folds: int = FOLDS, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of ``docs(doc_id, text, lang)``; the held-out fold is never learnt from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    net = fit(docs.filter(F.coalesce(fold(folds) != HELD_OUT, F.lit(True))), sample)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), 1024):
                part = texts[at : at + 1024].to_pylist()
                found = predict(net, part) if net else ([UNKNOWN] * len(part), [0.0] * len(part))
                columns = [batch.column("doc_id")[at : at + 1024], pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    predicted = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    held_out = F.coalesce(fold(folds) == HELD_OUT, F.lit(False))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
