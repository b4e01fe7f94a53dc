"""Toxicity by multiple-instance learning: sentences are scored, though only documents are labelled.

A document is toxic if any of its sentences is. A sentence's probability is logistic in the words it holds, a document's
is the noisy-or of its sentences, ``1 - prod(1 - p)``; both are trained together from the documents' labels by
gradient descent on the log loss, in numpy, on a bounded sample (``SAMPLE`` documents of each label, weighted back to the
share that the label has among all labelled rows). What has been learnt then points at the sentences.

A word's weight is the sum of those of its features: the whole word, and its first four and five characters, so that
inflected forms share weight. Only features that go with the label in the sample (a two-proportion z of ``LEAST_Z`` or
more, in ``LEAST_TEXTS`` documents or more) are learnt; without that choice the rare words of toxic documents are learnt
by heart. Features are held as they are, not hashed, so no clean word meets a toxic one's weight.

Sentences end at ``. ! ?`` and line ends. Words are runs of ASCII letters and digits and of characters beyond ASCII, in
lower case.

Defined results: a null text is the empty text; a text without words has no sentence and score 0; labelled rows without
a document, without ``doc_id`` or without a label are ignored, a document with several labels counts with each, rows
that share a ``doc_id`` each learn from its label; without any usable label every score is 0.5, with labels of one class
it is that class; an empty table gives no rows; further columns are ignored. Scores of equal texts are equal.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.wordcodes import FIRST_WORD, PIECE_CODE, TEXT_CODE, fold_table, word_codes
from shelfwise.sources.shared import write_shared

THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0
#: Labelled documents to learn from, of each label; rows read for them, which repeated ids could make more.
SAMPLE, SAMPLE_ROWS = 2_000, 8_000
#: Lengths of the beginnings of words, and what a feature must show to be learnt.
BEGINNINGS, LEAST_Z, LEAST_TEXTS = (4, 5), 4.0, 3
#: Passes over the sample, step size and its damping, and the penalty of squared weights.
PASSES, RATE, DAMPING, PENALTY = 60, 0.15, 1e-4, 1e-5
#: Characters scored at a time, and words whose weight a task remembers.
STEP_CHARS, REMEMBERED = 4_000_000, 1_000_000

_ENDS = b".!?\n\x0b\x0c\r"
_SPACES = bytes(b for b in range(128) if not chr(b).isalnum() and b not in _ENDS)
_TABLE = fold_table(_SPACES, _ENDS)
_END = re.compile("[.!?\n\x0b\x0c\r]")


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings, by their length."""
    text = word.decode()
    return [b"=" + word, *(b"%d%s" % (n, text[:n].encode()) for n in BEGINNINGS if len(text) >= n)]


@dataclass
class Sentences:
    """The sentences with words of several texts: words as numbers, sentence after sentence."""

    words: pa.Array
    word: np.ndarray  # of each occurrence
    start: np.ndarray  # of each sentence among the occurrences
    place: np.ndarray  # number of the sentence in its text, those without words included
    text: np.ndarray  # of each sentence
    texts: int

    @classmethod
    def of(cls, texts: Iterable[str | None]) -> Sentences:
        lowered = [(t or "").lower().encode() for t in texts]
        codes, words = word_codes(lowered, _TABLE)
        # marks of a text stand before it
        text = np.cumsum(codes == TEXT_CODE) - 1
        mark = codes < FIRST_WORD
        sentence = np.cumsum(mark)
        of_first = np.flatnonzero(codes == TEXT_CODE)
        is_word = ~mark
        own = sentence[is_word]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        number = text[is_word][start]
        return cls(words, codes[is_word] - FIRST_WORD, start, own[start] - sentence[of_first[number]], number, len(lowered))

    def logits(self, weight: np.ndarray, bias: float) -> np.ndarray:
        return np.add.reduceat(weight[self.word], self.start) + bias if len(self.start) else np.zeros(0)

    def clear(self, logits: np.ndarray) -> np.ndarray:
        """Log probability that no sentence of a text is toxic."""
        return np.bincount(self.text, -np.logaddexp(0, logits), self.texts) if len(logits) else np.zeros(self.texts)


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float
    constant: float | None = None  # the score of every text where nothing was to be learnt

    def word_weights(self) -> Callable[[pa.Array], np.ndarray]:
        """A function to the weights of words, which remembers those it has met."""
        known: dict[bytes, float] = {}

        def of(words: pa.Array) -> np.ndarray:
            if len(known) > REMEMBERED:
                known.clear()
            listed = words.to_pylist()
            for word in listed:
                if word not in known:
                    known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
            return np.fromiter(map(known.__getitem__, listed), float, len(listed))

        return of


def _telling(held: Sentences, labels: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Features that go with the label, and which words hold them: numbers of features and of words, pair by pair."""
    numbers: dict[bytes, int] = {}
    of_word = [[numbers.setdefault(f, len(numbers)) for f in features(w)] for w in held.words.to_pylist()]
    sizes = np.fromiter(map(len, of_word), np.int64, len(of_word))
    feature = np.fromiter((f for its in of_word for f in its), np.int64, int(sizes.sum()))
    word = np.repeat(np.arange(len(sizes)), sizes)
    lengths = np.diff(np.r_[held.start, len(held.word)])
    met = np.unique(np.repeat(held.text, lengths).astype(np.int64) << 32 | held.word)
    text, met_word = met >> 32, met & 0xFFFFFFFF
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    spread = np.repeat(first[met_word], sizes[met_word]) + _steps(sizes[met_word])
    held_by = np.unique(np.repeat(text, sizes[met_word]) << 32 | feature[spread])
    by_label = [np.bincount((held_by & 0xFFFFFFFF)[labels[held_by >> 32] == y], minlength=len(numbers)) for y in (0, 1)]
    n = [max(int((labels == y).sum()), 1) for y in (0, 1)]
    pooled = (by_label[0] + by_label[1]) / (n[0] + n[1])
    spread_of = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n[0] + 1 / n[1]))
    z = (by_label[1] / n[1] - by_label[0] / n[0]) / spread_of
    kept = (np.abs(z) >= LEAST_Z) & (by_label[0] + by_label[1] >= LEAST_TEXTS)
    place = np.cumsum(kept) - 1
    pairs = kept[feature]
    return [f for f, k in zip(numbers, kept.tolist(), strict=True) if k], place[feature[pairs]], word[pairs]


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def train(texts: list[str], labels: np.ndarray, row_weights: np.ndarray, passes: int = PASSES, rate: float = RATE) -> Model:
    """Weights of the features from labelled texts, by Adam on the weighted log loss of the noisy-or."""
    held = Sentences.of(texts)
    if not len(held.start):
        return Model({}, 0.0, float((row_weights * labels).sum() / row_weights.sum()))
    names, feature, word = _telling(held, labels)
    sentence = np.repeat(np.arange(len(held.start)), np.diff(np.r_[held.start, len(held.word)]))
    marked = np.isin(held.word, word)  # other words weigh nothing
    occurring, sentence = held.word[marked], sentence[marked]
    row_weights = row_weights / row_weights.sum()
    share = float((row_weights * labels).sum())
    weights, bias = np.zeros(len(names)), float(np.log(share / (1 - share) * len(texts) / len(held.start)))
    first, second = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, passes + 1):
        by_word = np.bincount(word, weights[feature], len(held.words))
        logits = np.bincount(sentence, by_word[occurring], len(held.start)) + bias
        clear = held.clear(logits)
        # the loss by a sentence's logit: p for a clean text, -p (1 - P) / P for a toxic one
        by_text = np.where(labels > 0, -np.exp(clear) / np.maximum(-np.expm1(clear), 1e-12), 1.0) * row_weights
        slope = by_text[held.text] * _logistic(logits)
        slope_of_word = np.bincount(occurring, slope[sentence], len(held.words))
        change = np.append(np.bincount(feature, slope_of_word[word], len(names)) + PENALTY * weights, slope.sum())
        first += 0.1 * (change - first)
        second += 0.01 * (change * change - second)
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + DAMPING)
        weights -= move[:-1]
        bias -= float(move[-1]) * 0.5
    return Model(dict(zip(names, weights.tolist(), strict=True)), bias)


def _logistic(logits: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -logits))


def fold(folds: int = FOLDS) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def fit(docs: DataFrame, marks: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``docs(doc_id, text)`` and ``marks(doc_id, label)``, by at most ``sample`` documents of each label.

    Which ones is drawn by a hash of the id from the narrow table of labels; only their texts come to the driver.
    """
    marks = marks.select("doc_id", (F.col("label") > 0).cast("int").alias("label"))
    chosen = None
    for label in (0, 1):
        own = marks.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # at most twice ``sample`` numbers and labels
    rows = docs.filter("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").limit(SAMPLE_ROWS).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
    labels = rows["label"].to_numpy()
    if len(set(labels.tolist())) < 2:
        return Model({}, 0.0, float(labels[0]) if len(labels) else 0.5)
    share = {label: counts[label] / max((labels == label).sum(), 1) for label in (0, 1)}
    return train(rows["text"].to_pylist(), labels, np.where(labels > 0, share[1], share[0]))


def _batches(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of an Arrow batch in steps of a bounded number of characters."""
    lengths = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    step = np.cumsum(lengths + 1) // STEP_CHARS
    bounds = [*np.flatnonzero(np.r_[True, step[1:] != step[:-1]]).tolist(), len(texts)] if len(texts) else [0]
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield a, texts[a:b].to_pylist()


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, worst, worst_score`` of ``docs(doc_id, text)``: the noisy-or, and the number and probability of the
    likeliest sentence (null in a text without words)."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("worst", pa.int32()), ("worst_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = model.word_weights()
        for batch in batches:
            for at, texts in _batches(batch.column("text")):
                held = Sentences.of(texts)
                logits = held.logits(weigh(held.words), model.bias)
                score = -np.expm1(held.clear(logits))
                # of equal ones the first
                order = np.lexsort((held.place, -logits, held.text))
                best = order[np.flatnonzero(np.r_[True, held.text[order][1:] != held.text[order][:-1]])] if len(order) else order
                worst, chance = np.full(len(texts), -1), np.zeros(len(texts))
                worst[held.text[best]], chance[held.text[best]] = held.place[best], _logistic(logits[best])
                if model.constant is not None:
                    score = np.full(len(texts), model.constant)
                none = worst < 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at : at + len(texts)], pa.array(np.clip(score, 0, 1)), pa.array(worst, pa.int32(), mask=none), pa.array(chance, mask=none)],
                    schema=schema,
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, worst int, worst_score double")


def offending_sentences(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, sentence, start, length, score, content`` of the sentences of ``threshold`` or more.

    ``start`` and ``length`` count characters of the text; ``sentence`` is numbered from 0.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("sentence", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("content", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = model.word_weights()
        for batch in batches:
            for at, texts in _batches(batch.column("text")):
                held = Sentences.of(texts)
                p = _logistic(held.logits(weigh(held.words), model.bias))
                found = []
                spans: dict[int, list[int]] = {}
                for i in np.flatnonzero(p >= threshold).tolist():
                    its, place = int(held.text[i]), int(held.place[i])
                    if its not in spans:
                        spans[its] = [-1, *[m.start() for m in _END.finditer(texts[its])], len(texts[its])]
                    start, end = spans[its][place] + 1, spans[its][place + 1]
                    found.append((batch.column("doc_id")[at + its].as_py(), place, start, end - start, float(p[i]), texts[its][start:end]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    schema_text = "doc_id long, sentence int, start long, length long, score double, content string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema_text)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, sample: int = SAMPLE) -> Model:
    """A model from the labels outside the held-out fold."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    marks = marks.filter("label is not null and doc_id is not null").filter(fold(folds) != HELD_OUT)
    return fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), write_shared(marks, "marks"), sample)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, folds: int = FOLDS, sample: int = SAMPLE
) -> DataFrame:
    """``doc_id, held_out, score, predicted, worst_sentence, worst_score`` of ``docs(doc_id, text)``; labels of the
    held-out fold are never learnt from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_documents(docs, learn(docs, labels, label, folds, sample))
    return scored.select(
        "doc_id",
        F.coalesce(fold(folds) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.col("worst").alias("worst_sentence"),
        "worst_score",
    )
