"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

Documents become pieces of at most ``capacity`` ids, only longer documents being cut. What fits together depends on
lengths alone, so the plan is made on the histogram (one count per length, ``capacity`` counts at most, whatever the
corpus): enumerate patterns of a few lengths that fill a sequence, fit how often each repeats by non-negative least
squares, round to what the counts allow, and pack the rest best fit, longest first, on counts again. A piece then
finds its place by its length and its number among the pieces of that length. No piece passes the driver, and no
task sees more than its own rows.

Defined results: a null text is the empty text, one piece holding the end id; an empty table gives no rows; repeated
``doc_id`` are packed as documents of their own; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import tokens
from shelfwise.sources.shared import write_shared

CAPACITY = 4096
END_ID = 1
#: Patterns enumerated in a round, documents in a pattern, rounds, and steps of the fit.
PATTERNS, PATTERN_DOCUMENTS, ROUNDS, STEPS = 40_000, 6, 4, 150
SEED = 7
#: Shares of the pieces that patterns are tried for.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, number long"


@dataclass
class Plan:
    """Sequences by pattern: ``lengths[i]`` stand one after another in ``repeats[i]`` sequences."""

    lengths: list[tuple[int, ...]]
    repeats: list[int]

    @property
    def sequences(self) -> int:
        return sum(self.repeats)

    def slots(self) -> pd.DataFrame:
        """One row per pattern and document: for which numbers of its length it holds places, and where."""
        first_sequence = np.concatenate([[0], np.cumsum(np.array(self.repeats, np.int64))])
        rows = []
        taken: Counter[int] = Counter()
        for i, (pattern, times) in enumerate(zip(self.lengths, self.repeats, strict=True)):
            offset = 0
            for length in pattern:
                rows.append((length, taken[length], first_sequence[i], offset))
                taken[length] += times
                offset += length
        slots = pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"], dtype=np.int64)
        return slots.sort_values(["length", "first"], ignore_index=True)


def enumerate_patterns(counts: np.ndarray, size: int, documents: int, rng: np.random.Generator) -> np.ndarray:
    """Distinct patterns of up to ``documents`` lengths, zeros behind, that fill a sequence as far as one more
    length can. Lengths are drawn as often as they occur, the longest first; the last is the best fit."""
    capacity = len(counts) - 1
    there = np.flatnonzero(counts)
    fitting = np.zeros(capacity + 1, np.int64)
    fitting[there] = there
    fitting = np.maximum.accumulate(fitting)
    weight = np.cumsum(counts)
    patterns = np.zeros((size, documents), np.int64)
    gap = np.full(size, capacity, np.int64)
    stop = rng.integers(1, documents, size)
    for k in range(documents):
        last = (k >= stop) | (k == documents - 1) | (gap < there[0])
        total = weight[gap]
        drawn = np.searchsorted(weight, np.floor(rng.random(size) * total), side="right")
        chosen = np.where(total > 0, np.minimum(drawn, capacity), 0)
        chosen = np.where(last, fitting[gap], chosen)
        chosen = np.where(chosen <= gap, chosen, 0)
        patterns[:, k] = chosen
        gap -= chosen
    patterns = -np.sort(-patterns, axis=1)
    filled = patterns.sum(axis=1)
    patterns = np.unique(patterns[filled > 0], axis=0)
    # the fullest first, so that a tie in the fit goes to them
    return patterns[np.argsort(-patterns.sum(axis=1), kind="stable")]


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative ``x`` with ``patterns`` times ``x`` close to ``counts``, by multiplicative least-squares steps.

    A length's squared error is divided by its count, so that rare lengths weigh as much as frequent ones.
    """
    flat = patterns.ravel()
    weight = 1.0 / np.maximum(counts, 1.0)
    weight[0] = 0.0
    target = (weight * counts)[patterns].sum(axis=1)
    x = np.full(len(patterns), counts.sum() / max((patterns > 0).sum(), 1))
    for _ in range(steps):
        made = np.bincount(flat, np.repeat(x, patterns.shape[1]), minlength=len(counts))
        x *= target / np.maximum((weight * made)[patterns].sum(axis=1), 1e-12)
    return x


def round_repeats(patterns: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole repeats that use no length more often than it occurs; ``counts`` is lowered by them."""
    repeats = np.zeros(len(patterns), np.int64)
    for wanted in (np.floor(x).astype(np.int64), (x - np.floor(x) > 0.25).astype(np.int64)):
        order = np.argsort(-x if wanted.max(initial=0) > 1 else -(x - np.floor(x)), kind="stable")
        for i in order[wanted[order] > 0].tolist():
            need = Counter(v for v in patterns[i].tolist() if v)
            times = min(int(wanted[i]), *(int(counts[v]) // n for v, n in need.items()))
            if times > 0:
                repeats[i] += times
                for v, n in need.items():
                    counts[v] -= n * times
    return repeats


def best_fit(counts: np.ndarray) -> Plan:
    """Best fit decreasing on counts: equal pieces go to equal gaps many at a time."""
    capacity = len(counts) - 1
    gaps: dict[int, list[list]] = {}  # gap -> [pattern, sequences] of that gap
    open_gaps = np.zeros(capacity + 1, bool)

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        gaps.setdefault(gap, []).append([pattern, times])
        open_gaps[gap] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            wide = np.flatnonzero(open_gaps[length:])
            if len(wide):
                gap = length + int(wide[0])
                entry = gaps[gap][-1]
                each = min(gap // length, left)
                times = min(entry[1], left // each)
                pattern = entry[0] + (length,) * each
                entry[1] -= times
                if not entry[1]:
                    gaps[gap].pop()
                    open_gaps[gap] = bool(gaps[gap])
            else:
                each = min(capacity // length, left)
                times = left // each
                pattern = (length,) * each
            put(pattern, times)
            left -= each * times
    entries = [e for same in gaps.values() for e in same]
    return Plan([tuple(e[0]) for e in entries], [e[1] for e in entries])


def _plan_of_share(
    counts: np.ndarray, share: float, size: int, documents: int, rounds: int, steps: int, seed: int
) -> Plan:
    """Patterns for a share of each length, best fit for the rest."""
    left = counts.copy()
    rng = np.random.default_rng(seed)
    full = len(left) - 1
    plan = Plan([(full,)], [int(left[full])]) if left[full] else Plan([], [])
    left[full] = 0
    for _ in range(rounds):
        fitted = np.floor(left * share).astype(np.int64)
        if not fitted.any():
            break
        patterns = enumerate_patterns(fitted, size, documents, rng)
        patterns = patterns[patterns.sum(axis=1) == full]
        if not len(patterns):
            break
        kept = left - fitted
        repeats = round_repeats(patterns, fit_repeats(patterns, fitted.astype(float), steps), fitted)
        left = fitted + kept
        used = np.flatnonzero(repeats)
        plan.lengths += [tuple(v for v in p if v) for p in patterns[used].tolist()]
        plan.repeats += repeats[used].tolist()
        if share < 1:
            break
    rest = best_fit(left)
    return Plan(plan.lengths + rest.lengths, plan.repeats + rest.repeats)


def make_plan(
    counts: np.ndarray, size: int = PATTERNS, documents: int = PATTERN_DOCUMENTS, rounds: int = ROUNDS,
    steps: int = STEPS, seed: int = SEED, shares: tuple[float, ...] = SHARES,
) -> Plan:
    """``counts[n]`` pieces of length ``n``, for ``n`` up to the capacity, as patterns and their repeats.

    What patterns leave over may fit together badly where most lengths are large. So patterns are tried for several
    ``shares`` of the pieces, and the plan of the fewest sequences is taken, the largest share among equals; a plan
    that reaches the bound of the lengths' sum ends the search.
    """
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    bound = -(-int((counts * np.arange(len(counts))).sum()) // (len(counts) - 1))
    best = None
    for share in shares:
        plan = _plan_of_share(counts, share, size, documents, rounds, steps, seed)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= bound:
            break
    return best


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, text)`` as pieces, each numbered within its task among the pieces of its length."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
        ("ids_crc32", pa.int64()), ("part", pa.int32()), ("number", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokens.tokenizer_path(tokenizer))
        part = TaskContext.get().partitionId()
        numbers = np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in tokens.in_batches(texts):
                ids, ends = encoder.encode(texts[a:b])
                ids = np.insert(ids, ends[1:], end_id).astype("<u4")
                ends = (ends + np.arange(len(ends))).tolist()
                rows = []
                for doc_id, begin, end in zip(doc_ids[a:b], ends[:-1], ends[1:], strict=True):
                    for piece, at in enumerate(range(begin, end, capacity)):
                        held = ids[at : min(at + capacity, end)]
                        length = len(held)
                        rows.append((doc_id, piece, at - begin, length, zlib.crc32(held), part, numbers[length]))
                        numbers[length] += 1
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, tokenizer: str = tokens.WORD_BPE, end_id: int = END_ID, capacity: int = CAPACITY,
    patterns: int = PATTERNS,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece of ``docs(doc_id, text)``.

    The pieces are written once, with their numbers, because the plan and the places have to be of one numbering.
    """
    spark = docs.sparkSession
    pieces = write_shared(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    cells = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("cell"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in cells.groupBy("length").agg(F.sum("cell").alias("n")).collect():
        counts[row["length"]] = row["n"]
    slots = make_plan(counts, patterns).slots()
    # bounded by the number of patterns and lengths, not by the corpus
    table = spark.sparkContext.broadcast(
        ((slots["length"].to_numpy() << 40) + slots["first"].to_numpy(), slots[["first", "sequence", "offset"]].to_numpy())
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("part", "length", F.coalesce(F.sum("cell").over(before), F.lit(0)).alias("skipped"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, places = table.value
        for frame in frames:
            number = (frame.pop("number") + frame.pop("skipped")).to_numpy()
            at = np.searchsorted(keys, (frame["length"].to_numpy() << 40) + number, side="right") - 1
            first, sequence, offset = places[at].T
            yield frame.assign(sequence_id=sequence + number - first, offset=offset)

    columns = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "number", "skipped"]
    return pieces.join(cells, ["part", "length"]).select(*columns).mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
