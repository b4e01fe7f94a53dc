"""Near-duplicate documents by circulant MinHash over word shingles.

Words are runs without ASCII white space, A-Z lower-cased. A document's set is its distinct shingles of five words;
a document of fewer words is one shingle, one without words has an empty set and is linked with nothing.

Circulant MinHash needs two permutations of the shingle space (the integers below 2**32 here): the first scatters
the shingles, the second, shifted by k places, gives the k-th signature coordinate as its minimum over the set. Both
are bijective integer mixings, so a coordinate costs one subtraction and one mixing. 125 of the 128 coordinates form
25 bands of 5 rows; the lowest bits of all 128 are the sketch. At a similarity of 0.85 a pair misses every band
with a probability of 4e-7 (5e-5 at 0.8), and the sketch test with less than 1e-6.

Equal sets are grouped first, by a 128-bit digest, so only one document of them is banded; ``near.py`` confirms
every link on full sets (of 64-bit shingle hashes).

Defined results: a null or empty text has no shingles, is linked with nothing and is kept; a row without ``doc_id``
is returned with null ``component_id`` and kept; rows that share a ``doc_id`` are one document of several texts, of
which any may link; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import near
from shelfwise.sources.shared import broadcast_if_small, write_shared

SHINGLE_WORDS = 5
PERCENT = 85
BANDS, ROWS, COORDINATES = 25, 5, 128
#: Deviations above the expected number of unequal sketch bits at which a pair is still looked at.
DEVIATIONS = 5.5
#: Shingles whose coordinates are computed at a time, for the processor's cache.
BLOCK = 1024

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix32(x: np.ndarray) -> None:
    """A bijection of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors)
    return _powers[0][:n], _powers[1][:n]


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    data = np.frombuffer((text or "").encode().translate(_LOWER), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    word = _mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    size = min(words, len(word))
    mixed = np.full(len(word) - size + 1, size, np.uint64)
    for j in range(size):
        mixed = _mix64(mixed + word[j : j + len(mixed)])
    return np.unique(mixed)


def signature(hashes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Coordinate k is the least image, under the second permutation shifted by k, of the scattered shingles."""
    scattered = (hashes >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(scattered), BLOCK):
        moved = scattered[None, at : at + BLOCK] - shift
        _mix32(moved)
        np.minimum(least, moved.min(axis=1), out=least)
    return least


def bands(least: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = least[: count * rows].reshape(count, rows).astype(np.uint64)
    key = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_BASE)
    for j in range(rows):
        key = _mix64(key + parts[:, j])
    return key.view(np.int64)


def most_unequal_bits(percent: int, bits: int = COORDINATES) -> int:
    """Sketch bits that a pair of the least similarity can differ in: a bit differs with half the chance of a coordinate."""
    chance = (1 - percent / 100) / 2
    return math.ceil(bits * chance + DEVIATIONS * math.sqrt(bits * chance * (1 - chance)))


def sign_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, sketch_a, sketch_b`` of ``docs(doc_id, text)``."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
        ("bands", pa.list_(pa.int64())), ("sketch_a", pa.int64()), ("sketch_b", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = shingles(text)
                if len(found):
                    least = signature(found)
                    bits = np.packbits((least & np.uint32(1)).astype(np.uint8)).view(np.int64)
                    digest = xxhash.xxh3_128_digest(found)
                    rows.append((doc_id, len(found), digest, bands(least), int(bits[0]), int(bits[1])))
                else:
                    rows.append((doc_id, 0, None, None, None, None))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch_a long, sketch_b long"
    )


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``id, held`` of ``docs(doc_id, text)``: the hashes of the shingles."""
    schema = pa.schema([("id", pa.int64()), ("held", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), 256):
                sets = [shingles(t).view(np.int64) for t in texts[at : at + 256].to_pylist()]
                columns = [batch.column("doc_id")[at : at + 256], pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "id long, held array<long>")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = write_shared(sign_documents(docs), "signed")
    named = signed.filter("doc_id is not null and n_shingles > 0")
    copies = named.groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = broadcast_if_small(write_shared(copies.select("digest", "copy_of"), "copies"))
    copied = signed.join(copies, "digest", "left")
    alone = named.join(copies, "digest", "left").filter("copy_of is null or copy_of = doc_id")
    items = write_shared(
        alone.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "digest", "bands", "sketch_a", "sketch_b")
        .dropDuplicates(["id", "digest"])
        .drop("digest"),
        "items",
    )

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        return shingle_sets(asked)

    found = broadcast_if_small(near.linked_components(items, sets_of, percent, most_unequal_bits(percent)))
    component = F.coalesce("component", "copy_of", "doc_id")
    placed = copied.withColumn("id", F.coalesce("copy_of", "doc_id")).join(found, "id", "left")
    return placed.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the near copies: of each component the smallest ``doc_id`` stays, with all its columns."""
    gone = near_duplicates(docs, percent).filter("not kept").select("doc_id").distinct()
    gone = broadcast_if_small(write_shared(gone, "gone"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
