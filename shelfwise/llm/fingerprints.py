"""Document fingerprints from closed syncmers.

A k-mer (15 bytes of UTF-8) is an anchor when the smallest hash among its inner substrings (8 of 8 bytes each) belongs
to the first or the last of them. Whether a k-mer is an anchor depends on nothing around it, so equal
passages have equal anchors, at the same distances, whatever was edited elsewhere. Seven k-mers in a row hold an anchor;
in a text of fewer that has none, the k-mer of the smallest hash is one. A text shorter than k is one anchor. ``anchors`` gives them with their positions.

A fingerprint has 64 coordinates: of the anchors' hashes the one nearest, by XOR, to a constant of the coordinate, of
which the low 16 bits are kept. The share of equal coordinates estimates the Jaccard likeness of two texts' anchors.
Only an empty text has no anchor: its fingerprint is empty, like another such and unlike all others.

Only DataFrame functions. Positions are generated and reduced within the task that holds the text, in generated code;
no anchor is shuffled. For the neighbour in the order of ``doc_id``, rows are dealt by blocks of ids; a window looks
inside a block, and only the first row of each block is joined to the block before it.

Defined results: a null text is the empty text; a null ``doc_id`` is the last in descending order; rows that share a
``doc_id`` follow each other by a hash of their text; a lone row is its own neighbour; an empty table gives no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.sources.shared import broadcast_if_small, write_shared

INNER, PLACES = 8, 8
COORDINATES, KEPT_BITS = 64, 16
#: Ids of a block are equal but for this many low bits; the blocks of a group of blocks likewise.
BLOCK_BITS, GROUP_BITS = 8, 12
SPREAD = 0x9E3779B97F4A7C15
_NO_BLOCK = -(2**62)


def _constants(count: int) -> list[int]:
    """Signed 64-bit constants whose leading bits count up."""
    bits = (count - 1).bit_length()
    values = [(j << (64 - bits)) | ((j + 1) * SPREAD % (1 << (64 - bits))) for j in range(count)]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def _candidates(df: DataFrame, keep: list[str], data: str, inner: int, places: int) -> DataFrame:
    """``keep`` columns, ``position``, ``anchor`` and ``sure``: all anchors, and of a text with too few k-mers to be sure of
    one also the other k-mers."""
    size = inner + places - 1
    at = F.expr(f"sequence(0, greatest(0, length({data}) - {size}))")
    spread = df.filter(F.length(data) > 0).select(*keep, data, F.explode(at).alias("position"))
    part = lambda by, n: f"xxhash64(substring({data}, position + {1 + by}, {n}))"
    # the task's number is only there to keep the filter above the hashes, which it would else compute twice over
    hashed = spread.select(
        *keep, data, "position", *[F.expr(part(j, inner)).alias(f"h{j}") for j in range(places)],
        F.spark_partition_id().alias("task"),
    )
    least = F.least(*[f"h{j}" for j in range(places)])
    short = F.length(data) < size
    edge = short | (F.col("h0") == least) | (F.col(f"h{places - 1}") == least)
    few = F.length(data) < size + places - 2
    return hashed.filter((edge | few) & (F.col("task") >= 0)).select(*keep, "position", F.expr(part(0, size)).alias("anchor"), edge.alias("sure"))


def anchors(df: DataFrame, keep: list[str], data: str = "data", inner: int = INNER, places: int = PLACES) -> DataFrame:
    """``keep`` columns, ``position`` (bytes from 0) and ``anchor`` hash of the binary column ``data``.

    ``keep`` tells the texts apart.
    """
    found = _candidates(df, keep, data, inner, places)
    least = F.min(F.struct("anchor", "position")).alias("least")
    bare = found.groupBy(*keep).agg(least, F.bool_or("sure").alias("sure")).filter("not sure").select(*keep, "least.position", "least.anchor")
    return found.filter("sure").select(*keep, "position", "anchor").unionByName(bare)


def _ordered() -> list[Column]:
    return [F.desc_nulls_last("doc_id"), F.asc("tie")]


def _next_blocks(blocks: DataFrame) -> DataFrame:
    """``block, next_block``: the next lower block, after the lowest the highest. Two levels, so that no task holds
    all blocks: groups of blocks, and one row per group."""
    grouped = blocks.withColumn("group", F.shiftright("block", GROUP_BITS))
    inside = Window.partitionBy("group").orderBy(F.desc("block"))
    placed = grouped.withColumn("next_block", F.lead("block").over(inside))
    tops = grouped.groupBy("group").agg(F.max("block").alias("top"))
    over = Window.orderBy(F.desc("group"))
    following = F.coalesce(F.lead("top").over(over), F.first("top").over(over))
    tops = tops.select("group", following.alias("next_top"))
    return placed.join(tops, "group").select("block", F.coalesce("next_block", "next_top").alias("next_block"))


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the row that follows in descending ``doc_id``, and the row's ``number`` in its block.

    ``df`` has ``doc_id`` and ``tie``, which orders rows of one ``doc_id``; ``block`` is added.
    """
    df = df.withColumn("block", F.coalesce(F.shiftright("doc_id", BLOCK_BITS), F.lit(_NO_BLOCK)))
    window = Window.partitionBy("block").orderBy(*_ordered())
    inside = df.select(
        "*",
        F.row_number().over(window).alias("number"),
        F.lead(F.lit(True)).over(window).isNull().alias("is_last"),
        *[F.lead(c).over(window).alias(f"next_{c}") for c in columns],
    )
    top = F.max(F.struct("doc_id", F.bitwise_not("tie").alias("untie"))).alias("top")
    tops = df.groupBy("block").agg(top).select("block", "top.doc_id", F.bitwise_not("top.untie").alias("tie"))
    links = _next_blocks(tops.select("block")).select(F.col("block").alias("from_block"), F.col("next_block").alias("block"))
    wanted = broadcast_if_small(links.join(tops, "block")).alias("w")
    rows = df.alias("d")
    same = (F.col("d.block") == F.col("w.block")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.tie") == F.col("w.tie"))
    first = rows.join(wanted, same).select(
        F.col("w.from_block").alias("block"), *[F.col(f"d.{c}").alias(f"first_{c}") for c in columns]
    )
    first = first.dropDuplicates(["block"]).withColumn("is_last", F.lit(True))
    joined = inside.join(first, ["block", "is_last"], "left")
    following = [F.when(F.col("is_last"), F.col(f"first_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in columns]
    return joined.select(*df.columns, "number", *following)


def _likeness(left: str, right: str) -> Column:
    same = F.aggregate(F.zip_with(left, right, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    empty = F.size(left) + F.size(right)
    return F.when(empty == 0, 1.0).when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(same / F.lit(float(COORDINATES)))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of ``docs(doc_id, text)``.

    The edited text is the text with its last third replaced by as much of the beginning of the next document's, in
    descending ``doc_id`` and from the last to the first.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = with_next(texts.withColumn("tie", F.xxhash64("text")), ["text"])
    texts = texts.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), (F.col("n_chars") - third).cast("int")), F.col("next_text").substr(F.lit(1), third)
    )
    key = ["block", "number"]
    facts = ["doc_id", "tie", "n_chars", "edited_sha256"]
    both = texts.select(*key, "doc_id", "tie", "n_chars", F.array("text", edited).alias("forms"))
    forms = both.select(*key, F.posexplode("forms").alias("form", "held"))
    forms = forms.select(*key, "form", F.col("held").cast("binary").alias("data"))
    minima = [F.min(F.col("anchor").bitwiseXOR(F.lit(c))).alias(f"m{j}") for j, c in enumerate(_constants(COORDINATES))]
    kept = [F.col(f"m{j}").bitwiseAND(F.lit((1 << KEPT_BITS) - 1)).cast("int") for j in range(COORDINATES)]
    own_key = [*key, "form"]
    sketched = _candidates(forms, own_key, "data", INNER, PLACES).groupBy(*own_key, "sure").agg(*minima, F.min("anchor").alias("least"))
    lone = [F.col("least").bitwiseXOR(F.lit(c)).bitwiseAND(F.lit((1 << KEPT_BITS) - 1)).cast("int") for c in _constants(COORDINATES)]
    sketched = sketched.select(*own_key, "sure", F.when(F.col("sure"), F.array(*kept)).otherwise(F.array(*lone)).alias("marks"))
    # every document has a row of facts, also one without an anchor
    named = both.select(*key, "doc_id", "tie", "n_chars", F.sha2(F.get("forms", F.lit(1)), 256).alias("edited_sha256"))
    no_marks = F.array().cast("array<int>")
    paired = sketched.unionByName(named, allowMissingColumns=True).groupBy(*key).agg(
        *[F.max(c).alias(c) for c in facts],
        *[
            F.coalesce(*[F.max(F.when((F.col("form") == form) & sure, F.col("marks"))) for sure in (F.col("sure"), ~F.col("sure"))], no_marks).alias(name)
            for form, name in enumerate(("marks", "edited_marks"))
        ],
    )
    placed = with_next(write_shared(paired.drop(*key), "fingerprints"), ["marks"])
    text_of = lambda marks: F.array_join(F.transform(marks, lambda m: F.lpad(F.lower(F.hex(m)), KEPT_BITS // 4, "0")), "")
    return placed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of("marks").alias("fingerprint"),
        text_of("edited_marks").alias("edited_fingerprint"),
        _likeness("marks", "edited_marks").alias("near_edited"),
        _likeness("marks", "next_marks").alias("near_next"),
    )
