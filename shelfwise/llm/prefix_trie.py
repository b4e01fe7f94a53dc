"""A prefix trie over conversations, peeled from its deepest turns upwards.

A node stands for a distinct sequence of first turns. The trie is never built by descending: each task takes a range of
the conversations in the order of their turns' digests and peels it. It starts at the range's greatest depth; at every
depth the conversations that end there join the nodes that were stripped of their last turn, equal ones merge into one
node, its figures are final, and it is stripped in turn. So nodes are found and aggregated in one pass, and a node
of any size lies in as many ranges as its members fill.

Only nodes on the path of a range's first or last conversation can go on in another range. Those are left open: their
partial figures, at most two for each depth and range, are added up by the node's key afterwards. What a whole node
adds to the figures above it is already in its range's sums; an open node's own leaf and saved tokens are credited once,
in the first range that holds it, and passed up that range's two paths.

Turns are digests from the start (128 bits of role and text, with the text's size), so no text is shuffled. A
conversation is one array of 28 bytes a turn.

Defined results: rows without ``conv_id`` belong to no conversation and are left out; a null role or text is empty;
turns with one number go by their digest, equal rows stay several turns; a conversation without rebuilt turns is a
member of the root; an empty table has no root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.sources.shared import broadcast_if_small, write_shared

#: Conversations share up to ``HEADS - 1`` first turns with the first of every ``FAMILY``.
FAMILY, HEADS = 5, 9
#: Characters of a list of conversation numbers that travel in one row.
LIST_CHARS = 16_384
DIGEST = 16
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

_NOBODY = hashlib.sha256(b"").hexdigest()
_SHAPE = (
    "open boolean, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, part int, side int, bytes long, ends array<string>"
)
_ARROW_TYPES = {"boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(name, _ARROW_TYPES[kind]) for name, kind in (field.split() for field in _SHAPE.split(", "))])


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of a turn; the role's size keeps role and text apart."""
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def conversation_paths(turns: DataFrame) -> DataFrame:
    """``conv_id, turns array<struct<digest, bytes>>`` of ``turns(conv_id, turn, role, text)``, in order of the turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct("turn", turn_digest(role, text).alias("digest"), F.octet_length(text).alias("bytes"))
    gathered = turns.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
    ordered = gathered.agg(F.sort_array(F.collect_list(one)).alias("all"))
    return ordered.select("conv_id", F.transform("all", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def share_heads(paths: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """``paths`` with the first turns of each conversation taken from the first of its family.

    The number of turns is ``crc32(conv_id) % heads``; where that conversation has fewer, or doesn't exist, what it has.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    donors = paths.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    joined = paths.withColumn("base", base).withColumn("taken", taken).join(donors, "base", "left")
    own = F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.slice("head", F.lit(1), F.col("taken"))
    return joined.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(head, own)).alias("turns"))


class _Range:
    """The conversations of a range, in the order of their paths and then of their numbers."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        self.ids = table["conv_id"].to_numpy()
        path = table["path"].combine_chunks()
        size = table["size"].combine_chunks()
        self.lengths = np.diff(np.array(path.offsets)).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        joined = b"".join(path.flatten().to_pylist())
        self.digests = np.frombuffer(joined, "<u8").reshape(-1, 2)
        self.sizes = size.flatten().to_numpy().astype(np.int64)
        self.joined = joined
        self.common = self._common()

    def _common(self) -> np.ndarray:
        """Turns that each conversation shares with the one before it; -1 for the first."""
        both = np.minimum(self.lengths[1:], self.lengths[:-1])
        out = np.full(len(self.lengths), -1)
        out[1:] = both
        some = np.flatnonzero(both)
        if len(some):
            counts = both[some]
            first = np.r_[0, np.cumsum(counts)[:-1]]
            step = np.arange(counts.sum()) - np.repeat(first, counts)
            left = np.repeat(self.starts[:-1][some], counts) + step
            right = np.repeat(self.starts[1:-1][some], counts) + step
            differ = (self.digests[left] != self.digests[right]).any(axis=1)
            out[some + 1] = np.minimum.reduceat(np.where(differ, step, np.repeat(counts, counts)), first)
        return out

    def keys(self, at: int) -> list[bytes]:
        """Keys of all prefixes of a conversation, the empty one first."""
        running = hashlib.blake2b(digest_size=DIGEST)
        found = [running.digest()]
        path = self.joined[self.starts[at] * DIGEST : self.starts[at + 1] * DIGEST]
        for i in range(0, len(path), DIGEST):
            running.update(path[i : i + DIGEST])
            found.append(running.digest())
        return found


def _pieces(ids: list[int]) -> list[str]:
    """Numbers, comma-joined, in pieces of about ``LIST_CHARS``; a piece after the first starts with its comma."""
    step = LIST_CHARS // 20
    texts = [",".join(map(str, ids[i : i + step])) for i in range(0, len(ids), step)]
    return texts[:1] + ["," + t for t in texts[1:]]


def _peel(held: _Range, part: int) -> Iterator[pa.RecordBatch]:
    """Nodes of a range, deepest first: whole ones with all figures, open ones with what the range knows of them."""
    count, deepest = len(held.ids), int(held.lengths.max())
    first_keys, last_keys = held.keys(0), held.keys(count - 1)
    by_length = np.argsort(held.lengths, kind="stable")
    bounds = np.searchsorted(held.lengths[by_length], np.arange(deepest + 2))

    # the nodes of the depth below: first and last member, figures, whether open
    none = np.zeros(0, np.int64)
    first, last, members, conv, leaves, saved, is_open = none, none, none, none, none, none, none.astype(bool)
    waiting: dict = {}
    for depth in range(deepest, -1, -1):
        ended = np.sort(by_length[bounds[depth] : bounds[depth + 1]])
        below = len(first)
        active = np.concatenate([first, ended])
        order = np.argsort(active, kind="stable")
        # equal prefixes stand next to each other; a new node starts where fewer turns are shared
        group = np.cumsum(held.common[active[order]] < depth) - 1
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        node = np.empty(len(active), np.int64)
        node[order] = group

        def total(values: np.ndarray, node: np.ndarray = node, nodes: int = len(starts)) -> np.ndarray:
            out = np.zeros(nodes, np.int64)
            np.add.at(out, node[: len(values)], values)
            return out

        all_children, whole_children = total(np.ones(below, np.int64)), total((~is_open).astype(np.int64))
        under_leaves, under_saved = total(leaves), total(saved)
        members = total(np.concatenate([members, np.ones(len(ended), np.int64)]))
        conv = np.minimum.reduceat(np.concatenate([conv, held.ids[ended]])[order], starts)
        last = np.maximum.reduceat(np.concatenate([last, ended])[order], starts)
        first = active[order][starts]
        is_open = (first == 0) | (last == count - 1)
        side = np.where((first == 0) & (last == count - 1), 0, np.where(first == 0, 1, 2))
        keys = [(first_keys if s < 2 else last_keys)[depth] if o else None for o, s in zip(is_open.tolist(), side.tolist(), strict=True)]
        if waiting:  # the nodes below know their parents now
            of = node[:below]
            yield _rows(waiting, conv[of], [keys[i] for i in of.tolist()], is_open[of])
        size = held.sizes[held.starts[first] + depth - 1] if depth else np.zeros(len(first), np.int64)
        leaves = under_leaves + np.where(~is_open & (all_children == 0), 1, 0)
        saved = under_saved + np.where(is_open, 0, (members - 1) * size)
        ends: list[list[int]] = [[] for _ in first]
        for its, number in zip(node[below:].tolist(), held.ids[ended].tolist(), strict=True):
            ends[its].append(number)
        waiting = {
            "open": is_open, "key": keys, "depth": np.full(len(first), depth), "conv_id": conv, "n_convs": members, "n_children": whole_children,
            "n_leaves": leaves, "saved_tokens": saved, "ends": ends, "part": np.full(len(first), part), "side": side, "bytes": size,
        }
    yield _rows(waiting, conv, [None] * len(conv), np.ones(len(conv), bool))


def _rows(nodes: dict, parents: np.ndarray, parent_keys: list[bytes | None], parent_open: np.ndarray) -> pa.RecordBatch:
    """Nodes with their parents: its conversation where the range knows it, else its key."""
    is_open = nodes["open"].tolist()
    columns = nodes | {
        "parent_key": parent_keys,
        "parent_conv_id": pa.array(parents, mask=parent_open),
        "ends_sha256": [None if o else hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() if e else _NOBODY for o, e in zip(is_open, nodes["ends"], strict=True)],
        "ends": [_pieces(e) if o and e else None for o, e in zip(is_open, nodes["ends"], strict=True)],
    }
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW)


def _peel_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield from _peel(_Range(held), TaskContext.get().partitionId())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each key, which follow one another; one piece is held at a time."""
    now, running = None, None
    for batch in batches:
        for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if key != now:
                if running:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], ["key", "ends_sha256"])
                now, running = key, hashlib.sha256()
            elif not piece.startswith(","):
                running.update(b",")  # the next range's list
            running.update(piece.encode())
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], ["key", "ends_sha256"])


def _merge_open(rows: DataFrame) -> DataFrame:
    """Open nodes with the figures of all ranges, from one row for each range that a node lies in."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = rows.groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
        F.min("part").alias("owner"), F.first("bytes").alias("bytes"), *sums,
    )
    nodes = write_shared(nodes, "open_nodes")
    more = nodes.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(more, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = nodes.select(
        "key", "owner", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own")
    )
    # each node's own leaf and saving, passed up the paths of the first range that holds it: a range has two paths
    here = F.col("part") == F.col("owner")
    placed = rows.select("key", "part", "depth", "side").join(own, "key")
    placed = placed.withColumn("leaf", F.when(here, F.col("leaf")).otherwise(0)).withColumn("own", F.when(here, F.col("own")).otherwise(0))
    down = Window.orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both, arm = down.partitionBy("part"), down.partitionBy("part", "side")

    def below(value: str) -> Column:
        return F.when(F.col("side") == 0, F.sum(value).over(both)).otherwise(F.sum(value).over(arm))

    passed = placed.select("key", below("leaf").alias("leaf"), below("own").alias("own")).groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    listed = rows.filter("ends is not null").select("key", "part", F.posexplode("ends").alias("at", "piece"))
    listed = listed.repartition("key").sortWithinPartitions("key", "part", "at").select("key", "piece")
    digests = listed.mapInArrow(_digests, "key binary, ends_sha256 string")
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(passed, "key").join(digests, "key", "left").join(parents, "parent_key", "left").select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NOBODY)).alias("ends_sha256"),
    )


def prefix_trie(paths: DataFrame) -> DataFrame:
    """Nodes of the trie over ``paths(conv_id, turns)``, of distinct ``conv_id``.

    ``conv_id`` is a node's smallest member; ``n_leaves`` and ``saved_tokens`` cover its subtree with itself;
    ``ends_sha256`` digests the members that end there.
    """
    rows = paths.select("conv_id", F.col("turns.digest").alias("path"), F.col("turns.bytes").alias("size"))
    ranges = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    peeled = write_shared(ranges.mapInArrow(_peel_ranges, _SHAPE), "peeled")
    merged = write_shared(_merge_open(peeled.filter("open")), "merged")
    whole = peeled.filter("not open").select("parent_key", *[c for c in COLUMNS])
    parents = broadcast_if_small(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")))
    hung = whole.filter("parent_key is not null").join(parents, "parent_key").withColumn("parent_conv_id", F.col("above"))
    inner = whole.filter("parent_key is null")
    return merged.select(*COLUMNS).unionByName(inner.select(*COLUMNS)).unionByName(hung.select(*COLUMNS))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie over ``turns(conv_id, turn, role, text)`` after conversations took the heads of their families."""
    paths = write_shared(conversation_paths(turns), "paths")
    return prefix_trie(write_shared(share_heads(paths), "rebuilt"))
