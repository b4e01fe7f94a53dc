"""A keyword index of immutable segments with block maxima, kept up to date by signed changes.

**Layout.** A segment is written once: its documents, sorted in their partition so that similar ones lie together, are
numbered in ranges of ``RANGE_ROWS``; ``RANGES`` of those make a shelf. ``blocks`` has one row for each term and range with
the postings and the largest part that any of them adds to a score, but for the idf. Each file is sorted by term, so a few
terms read a few row groups. Nothing is shuffled to build them. ``changes`` has the segment's contribution to the document frequencies, ``size`` the
one to the number and length of all documents.

**Changes.** Inserted documents become a segment. Deleted ones become tombstones ``(segment, id)`` and negative changes,
so frequencies, idf and mean length are at any time those of the living documents, whatever lies in the files.
``merge`` writes the living documents of some segments anew. Each step writes its files first and then one line into
``commits``; a step that dies before that line leaves files that nobody reads.

**Search.** Documents are not all scored. From the largest parts of a query's terms follows a bound for each range of
documents. It holds for any later mean length too: a part ``p`` computed at the mean length ``m`` of its segment is at
most ``p / (p + r (1 - p))`` at ``m'``, with ``r = min(1, m / m')``, because no norm shrinks by more than ``r``. The ranges of the highest bounds are scored first; the k-th best score found is a threshold, and a range whose bound is
below it is skipped with all its postings. Rounds grow until no range is left that could matter. The result is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.text import search_tokens
from shelfwise.operators import blocks as arrow
from shelfwise.operators.bm25 import count_documents, idf
from shelfwise.operators.vectors import RANK_DIGITS, top_per_query
from shelfwise.sources.shared import broadcast_if_small, write_shared

#: Documents in a range, and ranges in a shelf, which is what a task scores at a time.
RANGE_ROWS, RANGES = 16, 128
#: Postings that a task inverts at a time; a range stays whole.
INVERTED_POSTINGS = 250_000
#: Ranges scored in the first round, in multiples of the limit, and how much more in each further one.
FIRST_RANGES, GROWTH = 4, 64
#: Asked terms up to which they are a condition on the files, so that Parquet skips row groups.
LITERAL_TERMS = 500

_PART_BITS, _ROW_BITS = 30, 33
_COMMIT = "version int, kind string, segments array<string>, tombstones array<string>"


@dataclass(frozen=True)
class State:
    """What a reader sees: names of the segments and of the lists of deleted documents."""

    version: int
    segments: tuple[str, ...]
    tombstones: tuple[str, ...]


class SegmentIndex:
    """An index at ``path``; ``id_type`` is the type of the documents' ids, ``k1`` and ``b`` are those of BM25."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", k1: float = fixed.BM25_K1, b: float = fixed.BM25_B):
        self.spark, self.path, self.id_type, self.k1, self.b = spark, path.rstrip("/"), id_type, k1, b

    # --- writing -----------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, docs: DataFrame, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> SegmentIndex:
        """A new index of ``docs(id, text)``. ``k1`` and ``b`` are part of it; open it with the same."""
        index = cls(spark, path, dict(docs.dtypes)["id"], k1, b)
        index._commit(State(0, (), ()), "create")
        index.insert(docs)
        return index

    def insert(self, docs: DataFrame) -> None:
        """Add ``docs(id, text)``; an id that is there already is replaced. Ids are distinct in ``docs``."""
        state = self.state()
        name = self._write_segment(count_documents(docs))
        buried = self._bury(state, self._docs([name]).select("id")) if state.segments else None
        self._commit(state, "insert", added=[name], tombstones=buried)

    def delete(self, ids: DataFrame) -> None:
        """Remove the documents of ``ids(id)``; unknown ones are ignored."""
        state = self.state()
        self._commit(state, "delete", tombstones=self._bury(state, ids))

    def merge(self, segments: tuple[str, ...] | None = None) -> None:
        """Write the living documents of ``segments`` (all, if None) as one segment."""
        state = self.state()
        chosen = state.segments if segments is None else tuple(segments)
        if chosen:
            living = self._living(self._docs(chosen), state).select("id", "length", "terms")
            self._commit(state, "merge", added=[self._write_segment(living)], dropped=chosen)

    def _write_segment(self, indexed: DataFrame) -> str:
        name = uuid.uuid4().hex
        root = f"{self.path}/segments/{name}"
        # the most frequent term tells languages and registers apart, the smallest hash brings near copies together
        best = F.array_max(F.transform("terms", lambda t: F.struct(t["tf"], t["term"])))["term"]
        least = F.array_min(F.transform("terms", lambda t: F.xxhash64(t["term"])))
        number = F.monotonically_increasing_id()
        part, row = F.shiftright(number, _ROW_BITS), number.bitwiseAND((1 << _ROW_BITS) - 1)
        place = F.shiftleft(part, _PART_BITS) + F.floor(row / RANGE_ROWS).cast("long")
        # as columns: a sort by expressions over all terms would compute them anew in every comparison
        keyed = indexed.select("id", "length", "terms", best.alias("best"), least.alias("least"))
        ordered = keyed.sortWithinPartitions("best", "least", "id")
        ordered.select("id", "length", "terms", place.alias("range")).write.parquet(f"{root}/docs")

        docs = self.spark.read.parquet(f"{root}/docs")
        average = docs.agg(F.avg("length")).first()[0] or 0.0
        self._invert(docs, average).sortWithinPartitions("term", "range").write.parquet(f"{root}/blocks")
        blocks = self.spark.read.parquet(f"{root}/blocks")
        self._write_changes(f"{root}/changes", blocks.groupBy("term").agg(F.sum("n").cast("long").alias("df")))
        size = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("length"))
        size.write.parquet(f"{root}/size")
        return name

    def _invert(self, docs: DataFrame, average: float) -> DataFrame:
        """Blocks of ``docs``, built where they lie.

        A range that two tasks read has two blocks of a term: its bound is then a little high, its postings are whole.
        """
        k1, b = self.k1, self.b
        shape = f"range long, term string, n int, most double, average double, postings array<struct<id:{self.id_type},tf:int,length:int>>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _whole_ranges(batch, INVERTED_POSTINGS):
                    yield from _blocks_of(part, average, k1, b)

        return docs.select("id", "length", "terms", "range").mapInArrow(run, shape)

    def _write_changes(self, path: str, changes: DataFrame) -> None:
        changes.repartitionByRange("term").sortWithinPartitions("term").write.parquet(path)

    def _bury(self, state: State, ids: DataFrame) -> str:
        """Tombstones of the living documents among ``ids``, with the changes that take them out of the figures."""
        name = uuid.uuid4().hex
        root = f"{self.path}/tombstones/{name}"
        wanted = broadcast_if_small(ids.select("id").distinct())
        gone = write_shared(self._living(self._docs(state.segments), state).join(wanted, "id", "left_semi"), "gone")
        gone.select("segment", "id", "range").write.parquet(f"{root}/ids")
        terms = gone.select("segment", F.inline_outer("terms")).where("term is not null").groupBy("segment", "term")
        self._write_changes(f"{root}/changes", terms.agg((-F.count(F.lit(1))).alias("df")))
        size = gone.groupBy("segment").agg((-F.count(F.lit(1))).alias("n_docs"), (-F.sum("length")).cast("long").alias("length"))
        size.write.parquet(f"{root}/size")
        return name

    def _commit(
        self, state: State, kind: str, added: Sequence[str] = (), dropped: Sequence[str] = (), tombstones: str | None = None
    ) -> None:
        segments = [s for s in state.segments if s not in dropped] + list(added)
        buried = list(state.tombstones) + ([tombstones] if tombstones else [])
        if kind == "merge" and len(segments) == len(added):
            buried = []  # all lists speak of segments that are gone
        row = (state.version + 1, kind, segments, buried)
        self.spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("append").json(f"{self.path}/commits")

    # --- reading -----------------------------------------------------------------------------------

    def state(self) -> State:
        commits = self.spark.read.schema(_COMMIT).json(f"{self.path}/commits")
        last = commits.orderBy(F.desc("version")).first()
        if last is None:
            return State(0, (), ())
        return State(last["version"], tuple(last["segments"]), tuple(last["tombstones"]))

    def _segments(self, segments: Sequence[str], table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/segments/{n}/{table}" for n in segments]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        # the path of a row's file tells its segment; nothing about it has to be stored
        path = F.col("_metadata.file_path") if paths else F.lit("")
        return rows.withColumn("segment", F.regexp_extract(path, "/segments/([0-9a-f]+)/", 1))

    def _tombstones(self, state: State, table: str, schema: str) -> DataFrame:
        """Rows of the lists of deleted documents, as far as their segments are still read."""
        paths = [f"{self.path}/tombstones/{n}/{table}" for n in state.tombstones]
        schema = f"segment string, {schema}"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.filter(F.col("segment").isin(list(state.segments)))

    def _docs(self, segments: Sequence[str]) -> DataFrame:
        return self._segments(segments, "docs", f"id {self.id_type}, length int, terms array<struct<term:string,tf:int>>, range long")

    def _living(self, rows: DataFrame, state: State) -> DataFrame:
        if not state.tombstones:
            return rows
        dead = self._tombstones(state, "ids", f"id {self.id_type}")
        return rows.join(broadcast_if_small(dead), ["segment", "id"], "left_anti")

    def totals(self, state: State | None = None) -> DataFrame:
        """One row: ``n_docs, avg_length`` of the living documents."""
        state, schema = state or self.state(), "n_docs long, length long"
        both = self._segments(state.segments, "size", schema).unionByName(self._tombstones(state, "size", schema))
        n_docs = F.coalesce(F.sum("n_docs"), F.lit(0))
        return both.agg(n_docs.alias("n_docs"), F.try_divide(F.sum("length"), F.sum("n_docs")).alias("avg_length"))

    def term_statistics(self, asked: DataFrame | None = None, state: State | None = None) -> DataFrame:
        """``term, df, idf`` of the living documents, of all terms or of those in ``asked(term)``."""
        state, schema = state or self.state(), "term string, df long"
        changes = self._segments(state.segments, "changes", schema).unionByName(self._tombstones(state, "changes", schema))
        if asked is not None:
            changes = changes.join(broadcast_if_small(asked.select("term").distinct()), "term", "left_semi")
        n_docs = self.totals(state).select("n_docs").scalar()
        return changes.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").withColumn("idf", idf(F.col("df"), n_docs))

    # --- search ------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, limit: int = fixed.DEFAULT_LIMIT) -> tuple[DataFrame, DataFrame]:
        """Best ``limit`` documents for each of ``queries(qid, text)``: ``qid, id, score, rank``, and the work it took.

        The second frame has ``qid, postings, scored``: the postings of the query's terms, and those that were read.
        Documents without a match follow with score 0, lowest ids first. ``qid`` is distinct.
        """
        state = self.state()
        asked = queries.select("qid", F.explode_outer(F.array_distinct(search_tokens("text"))).alias("term")).where("term is not null")
        asked = write_shared(asked.join(self.term_statistics(asked, state).drop("df"), "term"), "asked")
        lists = write_shared(asked.groupBy("qid").agg(F.collect_list(F.struct("term", "idf")).alias("terms")), "asked_lists")
        average = self.totals(state).first()["avg_length"] or 0.0
        blocks = self._blocks(state, asked)
        bounds = write_shared(self._bounds(blocks, asked, average), "bounds")
        best = self.spark.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, id {self.id_type}, score double")
        left, rounds, take = bounds, [], FIRST_RANGES * limit
        order = Window.partitionBy("qid").orderBy(F.desc("bound"), "segment", "range")
        while not left.isEmpty():
            placed = write_shared(left.withColumn("place", F.row_number().over(order)), "placed")
            chosen = placed.filter(F.col("place") <= take).drop("place")
            rounds.append(chosen.groupBy("qid").agg(F.sum("n").alias("scored")))
            scored = self._score(chosen, lists, blocks, state, average, limit)
            best = write_shared(top_per_query(best.unionByName(scored), "score", limit).drop("rank"), "best")
            threshold = best.groupBy("qid").agg(F.min("score").alias("threshold"), F.count(F.lit(1)).alias("found"))
            threshold = threshold.filter(F.col("found") >= limit).drop("found")
            rest = placed.filter(F.col("place") > take).drop("place").join(threshold, "qid", "left")
            left = write_shared(rest.filter("threshold is null or bound >= threshold").drop("threshold"), "bounds")
            take *= GROWTH
        work = bounds.groupBy("qid").agg(F.sum("n").alias("postings"))
        if rounds:
            work = work.join(reduce(DataFrame.unionByName, rounds).groupBy("qid").agg(F.sum("scored").alias("scored")), "qid")
        filled = best.unionByName(self._unmatched(queries, best, state, limit))
        return top_per_query(filled, "score", limit), work

    def _blocks(self, state: State, asked: DataFrame) -> DataFrame:
        """Blocks of the terms in ``asked(term)``; a few terms are a condition on the files."""
        kind = f"array<struct<id:{self.id_type},tf:int,length:int>>"
        blocks = self._segments(state.segments, "blocks", f"range long, term string, n int, most double, average double, postings {kind}")
        terms = asked.select("term").distinct()
        few = [r["term"] for r in terms.limit(LITERAL_TERMS + 1).collect()]
        return blocks.filter(F.col("term").isin(few)) if len(few) <= LITERAL_TERMS else blocks.join(terms, "term", "left_semi")

    def _bounds(self, blocks: DataFrame, asked: DataFrame, average: float) -> DataFrame:
        """``qid, segment, range, bound, n``: what no document of a range can score above, and its matched postings."""
        shrunk = F.least(F.lit(1.0), F.col("average") / F.greatest(F.lit(average), F.lit(1e-300)))
        most = F.col("most") / (F.col("most") + shrunk * (1 - F.col("most")))
        matched = blocks.select("segment", "range", "term", "n", most.alias("most")).join(asked, "term")
        bounds = matched.groupBy("qid", "segment", "range").agg(F.sum(F.col("idf") * (self.k1 + 1) * F.col("most")).alias("bound"), F.sum("n").alias("n"))
        # sums of floats in another order, and the rounding of scores, must not lift a score above its bound
        return bounds.withColumn("bound", F.col("bound") + 10.0**-RANK_DIGITS)

    def _score(self, chosen: DataFrame, lists: DataFrame, blocks: DataFrame, state: State, average: float, limit: int) -> DataFrame:
        """Exact scores in the chosen ranges: the best ``limit`` of each query and shelf."""
        shelf = F.floor(F.col("range") / RANGES).alias("shelf")
        at = (F.col("range") % RANGES).cast("int").alias("at")
        wanted = chosen.select("qid", "segment", shelf, at).groupBy("qid", "segment", "shelf").agg(F.collect_list("at").alias("ranges"))
        wanted = wanted.join(lists, "qid")
        ranges = chosen.select("segment", "range").distinct()
        needed = blocks.join(ranges, ["segment", "range"], "left_semi").select("segment", shelf, at, "term", "postings")
        if state.tombstones:
            dead = self._tombstones(state, "ids", f"id {self.id_type}, range long")
            entry = F.struct("id", F.lit(0).alias("tf"), F.lit(0).alias("length"))
            buried = dead.groupBy("segment", shelf).agg(F.collect_list(entry).alias("postings"))
            needed = needed.unionByName(buried.withColumns({"at": F.lit(0), "term": F.lit(None).cast("string")}))
        needed = needed.withColumnsRenamed({"segment": "in_segment", "shelf": "in_shelf"})
        shape = f"qid {dict(chosen.dtypes)['qid']}, id {self.id_type}, score double"
        empty = self.spark.createDataFrame([], shape).toArrow()

        k1, b = self.k1, self.b

        def run(asked: pa.Table, entries: pa.Table) -> pa.Table:
            return _score_shelf(asked, entries, average, limit, k1, b, empty)

        both = wanted.groupBy("segment", "shelf").cogroup(needed.groupBy("in_segment", "in_shelf"))
        return both.applyInArrow(run, shape)

    def _unmatched(self, queries: DataFrame, best: DataFrame, state: State, limit: int) -> DataFrame:
        """For queries with fewer than ``limit`` matches, the documents of lowest ids among the others, with score 0."""
        found = queries.select("qid").join(best.groupBy("qid").agg(F.count(F.lit(1)).alias("found")), "qid", "left")
        short = found.filter(F.coalesce("found", F.lit(0)) < limit).select("qid")
        # such a query matches fewer than ``limit`` of the lowest 2 * limit ids
        lowest = self._living(self._docs(state.segments).select("segment", "id"), state).select("id").orderBy("id").limit(2 * limit)
        ids = [r["id"] for r in lowest.collect()]
        if not ids:
            return best.limit(0)
        pairs = short.select("qid", F.explode(F.array(*[F.lit(i) for i in ids]).cast(f"array<{self.id_type}>")).alias("id"))
        return pairs.join(best, ["qid", "id"], "left_anti").withColumn("score", F.lit(0.0)).select("qid", "id", "score")


def _whole_ranges(docs: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """``docs`` in parts of at most ``most`` postings, or of one range."""
    if not docs.num_rows:
        return
    place = docs.column("range").to_numpy()
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    held = pc.fill_null(pc.list_value_length(docs.column("terms")), 0).to_numpy(zero_copy_only=False)
    ends = np.r_[first, docs.num_rows].tolist()
    for ranges in arrow.text_slices(np.add.reduceat(held, first).tolist(), most):
        yield docs.slice(ends[ranges.start], ends[ranges.stop] - ends[ranges.start])


def _blocks_of(docs: pa.RecordBatch, average: float, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """Postings of adjacent documents by range and term."""
    row, entries = arrow.list_entries(docs.column("terms"))
    if not len(row):
        return
    term = entries.field("term").dictionary_encode()
    code = term.indices.to_numpy(zero_copy_only=False)
    place = docs.column("range").to_numpy()[row]
    order = np.lexsort((code, place))
    row, code, place = row[order], code[order], place[order]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (code[1:] != code[:-1])])
    tf = entries.field("tf").to_numpy(zero_copy_only=False)[order]
    length = docs.column("length").to_numpy()[row]
    part = tf / np.maximum(tf + k1 * (1 - b + b * length / max(average, 1e-300)), 1e-300)
    bounds = np.r_[first, len(row)]
    postings = pa.StructArray.from_arrays([docs.column("id").take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(length, pa.int32())], ["id", "tf", "length"])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(place[first]), term.dictionary.take(pa.array(code[first])), pa.array(np.diff(bounds), pa.int32()),
            pa.array(np.maximum.reduceat(part, first)), pa.array(np.full(len(first), average)),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), postings),
        ],
        ["range", "term", "n", "most", "average", "postings"],
    )


def _score_shelf(asked: pa.Table, entries: pa.Table, average: float, limit: int, k1: float, b: float, empty: pa.Table) -> pa.Table:
    """Scores of the documents in the asked ranges of a shelf; entries without a term list the deleted documents."""
    if not asked.num_rows or not entries.num_rows:
        return empty
    row, postings = arrow.list_entries(entries["postings"])
    ids, doc = np.unique(arrow.id_array(postings.field("id")), return_inverse=True)
    tf = postings.field("tf").to_numpy(zero_copy_only=False)
    length = postings.field("length").to_numpy(zero_copy_only=False)
    codes = entries["term"].combine_chunks().dictionary_encode()
    code = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    living = ~np.isin(np.arange(len(ids)), doc[code[row] < 0])
    part = tf / np.maximum(tf + k1 * (1 - b + b * length / average), 1e-300)
    sizes = np.bincount(row, minlength=entries.num_rows)
    starts = np.cumsum(sizes) - sizes
    at = entries["at"].to_numpy()

    query, terms = arrow.list_entries(asked["terms"])
    term = pc.index_in(terms.field("term"), value_set=codes.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
    weight = terms.field("idf").to_numpy(zero_copy_only=False) * (k1 + 1)
    range_query, range_at = arrow.list_entries(asked["ranges"])
    open_ = np.zeros((asked.num_rows, RANGES), bool)
    open_[range_query, range_at.to_numpy(zero_copy_only=False)] = True
    bounds = np.searchsorted(query, np.arange(asked.num_rows + 1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(asked.num_rows):
        own = slice(bounds[i], bounds[i + 1])
        held = term[own] >= 0
        by_code = np.zeros(len(codes.dictionary) + 1)  # the last for entries without a term
        by_code[term[own][held]] = weight[own][held]
        read = np.flatnonzero((by_code[code] > 0) & open_[i, at])
        if not len(read):
            continue
        many = sizes[read]
        posting = np.repeat(starts[read] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        score = np.round(np.bincount(doc[posting], part[posting] * np.repeat(by_code[code[read]], many), len(ids)), RANK_DIGITS)
        found = np.flatnonzero((score > 0) & living)
        if len(found) > limit:
            found = found[score[found] >= np.partition(score[found], -limit)[-limit]]
        found = found[np.lexsort((ids[found], -score[found]))][:limit]
        out.append((np.full(len(found), i), ids[found], score[found]))
    if not out:
        return empty
    queries, found_ids, scores = (np.concatenate(c) for c in zip(*out, strict=True))
    qids = asked["qid"].combine_chunks().take(pa.array(queries))
    return pa.table([qids, pa.array(found_ids).cast(empty.schema.field("id").type), pa.array(scores)], schema=empty.schema)
