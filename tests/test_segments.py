"""The segmented index against plain Python, through inserts, deletes and merges."""

import math
import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from test_search import best, by_query, scores

from registry import queries as registered
from shelfwise.operators import segments
from shelfwise.operators.segments import SegmentIndex

WORDS = [f"w{i}" for i in range(60)]
DOCS = "id long, text string"


def corpus(seed, first, count):
    """Texts whose frequent words come in families, so that ranges of documents differ."""
    rng = random.Random(seed)
    out = {}
    for i in range(first, first + count):
        family = rng.choice([0, 20, 40])
        out[i] = " ".join(WORDS[family + min(int(rng.expovariate(0.3)), 19)] for _ in range(rng.randint(0, 25)))
    return out


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), DOCS).repartition(3)


ASKED = {1: "w0 w3 w5", 2: "w41 w42", 3: "w19", 4: "nothing here", 5: " ".join(WORDS), 6: "w0 w0 W20!", 7: ""}


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(segments, "RANGE_ROWS", 4)
    monkeypatch.setattr(segments, "RANGES", 8)
    monkeypatch.setattr(segments, "FIRST_RANGES", 1)
    monkeypatch.setattr(segments, "GROWTH", 2)


def check(index, docs, spark, limit=7):
    asked = spark.createDataFrame(list(ASKED.items()), "qid long, text string")
    found, work = index.search(asked, limit)
    found = by_query(found, "id", "score")
    for q, text in ASKED.items():
        expected = scores(docs, text)
        assert [i for i, _ in found[q]] == best(expected, limit), text
        assert [s for _, s in found[q]] == pytest.approx([expected[i] for i, _ in found[q]], abs=1e-8)
    return {r["qid"]: r for r in work.collect()}


def test_ranking_is_exact_and_blocks_are_skipped(spark, tmp_path, small_ranges):
    docs = corpus(1, 0, 400)
    work = check(SegmentIndex.create(spark, str(tmp_path / "index"), frame(spark, docs)), docs, spark)
    postings = sum(text.split().count("w19") > 0 for text in docs.values())
    assert work[3]["postings"] == postings
    assert all(r["scored"] <= r["postings"] for r in work.values())
    assert work[2]["scored"] < 0.8 * work[2]["postings"]


def test_changes_give_the_figures_of_a_rebuild(spark, tmp_path, small_ranges):
    docs = corpus(2, 0, 150)
    index = SegmentIndex.create(spark, str(tmp_path / "index"), frame(spark, docs))

    def same(search=False):
        statistics = {r["term"]: (r["df"], round(r["idf"], 9)) for r in index.term_statistics().collect()}
        total = index.totals().first()
        words = {i: text.lower().split() for i, text in docs.items()}
        df = Counter(w for held in words.values() for w in set(held))
        assert statistics == {w: (n, round(math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)), 9)) for w, n in df.items()}
        assert total["n_docs"] == len(docs)
        assert total["avg_length"] == pytest.approx(sum(map(len, words.values())) / len(docs))
        if search:
            check(index, docs, spark)

    more = corpus(3, 150, 80)
    index.insert(frame(spark, more))
    docs |= more
    same()
    gone = [i for i in docs if i % 4 == 1]
    index.delete(spark.createDataFrame([(i,) for i in [*gone, 9_999]], "id long"))
    docs = {i: t for i, t in docs.items() if i not in gone}
    same()
    index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))  # again: nothing is left to remove
    changed = {i: t + " w7 w7" for i, t in corpus(4, 100, 60).items()}  # some ids live, some were deleted
    index.insert(frame(spark, changed))
    docs |= changed
    same(search=True)
    first, second, third = index.state().segments
    index.merge((first, second))
    assert len(index.state().segments) == 2
    same()
    index.merge()
    assert len(index.state().segments) == 1 and index.state().tombstones == ()
    same(search=True)
    assert SegmentIndex(spark, str(tmp_path / "index")).totals().first()["n_docs"] == len(docs)


def test_bounds_hold_when_the_mean_length_changes(spark, tmp_path, small_ranges):
    docs = corpus(5, 0, 200)
    index = SegmentIndex.create(spark, str(tmp_path / "index"), frame(spark, docs))
    for seed, size in ((6, 200), (7, 1)):  # texts much longer, then many of one word
        more = {1_000 * seed + i: " ".join(random.Random(seed * 100 + i).choices(WORDS, k=size)) for i in range(60)}
        index.insert(frame(spark, more))
        docs |= more
        check(index, docs, spark)


def test_a_segment_without_a_commit_is_not_read(spark, tmp_path):
    docs = corpus(8, 0, 30)
    index = SegmentIndex.create(spark, str(tmp_path / "index"), frame(spark, docs))
    index._write_segment(segments.count_documents(frame(spark, corpus(9, 100, 10))))
    assert index.totals().first()["n_docs"] == 30
    check(index, docs, spark)


def test_empty_indexes(spark, tmp_path):
    index = SegmentIndex.create(spark, str(tmp_path / "index"), spark.createDataFrame([], DOCS))
    asked = spark.createDataFrame([(1, "w1")], "qid long, text string")
    assert index.search(asked)[0].count() == 0
    docs = {1: "w1 w2", 2: None, 3: ""}
    index.insert(frame(spark, docs))
    found = index.search(asked, 5)[0].orderBy("rank").collect()
    assert [r["id"] for r in found] == [1, 2, 3] and found[1]["score"] == 0
    index.delete(spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    assert index.search(asked)[0].count() == 0 and index.totals().first()["n_docs"] == 0
    assert index.search(spark.createDataFrame([], "qid long, text string"))[0].count() == 0


def test_ids_may_be_strings(spark, tmp_path):
    docs = {f"p{i}": t for i, t in corpus(10, 0, 40).items()}
    index = SegmentIndex.create(spark, str(tmp_path / "index"), spark.createDataFrame(list(docs.items()), "id string, text string"))
    check(index, docs, spark)


def test_work_of_the_registered_query(spark):
    rows = registered.QUERIES["segment_work"](spark, "/root/testdata/sf0.01").collect()
    assert all(0 <= r["skipped"] < 1 and r["scored"] <= r["postings"] for r in rows)
    assert sum(r["skipped"] for r in rows) > 0


def test_postings_are_inverted_a_few_ranges_at_a_time(monkeypatch):
    """A batch of many documents is cut at the ends of its ranges; the blocks are those of the whole batch."""
    rng = random.Random(7)
    terms = [[{"term": w, "tf": rng.randint(1, 5)} for w in rng.sample(WORDS, rng.randint(0, 30))] for _ in range(500)]
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    columns = [pa.array(range(500)), pa.array([40] * 500, pa.int32()), pa.array(terms, kind), pa.array([i // 16 for i in range(500)])]
    batch = pa.RecordBatch.from_arrays(columns, ["id", "length", "terms", "range"])
    parts = list(segments._whole_ranges(batch, 1000))
    assert sum(p.num_rows for p in parts) == 500 and len(parts) > 5
    assert all(pc.sum(pc.list_value_length(p.column("terms"))).as_py() <= 1000 for p in parts)
    assert len([r for p in parts for r in set(p.column("range").to_pylist())]) == 32

    def blocks(docs):
        return sorted((r for d in docs for b in segments._blocks_of(d, 40.0, 1.2, 0.75) for r in b.to_pylist()), key=lambda r: (r["range"], r["term"]))

    assert blocks(parts) == blocks([batch])
    assert [p.num_rows for p in segments._whole_ranges(batch, 1)] == [16] * 31 + [4]
    # the index cuts its batches so
    real, seen = segments._whole_ranges, []
    monkeypatch.setattr(segments, "_whole_ranges", lambda b, most: seen.append(most) or real(b, most))

    class Docs:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: list(run(iter([batch])))

    SegmentIndex(None, "unused")._invert(Docs(), 40.0)
    assert seen == [segments.INVERTED_POSTINGS]


def test_few_terms_are_a_condition_on_the_files(spark, tmp_path):
    index = SegmentIndex.create(spark, str(tmp_path / "index"), frame(spark, corpus(11, 0, 50)))
    asked = spark.createDataFrame([("w1",), ("w2",)], "term string")
    plan = index._blocks(index.state(), asked)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [w1,w2])]" in plan


def test_documents_are_sorted_by_columns(spark, tmp_path, monkeypatch):
    """An expression as sort key is computed in every comparison."""
    docs = spark.createDataFrame([(i, "b a a" if i % 2 else "c d") for i in range(8)], "id long, text string")
    keys, plain = [], type(docs).sortWithinPartitions

    def sort(self, *columns, **more):
        keys.append(columns)
        return plain(self, *columns, **more)

    monkeypatch.setattr(type(docs), "sortWithinPartitions", sort)
    index = SegmentIndex.create(spark, str(tmp_path / "sorted"), docs)
    assert keys and all(isinstance(c, str) for each in keys for c in each)
    assert index.totals().first()["n_docs"] == 8
