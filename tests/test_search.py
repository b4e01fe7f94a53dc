import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import blocks, bm25, embed, vectors
from shelfwise.plans import search

WORDS = "red blue steel lamp chair table desk soft warm hard light".split()
SMALL_CELLS = {"max_queries": 3, "max_cell_rows": 8}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    docs = {i: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 14))) for i in range(60)}
    docs[60] = docs[3]
    matrix = np.random.default_rng(5).normal(size=(61, 6))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix[60] = matrix[3]
    queries = {q: " ".join(rng.choice(WORDS) for _ in range(4)) for q in range(9)}
    queries[9] = "nothing matches"
    asked = np.random.default_rng(6).normal(size=(10, 6))
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    return docs, matrix, queries, asked


@pytest.fixture(scope="module")
def frames(spark, corpus):
    docs, matrix, queries, asked = corpus
    return (
        spark.createDataFrame(list(docs.items()), "id long, text string"),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "id long, vector array<double>"),
        spark.createDataFrame([(q, t, asked[q].tolist()) for q, t in queries.items()],
                              "qid long, text string, vector array<double>"),
    )


def scores(docs, query, k1=1.5, b=0.75):
    tokens = {i: re.findall("[a-z0-9]+", d.lower()) for i, d in docs.items()}
    counts = {i: Counter(t) for i, t in tokens.items()}
    average = sum(map(len, tokens.values())) / len(tokens)
    out = dict.fromkeys(docs, 0.0)
    for term in set(re.findall("[a-z0-9]+", query.lower())):
        df = sum(term in c for c in counts.values())
        weight = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        for i, c in counts.items():
            if c[term]:
                out[i] += weight * c[term] * (k1 + 1) / (c[term] + k1 * (1 - b + b * len(tokens[i]) / average))
    return out


def best(score, k):
    return sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]


def by_query(frame, *columns):
    out = {}
    for row in frame.orderBy("qid", "rank").collect():
        out.setdefault(row["qid"], []).append(tuple(row[c] for c in columns))
    return out


def test_single_query(frames, corpus):
    docs = corpus[0]
    for query in ["red lamp lamp", "soft", "absent words"]:
        expected = scores(docs, query)
        got = bm25.search_text(frames[0], query, limit=15).collect()
        assert [r["id"] for r in got] == best(expected, 15)
        assert [r["score"] for r in got] == pytest.approx([expected[r["id"]] for r in got], abs=1e-8)


def test_query_without_terms_keeps_id_order(frames):
    assert [r["id"] for r in bm25.search_text(frames[0], "?!", limit=3).collect()] == [0, 1, 2]


def test_batch_equals_single_queries(frames, corpus):
    index = search.build_index(frames[0])
    got = by_query(search.bm25_batch(index, frames[2], limit=7), "id", "score")
    for qid, query in corpus[2].items():
        expected = scores(corpus[0], query)
        assert [i for i, _ in got[qid]] == best(expected, 7)
        assert [s for _, s in got[qid]] == pytest.approx([expected[i] for i, _ in got[qid]], abs=1e-8)


def test_batch_gives_the_same_in_cells(frames):
    index = search.build_index(frames[0])
    whole = search.bm25_batch(index, frames[2], limit=7)
    cells = search.bm25_batch(index, frames[2], limit=7, **SMALL_CELLS)
    assert by_query(whole, "id", "score") == by_query(cells, "id", "score")


def fused(corpus, qid, alpha):
    docs, matrix, queries, asked = corpus
    keyword = np.array(list(scores(docs, queries[qid]).values()))
    cosine = matrix @ asked[qid]

    def scaled(v):
        return np.zeros_like(v) if v.max() - v.min() < 1e-9 else (v - v.min()) / (v.max() - v.min())

    return dict(enumerate(alpha * scaled(keyword) + (1 - alpha) * scaled(cosine)))


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("sizes", [{}, SMALL_CELLS])
def test_hybrid_equals_brute_force(frames, corpus, alpha, sizes):
    index = search.build_index(frames[0], frames[1])
    got = by_query(search.hybrid_search(index, frames[2], 10, alpha, **sizes), "id", "fused", "rank")
    assert set(got) == set(corpus[2])
    for qid in got:
        expected = fused(corpus, qid, alpha)
        assert [i for i, _, _ in got[qid]] == best(expected, 10)
        assert [f for _, f, _ in got[qid]] == pytest.approx([expected[i] for i, _, _ in got[qid]], abs=1e-8)
        assert [r for _, _, r in got[qid]] == list(range(1, 11))


def test_hybrid_scores_stay_in_range_and_shares_add_up(frames):
    index = search.build_index(frames[0], frames[1])
    for row in search.hybrid_search(index, frames[2], 10).collect():
        assert 0 <= row["fused"] <= 1 and 0 <= row["keyword_share"] <= 1
        assert row["fused"] == pytest.approx((row["bm25_normalized"] + row["semantic_normalized"]) / 2, abs=1e-8)
    nothing = search.hybrid_search(index, frames[2].where("qid = 9"), 5).collect()
    assert [r["bm25_normalized"] for r in nothing] == [0.0] * 5


def test_hybrid_only_knows_documents_with_a_vector(frames):
    index = search.build_index(frames[0], frames[1].where("id < 20"))
    found = search.hybrid_search(index, frames[2], 50).collect()
    assert {r["id"] for r in found} == set(range(20))


def test_blank_queries_are_left_out_and_arguments_checked(spark, frames):
    index = search.build_index(frames[0], frames[1])
    blank = frames[2].limit(1).withColumn("text", F.lit(" \t"))
    assert search.hybrid_search(index, blank).count() == 0
    for limit, alpha in [(0, 0.5), (51, 0.5), (5, -0.1), (5, 1.1)]:
        with pytest.raises(ValueError):
            search.hybrid_search(index, blank, limit, alpha)


def test_string_ids(spark, frames):
    docs = frames[0].withColumn("id", F.format_string("P%05d", "id"))
    known = frames[1].withColumn("id", F.format_string("P%05d", "id"))
    named = search.hybrid_search(search.build_index(docs, known), frames[2], 5)
    plain = search.hybrid_search(search.build_index(frames[0], frames[1]), frames[2], 5)
    assert by_query(named.withColumn("id", F.expr("cast(substr(id, 2) as long)")), "id") == by_query(plain, "id")


@pytest.mark.parametrize("sizes", [{}, SMALL_CELLS])
def test_neighbours_equal_brute_force(frames, corpus, sizes):
    got = by_query(vectors.similar_items(frames[1], limit=4, **sizes), "id")
    matrix = corpus[1]
    for i in range(len(matrix)):
        score = dict(enumerate(matrix @ matrix[i]))
        del score[i]
        assert [x for (x,) in got[i]] == best(score, 4)


def test_vectors_of_different_length_are_refused(spark):
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0])], "id long, vector array<double>")
    with pytest.raises(Exception, match="dimensions cannot be compared"):
        vectors.similar_items(mixed.coalesce(1)).collect()


def test_neighbours_of_unknown_id_are_empty(spark, frames):
    ids = spark.createDataFrame([(999,)], "id long")
    assert vectors.similar_items(frames[1], ids).count() == 0


def test_more_neighbours_than_items(frames):
    assert vectors.similar_items(frames[1], frames[1].select("id").limit(1), limit=500).count() == 60


def test_index_statistics(frames, corpus):
    indexed = bm25.index_documents(frames[0])
    totals = bm25.corpus_totals(indexed).first()
    lengths = [len(d.split()) for d in corpus[0].values()]
    assert totals["n_docs"] == 61 and totals["avg_length"] == pytest.approx(sum(lengths) / 61)
    got = {r["term"]: (r["df"], r["idf"]) for r in bm25.term_statistics(indexed).collect()}
    for term in WORDS:
        df = sum(term in d.split() for d in corpus[0].values())
        assert got[term] == (df, pytest.approx(math.log(1 + (61 - df + 0.5) / (df + 0.5))))
    assert bm25.postings(indexed).agg(F.sum("tf")).first()[0] == sum(lengths)
    limited = bm25.index_documents(frames[0], ["red"])
    assert limited.agg(F.sum("length")).first()[0] == sum(lengths)


def test_min_max_normalize(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 7.0), ("b", 7.0)], "g string, v double")
    out = vectors.min_max_normalize(rows, ["g"], "v", "n").orderBy("g", "v").collect()
    assert [r["n"] for r in out] == [0.0, 0.5, 1.0, 0.0, 0.0]


def test_embedding_is_unit_length_and_takes_any_encoder(spark):
    texts = spark.createDataFrame([("a", "red lamp"), ("b", "red lamp"), ("c", "")], "id string, text string")
    got = {r["id"]: r["vector"] for r in embed.embed_texts(texts).collect()}
    assert got["a"] == got["b"] and len(got["a"]) == 64
    assert sum(x * x for x in got["a"]) == pytest.approx(1, abs=1e-5)
    assert set(got["c"]) == {0.0}

    def lengths():
        return lambda batch: np.array([[3.0, 4.0] for _ in batch])

    assert embed.embed_texts(texts, lengths).first()["vector"] == [0.6, 0.8]


def test_align_matches_by_id(spark):
    products = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, title string")
    known = spark.createDataFrame([("b", [1.0]), ("z", [0.0])], "id string, vector array<double>")
    assert [tuple(r) for r in vectors.align(products, known).collect()] == [("b", "y", [1.0])]


def test_best_rows_admit_ties_by_id_only():
    ids, score = np.arange(400), np.zeros((2, 400))
    score[1] = np.repeat([1.0, 0.0, 2.0, 1.0], 100)
    for order in (np.arange(400), np.arange(400)[::-1], np.random.default_rng(0).permutation(400)):
        best = blocks.TopRows(2, 5)
        for at in range(0, 400, 40):
            block = order[at : at + 40]
            best.add(ids[block], score[:, block])
        query, found, _ = best.columns()
        assert found[query == 0].tolist() == [0, 1, 2, 3, 4]
        assert found[query == 1].tolist() == [200, 201, 202, 203, 204]
    best = blocks.TopRows(1, 2)
    for block in (ids[300:340], ids[340:380], ids[:40]):
        best.add(block, np.zeros((1, len(block))))
    assert best.columns()[1].tolist() == [0, 1]


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
@pytest.mark.parametrize("sizes", [{}, SMALL_CELLS])
def test_vectors_of_unfinite_components_are_refused(spark, bad, sizes):
    rows = [(i, [float(i), 1.0]) for i in range(6)] + [(6, [bad, 1.0])]
    known = spark.createDataFrame(rows, "id long, vector array<double>")
    with pytest.raises(Exception, match="cannot be compared"):
        vectors.nearest(known, known.withColumnRenamed("id", "qid"), 3, **sizes).collect()


def test_cells_are_bounded_in_bytes(spark):
    """Long texts make more cells, with the same result."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(200))) for i in range(30)], "id long, text string")
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1} " * 30) for i in range(9)], "qid long, text string")
    index = search.build_index(docs)
    shipped = search.bm25_batch(index, queries, limit=4).collect()
    cells = search.bm25_batch(index, queries, limit=4, max_queries=2, max_cell_queries=4, max_cell_bytes=2_000).collect()
    assert sorted(shipped) == sorted(cells) and len(cells) == 36
    assert blocks.measure(index)[1] > 30 * 90 * blocks.ENTRY_BYTES / 2


def test_counted_in_batches_as_in_the_row(spark):
    texts = [(1, "Red lamp, red LAMP red"), (2, None), (3, ""), (4, "?! "), (5, "\u212aelvin \u0130x \u00c9t\u00e9 7"), (6, "a " * 5_000 + "b")]
    docs = spark.createDataFrame(texts, "id long, text string")
    rows = [
        sorted((r["id"], r["length"], tuple(sorted((t["term"], t["tf"]) for t in r["terms"]))) for r in frame.collect())
        for frame in (bm25.index_documents(docs), bm25.count_documents(docs))
    ]
    assert rows[0] == rows[1]


def test_neighbours_in_cells_of_a_joined_table(spark, frames):
    """Rows and queries of one join share their columns; past the shipped queries both go to one cogroup."""
    _, known, _ = frames
    aligned = vectors.align(known.select("id"), known)
    cells = vectors.similar_items(aligned, limit=4, **SMALL_CELLS).collect()
    assert sorted(cells) == sorted(vectors.similar_items(known, limit=4).collect())
    assert len(cells) == 4 * known.count()


def test_text_slices_are_bounded():
    sizes = [3, 3, 9, 1, 1, 1, 1, 0]
    parts = list(blocks.text_slices(sizes, 6, most_rows=3))
    assert parts == [slice(0, 2), slice(2, 3), slice(3, 6), slice(6, 8)]
    assert list(blocks.text_slices([], 6)) == []


def test_encoder_gets_a_bounded_number_of_characters(spark):
    """Long texts of one Arrow batch reach the encoder a few at a time."""

    def make_encoder():
        def encode(texts):
            if sum(map(len, texts)) > 500_000:
                raise ValueError("too many characters at a time")
            return np.array([[float(len(t)), 1.0] for t in texts])

        return encode

    texts = spark.range(4, numPartitions=1).select("id", F.repeat(F.lit("ab "), 100_000).alias("text"))
    found = embed.embed_texts(texts, make_encoder).collect()
    assert [r["id"] for r in found] == [0, 1, 2, 3]
    assert {tuple(r["vector"]) for r in found} == {(1.0, round(1 / 300_000, 6))}
