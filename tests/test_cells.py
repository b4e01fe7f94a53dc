"""Neighbours with metric pruning against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from compare import compare, connect
from test_search import by_query

from registry import oracles
from registry import queries as registered
from shelfwise.operators import cells

VECTORS = "id long, vector array<double>"


def clusters(seed, centres, members, dim, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    rows = np.repeat(middle, members, axis=0) + spread * rng.normal(size=(centres * members, dim))
    return rows


def frame(spark, rows, names="id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"{names} long, vector array<double>")


def check(spark, rows, asked=None, limit=5, **sizes):
    index = cells.build_cells(frame(spark, rows), **sizes)
    targets = rows if asked is None else asked
    found, work = cells.nearest(index, frame(spark, targets, "qid"), limit, exclude_self=asked is None, task_queries=100)
    found = by_query(found, "id", "score")
    scores = np.round(targets @ rows.T, 9)
    for q in range(len(targets)):
        others = [i for i in range(len(rows)) if asked is not None or i != q]
        expected = sorted(others, key=lambda i: (-scores[q, i], i))[:limit]
        assert [i for i, _ in found.get(q, [])] == expected
        assert [s for _, s in found.get(q, [])] == pytest.approx([scores[q, i] for i in expected], abs=1e-9)
    return {r["qid"]: r["pairs"] for r in work.collect()}


def test_clusters_are_pruned(spark):
    rows = clusters(1, 12, 50, 8, 0.05)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    pairs = check(spark, rows, shelf_rows=128)
    assert len(pairs) == 600 and sum(pairs.values()) < 0.4 * 600 * 600


def test_lengths_may_differ_and_rows_repeat(spark):
    rows = clusters(2, 6, 20, 5, 0.4) * np.random.default_rng(3).uniform(0.1, 4, (120, 1))
    rows[7] = 0
    rows[60:100] = rows[3]
    check(spark, rows, shelf_rows=32)


def test_uniform_directions_are_scored_whole(spark):
    rows = np.random.default_rng(4).normal(size=(300, 48))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    asked = np.random.default_rng(5).normal(size=(20, 48))
    pairs = check(spark, rows, asked, limit=12, shelf_rows=64)
    assert max(pairs.values()) <= 300


def test_fewer_rows_than_asked_for(spark):
    rows = clusters(6, 1, 3, 4, 1.0)
    check(spark, rows, limit=10)
    check(spark, rows[:1], limit=3)
    none = spark.createDataFrame([], VECTORS)
    assert cells.nearest(cells.build_cells(none), none.withColumnRenamed("id", "qid"))[0].count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [1.0, 0.0])], VECTORS)
    found = cells.nearest(cells.build_cells(nulls), nulls.withColumnRenamed("id", "qid"), exclude_self=False)[0].collect()
    assert [(r["qid"], r["id"]) for r in found] == [(2, 2)]


def test_vectors_that_cannot_be_compared_are_refused(spark):
    rows = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0])], VECTORS)
    with pytest.raises(Exception, match="cannot be compared"):
        cells.build_cells(rows)


def test_bounds_hold():
    rng = np.random.default_rng(7)
    rows, pivots = rng.normal(size=(200, 6)), cells._units(rng.normal(size=(9, 6)))
    cell = (rows @ pivots.T).argmax(axis=1)
    along, across = cells.split(rows, pivots, cell)
    q_along, q_across = cells._query_parts(rows, pivots)
    bounds = cells._bounds(q_along[:, cell], q_across[:, cell], along, along, across)
    assert (rows @ rows.T <= bounds).all()


def test_equal_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(registered.QUERIES["knn_cells"](spark, sf), connect(sf), oracles.ORACLES["knn_cells"]) is None
    work = registered.QUERIES["neighbour_work"](spark, sf).collect()
    assert all(0 < r["pairs"] <= r["all_pairs"] for r in work)


def test_blocks_below_the_threshold_are_not_ranked(monkeypatch):
    rows = np.random.default_rng(3).normal(size=(256, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    pivots = rows[:1]
    along, across = cells.split(rows[16:], pivots, np.zeros(240, int))
    held = pa.table({
        "id": np.arange(240), "vector": rows[16:].tolist(), "cell": np.zeros(240, np.int32), "along": along, "across": across,
        "position": np.arange(240),
    })
    best = np.sort(np.round(rows[:16] @ rows[16:].T, cells.RANK_DIGITS), axis=1)[:, -3:]
    wanted = pa.table({"qid": np.arange(1000, 1016), "vector": rows[:16].tolist(), "threshold": best[:, -1], "shelf": np.zeros(16, np.int64)})
    shape = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("shelf", pa.int64()), ("pairs", pa.int64())])
    ranked, plain = [], np.partition

    def partition(a, *rest, **more):
        ranked.append(len(a))
        return plain(a, *rest, **more)

    monkeypatch.setattr(cells.np, "partition", partition)
    found = cells._score_shelf(held, wanted, pivots, 3, False, shape.empty_table())
    assert sorted(found["score"].to_pylist()) == sorted(best[:, -1])
    assert sum(ranked) == 16  # each query once, in the block of its best row
