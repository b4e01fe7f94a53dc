import random

import pytest

from shelfwise import fixed_values as fixed
from shelfwise.operators.ranking import rerank

SCHEMA = "qid long, id long, base_score double, category string, title string, rating double, rating_count int"


def greedy(pool, limit, weight):
    """Pick the best row, count its key, lower what is left, and so on."""
    seen, left, out = {}, dict(pool), []
    while left and len(out) < limit:
        pick = min(left, key=lambda i: (-(left[i][0] - weight * seen.get(left[i][1], 0)), i))
        _, key = left.pop(pick)
        seen[key] = seen.get(key, 0) + 1
        out.append(pick)
    return out


def test_window_form_equals_greedy_picks(spark):
    rng = random.Random(11)
    weights = {"rating": 0.0, "popularity": 0.0, "diversity": 0.15}
    rows, pools = [], {}
    for qid in range(150):
        pool = {i: (rng.random(), rng.choice("abc")) for i in range(rng.randint(1, 25))}
        pools[qid] = pool
        rows += [(qid, i, s, "c", f"{k} thing", 3.0, 10) for i, (s, k) in pool.items()]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for row in rerank(frame, 7, weights).orderBy("qid", "rank").collect():
        got.setdefault(row["qid"], []).append(row["id"])
    assert got == {qid: greedy(pool, 7, 0.15) for qid, pool in pools.items()}


def test_boosts_and_scores(spark):
    rows = [(1, 1, 0.5, "c", "A x", 5.0, 4200), (1, 2, 0.5, "c", "A y", 1.0, 0), (1, 3, 0.1, "c", "B", 3.0, 9999)]
    first, second, third = rerank(spark.createDataFrame(rows, SCHEMA), 10).orderBy("rank").collect()
    assert (first["id"], first["rating_boost"], first["popularity_boost"]) == (1, 0.05, 0.05)
    assert (second["id"], second["diversity_penalty"]) == (2, 0.15)
    assert second["final_score"] == 0.5 and second["adjusted_score"] == pytest.approx(0.35)
    assert third["popularity_boost"] == 0.05 and third["diversity_penalty"] == 0


def test_ties_go_to_the_lower_id(spark):
    rows = [(1, i, 0.5, "c", f"t{i}", 3.0, 10) for i in [4, 2, 9]]
    assert [r["id"] for r in rerank(spark.createDataFrame(rows, SCHEMA), 2).orderBy("rank").collect()] == [2, 4]


def test_weight_zero_keeps_score_order(spark):
    rows = [(1, i, 1.0 - i / 10, "c", "same title", 3.0, 10) for i in range(5)]
    flat = {"rating": 0.0, "popularity": 0.0, "diversity": 0.0}
    assert [r["id"] for r in rerank(spark.createDataFrame(rows, SCHEMA), 9, flat).orderBy("rank").collect()] == list(range(5))


def test_negative_weights_are_refused(spark):
    with pytest.raises(ValueError):
        rerank(spark.createDataFrame([], SCHEMA), 3, {"rating": 0.0, "popularity": 0.0, "diversity": -0.1})


def test_both_windows_limit_before_the_shuffle(spark):
    rows = [(1, i, 0.5, "c", "same title", 3.0, 10) for i in range(50)]
    plan = rerank(spark.createDataFrame(rows, SCHEMA), 5, fixed.RECOMMENDATION_WEIGHTS)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 2
    assert plan.count() == 5
