import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import topk_search


def brute(rows, k, every):
    q = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q[i] = [math.floor(64 * x) for x in v]
    out = []
    for a in sorted(q):
        if a % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a and len(q[a]) == len(q[b]))
            out += [(a, n + 1, b, -s) for n, (s, b) in enumerate(scores[:k])]
    return out


def found(spark, rows, k=5, every=4):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score int, id string")
    return sorted(tuple(r) for r in topk_search.search(df, F.col("vec_id") % every == 0, k).collect())


def test_against_brute_force_with_ties(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, draw.gauss(0, 0.4)]) for _ in range(12)]) for i in range(150)]
    assert found(spark, rows) == brute(rows, 5, 4)
    monkeypatch.setattr(topk_search, "SHARD_BYTES", 40 * 12 * 8)
    monkeypatch.setattr(topk_search, "SCORE_BYTES", 40 * 8 * 3)
    monkeypatch.setattr(topk_search, "BLOCK", 9)
    assert found(spark, rows, 7, 3) == brute(rows, 7, 3)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (4, None), (8, [1.0, None]), (12, [float("nan"), 1.0]), (16, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0]), (1, [3.0]), (2, [0.1, -0.1]), (24, [])]
    assert found(spark, rows) == brute(rows, 5, 4)
    assert found(spark, []) == []


def test_search_stops_on_proof():
    draw = np.random.RandomState(3)
    rows = np.floor(64 * draw.normal(size=(4000, 64)) / 8).astype(np.int64)
    rows[:40] = rows[0] + draw.randint(-1, 2, (40, 64))
    index = topk_search.ImpactIndex(np.arange(4000), rows)
    (at, scores), *_ = index.search(rows[:1], np.array([0]), 20)
    want = np.lexsort((np.arange(4000), -(rows @ rows[0])))
    assert at.tolist() == [i for i in want if i != 0][:20] and (np.diff(scores) <= 0).all()
    assert index.taken[0] < 0.95 * index.taken[1]
    skewed = np.floor(64 * draw.pareto(1.5, (4000, 64)) * draw.choice([-1, 1], (4000, 64)) / 8).astype(np.int64)
    index = topk_search.ImpactIndex(np.arange(4000), skewed)
    for q, (at, scores) in zip(range(50), index.search(skewed[:50], np.arange(50), 20)):
        want = np.lexsort((np.arange(4000), -(skewed @ skewed[q])))
        assert at.tolist() == [i for i in want if i != q][:20]
    assert index.taken[0] < 0.8 * index.taken[1]


def test_segments_are_added_by_few_products(monkeypatch):
    draw, taken = np.random.RandomState(4), []
    rows = draw.randint(-40, 41, (500, 32)).astype(np.int64)
    one = topk_search.ImpactIndex._taken
    monkeypatch.setattr(topk_search.ImpactIndex, "_taken", lambda self, segments: taken.append(len(segments)) or one(self, segments))
    index = topk_search.ImpactIndex(np.arange(500), rows)
    for q, (at, scores) in zip(range(30), index.search(rows[:30], np.arange(30), 5)):
        want = [i for i in np.lexsort((np.arange(500), -(rows @ rows[q]))) if i != q][:5]
        assert at.tolist() == want and scores.tolist() == (rows @ rows[q])[want].tolist()
    assert len(taken) <= 6 and sum(taken) > 100


def test_repeated_ids_and_large_components(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, -2.0]), (4, [2.0, 1.0]), (5, [1e8, -1e8]), (7, [0.0, 0.0])]
    assert found(spark, rows) == brute([rows[1], *rows[2:]], 5, 4)
    rows = [(0, [2.0**44, 1.0]), (1, [3.0, 1.0]), (2, [0.5, 2.0**46]), (3, [2.0**-6, 1.5])]
    assert found(spark, rows) == brute(rows, 5, 4)


def test_bounds_hold_for_large_components_and_small_queries(spark):
    draw = np.random.RandomState(12)
    for top in (4, 2**10, 2**20, 2**27, 2**29, 2**30):
        rows = draw.randint(-top, top + 1, (200, 4)).astype(np.int64)
        rows[::2, 1:] = draw.randint(-3, 4, (100, 3))
        queries = draw.randint(-3, 4, (60, 4)).astype(np.int64)
        queries[:20, 0] = 0
        index = topk_search.ImpactIndex(np.arange(200), rows)
        for q, (at, scores) in zip(queries, index.search(queries, np.full(60, -1), 5)):
            want = np.lexsort((np.arange(200), -(rows @ q)))[:5]
            assert at.tolist() == want.tolist() and scores.tolist() == (rows @ q)[want].tolist()
    wide = [(i, [float(x) for x in v]) for i, v in enumerate(draw.randint(-(2**24), 2**24, (60, 4)).tolist())] + [(100 + 4 * i, [float(draw.choice([0, 0.02, -0.02])) for _ in range(4)]) for i in range(12)]
    assert found(spark, wide) == brute(wide, 5, 4)


def test_a_component_that_no_long_holds_raises(spark):
    with pytest.raises(Exception, match="too large"):
        found(spark, [(0, [1e300]), (1, [1.0])])
