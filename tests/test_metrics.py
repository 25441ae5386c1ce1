import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.operators import batch, bootstrap, evaluate, metrics


@pytest.mark.parametrize("ranges", [2, 7, 4096])
def test_percentiles_against_sorted_values(spark, ranges):
    draw = random.Random(2)
    values = {"a": [draw.gauss(0, 1) for _ in range(500)], "b": [draw.choice([1.0, 2.0, 2.5]) for _ in range(77)], "c": [1e308, -1e308, 0.0, 5e-324], "d": [3.0], None: [draw.paretovariate(0.3) for _ in range(120)]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in metrics.percentiles(df, "g", "v", shares, ranges).collect()} if ranges > 2 else {r.g: r for r in metrics.percentiles(df.where("g <> 'c'"), "g", "v", shares, ranges).collect()}
    for g in got:
        s = sorted(values[g])
        for name, p in shares.items():
            at = p * (len(s) - 1)
            low, high = s[math.floor(at)], s[math.ceil(at)]
            want = low if low == high else low + (high - low) * (at - math.floor(at))
            assert got[g][name] == pytest.approx(want, rel=1e-12), (g, name)
    assert got.keys() == values.keys() - ({"c", None} if ranges == 2 else set())


def test_summary_of_no_successful_call(spark):
    df = spark.createDataFrame([("x", 5.0, 3, 0.1, False), ("y", 1.0, 2, 0.2, True), ("y", 2.0, 2, 0.2, True)], "tag string, latency_ms double, tokens long, cost_usd double, success boolean")
    got = {r.tag: (r.calls, r.p50_ms) for r in metrics.summary(df, "tag").collect()}
    assert got == {"x": (1, None), "y": (2, 1.5)}
    assert metrics.summary(df).first()[:4] == (3, 2, 1.5, 1.5)


def test_pages_are_those_of_the_sorted_rows(spark):
    rows = [(i * 7919 % 1000, i) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, i long").repartition(5)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    for skip, most in ((0, 10), (333, 40), (690, 40), (700, 5), (650, None), (0, None), (699, 1)):
        got = [tuple(r) for r in batch.page(df, skip, most, F.desc("k"), F.asc("i"), near=5).collect()]
        assert got == want[skip : None if most is None else skip + most]
    plan = batch.page(df, 300, 20, F.desc("k"), F.asc("i"), near=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan


def test_draws_are_poisson_and_repeat():
    w = np.concatenate([bootstrap.draws(f"k{i}", 1000) for i in range(200)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03
    assert (bootstrap.draws("a", 10) == bootstrap.draws("a", 1000)[:10]).all() and (bootstrap.draws("a", 99, 1) != bootstrap.draws("a", 99)).any()


def test_intervals_do_not_depend_on_the_deal(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(f"e{i}", draw.choice(["x", "y"]), draw.randint(0, 3), draw.choice([0, 1, 3, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, level string, n long, d long")
    ratios = {"r": (F.col("n"), F.col("d")), "none": (F.col("n"), F.lit(0))}
    run = lambda d, b: sorted(tuple(r) for r in bootstrap.intervals(d, F.col("key"), F.array(F.lit("All"), "level"), ratios, b).collect())
    one = run(df.coalesce(1), 101)
    assert one == run(df.repartition(7), 101) and len(one) == 6
    for level, ratio, point, low, high in one:
        mine = [r for r in rows if level in ("All", r[1])]
        d = sum(r[3] or 0 for r in mine) if ratio == "r" else 0
        if not d:
            assert (point, low, high) == (None, None, None)
            continue
        w = np.array([bootstrap.draws(r[0], 101) for r in mine])
        s = np.sort((np.array([r[2] for r in mine]) @ w) / (np.array([r[3] or 0 for r in mine]) @ w))
        assert point == pytest.approx(sum(r[2] for r in mine) / d) and low == pytest.approx(s[2]) and high == pytest.approx(s[int(0.975 * 101) - 1])
    assert bootstrap.intervals(df.where("false"), F.col("key"), F.array(F.lit("All")), ratios, 10).collect() == []


def test_performance_counts_an_entity_once_above_its_domain(spark):
    rows = [("f", "a", "g", "d1", 1), ("f", "a", "g", "d2", 2), ("f", "b", "g", "d1", 3), ("h", "a", "k", "d1", 4)]
    df = spark.createDataFrame(rows, "file string, name string, grp string, domain string, seq long").withColumns({
        "gold_E": F.array(F.lit("1")), "gold_A": F.array(F.lit("1"), F.lit("2")), "run_scores": F.array(F.lit(2.0), F.lit(1.0), F.lit(None).cast("double")), "ext": F.when(F.col("seq") % 2 == 1, F.lit(1.0)), "pool": F.array(F.lit("2")),
    })
    got = {(r.level, r.method, r.metric): r for r in evaluate.performance(df, ["ext"], ["pool"], "pool", replicates=50).collect()}
    assert {k[0]: r.n for k, r in got.items()} == {"All": 3, "g": 2, "k": 1, "g-d1": 2, "g-d2": 1, "k-d1": 1}
    assert got["All", "pool", "rk_E"].point == 0 and got["All", "pool", "rk_A"].point == 1
    assert got["All", "pool", "r1_E"].point == 0.5 and got["All", "pool", "r1_A"].point == 1
    assert got["All", "ext", "r1_A"].point == 1 and got["All", "ext", "r1_E"].point == 0 and got["All", "ext", "r1_A"].coverage == pytest.approx(2 / 3)
    assert got["g-d2", "ext", "r1_A"].point is None and got["g-d2", "ext", "r1_A"].coverage == 0


def test_rows_of_a_key_are_added_up_before_they_are_drawn_for(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("key"), (F.col("id") % 2).alias("hit"))
    got = bootstrap.intervals(df, F.col("key"), F.array(F.lit("All")), {"r": (F.col("hit"), F.lit(1))}, 20)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [key" in plan[plan.index("MapInArrow") :]
    assert got.first().point == 0.5
