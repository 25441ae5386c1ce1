import math

import pytest

import __spark_entry__ as entry
from oracle import connect, same
from termweave.plans import catalogue


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, data, con, name):
    same(catalogue.QUERIES[name](spark, data), con, catalogue.SQL[name])


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "doc_id", "rank", "score", "norm"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_projection_keeps_angles(spark, data):
    rows = catalogue.QUERIES["projection_128"](spark, data).collect()
    assert all(abs(math.hypot(*r.projected) - 1) < 1e-5 and len(r.projected) == 16 for r in rows)


def test_bootstrap_holds_the_mean(spark):
    d = "/root/testdata/sf0.01"
    low, high = catalogue.QUERIES["bootstrap_ci"](spark, d).first()
    mean = spark.read.parquet(f"{d}/labels.parquet").selectExpr("avg(quality)").first()[0]
    assert 0 < low < mean < high < 1 and high - low < 0.2


def test_bootstrap_runs_the_replicates_of_the_reference(spark, data, monkeypatch):
    asked, run = [], catalogue.QUERIES["bootstrap_ci"].__globals__["evaluate"].bootstrap

    def seen(*args, replicates=1000, **options):
        asked.append(replicates)
        return run(*args, replicates=replicates, **options)

    monkeypatch.setattr(catalogue.QUERIES["bootstrap_ci"].__globals__["evaluate"], "bootstrap", seen)
    low, high = catalogue.QUERIES["bootstrap_ci"](spark, data).first()
    rows = spark.read.parquet(f"{data}/labels.parquet").selectExpr("doc_id", "quality as hits", "1 as cells")
    assert asked == [1000] and (low, high) == tuple(run(rows, "doc_id", "hits", "cells", replicates=1000).first())
