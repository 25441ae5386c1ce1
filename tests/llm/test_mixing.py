import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from termweave.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights, most=3):
    """Targets, as (number, divisor), by resharing until no source is above its most."""
    out, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] and left * weights[s] >= most * sizes[s] * total}
        if not full:
            return out | {s: (left * weights[s], total or 1) for s in open_}
        out |= {s: (most * sizes[s], 1) for s in full}
        left -= sum(out[s][0] for s in full)
        open_ -= full
    return out


def brute(rows, cycle=(5, 2, 1), most=3, seed=11):
    """(id, size, source_size, target, copies) of (id, text, source), by one running sum a source."""
    sized = [(i, len(WORD.findall(t or "")), s) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, n, s in sized:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    aims = shares(sizes, {s: cycle[k % len(cycle)] for k, s in enumerate(names)}, most)
    out = []
    for s in names:
        mine = sorted((x for x in sized if x[2] == s), key=lambda x: (-x[1], x[0] is not None, hashlib.md5(f"{seed}:{x[0]}".encode()).hexdigest()))
        octaves = defaultdict(int)
        for x in mine:
            octaves[x[1].bit_length()] += x[1]
        tier = lambda n: sum(8 * sum(w for b, w in octaves.items() if b >= n.bit_length()) > sizes[s] * c for c in mixing.CUTS)
        up, down = aims[s]
        total = Fraction(int(hashlib.md5(f"{seed}/{s or ''}".encode()).hexdigest()[:8], 16), 1 << 32)
        taken = gone = 0
        for t in range(len(mixing.CUTS) + 1):
            left, over = sizes[s] - gone, up - down * taken
            some = left > 0 and 0 < over < most * down * left
            rate = Fraction(over, down * left) if some else Fraction(most if left > 0 and over > 0 else 0)
            grid = down * left if some else 1
            total = floor(total) + Fraction(floor(total % 1 * grid), grid)  # the offset is a whole number of these steps
            for i, n, _ in (x for x in mine if tier(x[1]) == t):
                copies = floor(total + rate) - floor(total)
                total += rate
                out.append((i, n, sizes[s], up / down, copies))
                taken, gone = taken + n * copies, gone + n
    return out


def found(df, **options):
    return sorted((tuple(r) for r in mixing.copies(df, keep=("doc_id",), **options).select("doc_id", "size", "source_size", "target", "copies").collect()), key=repr)


def documents(n, seed=4, tail=0.9):
    draw = random.Random(seed)
    return [(i, " ".join(["w"] * int(draw.paretovariate(tail) * 4)), f"s{draw.choice([0, 0, 0, 0, 1, 2, 3, 4])}") for i in range(n)]


def test_against_brute_force(spark):
    rows = documents(400) + [(1000, None, "s1"), (1001, "", "empty"), (1002, "a\tb c d", None), (1003, "x y", ""), (1004, "y", "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, want = found(df), sorted(brute(rows), key=repr)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-6 * (1 + b[3]) for a, b in zip(got, want))
    assert max(r[4] for r in got) <= 3 and found(df) == got


def test_taken_words_are_near_the_target(spark):
    rows = documents(3000, 9, tail=2.5)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(df, keep=("doc_id", "source")).groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("got")).collect()
    assert all(abs(r.got / r.t - 1) < 0.02 for r in got), got


def test_targets_share_what_full_sources_leave(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 0, None: 90}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    weights = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    got = {r.source: r.target for r in mixing.targets(df, (5, 2, 1)).collect()}
    want = shares(sizes, weights)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s][0] / want[s][1]) < 1e-6 for s in got)
    assert got["a"] == 30 and got["d"] == 0 and abs(sum(got.values()) - 1600) < 1e-6
    named = {r.source: r.target for r in mixing.targets(df, {"b": 1, None: 1}).collect()}
    assert named == {"a": 0.0, "c": 0.0, "d": 0.0, None: 270.0, "b": 1330.0}


def test_all_words_can_be_taken_three_times(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "c", "x"), (3, "d " * 500, "y")], "doc_id long, text string, source string")
    got = mixing.copies(df, weights={"x": 1000, "y": 1}, keep=("doc_id",)).collect()
    assert {(r.doc_id, r.copies) for r in got if r.doc_id < 3} == {(1, 3), (2, 3)}


def test_odd_rows_and_whole_rows(spark, odd_docs, no_docs):
    df = odd_docs.withColumn("source", F.when(F.col("doc_id") < 4, "x")).withColumn("size", F.lit("mine")).withColumn("copies", F.lit(0))
    counts = mixing.copies(df)
    assert counts.count() == df.count() and "score" in counts.columns
    got = mixing.mix(df)
    assert got.columns == [c for c in df.columns if c not in ("size", "copies")] + ["copy"]
    assert got.count() == counts.agg(F.sum("copies")).first()[0]
    assert mixing.copies(no_docs.withColumn("source", F.lit("x"))).collect() == []
    assert mixing.copies(df.withColumn("source", F.lit(None).cast("string"))).agg(F.max("copies")).first()[0] == 1


def test_a_hot_source_and_a_repeated_row_spread(spark):
    df = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit("same words here").alias("text"), F.lit("hot").alias("source"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = mixing.copies(df, keep=("doc_id",))
        assert [r[0] for r in rows.groupBy("copies").count().collect()] == [1]
        assert max(r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()) < 6000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("text", ["", " \t\n\x0b\x0c\r ", "a", " a b ", "a b", "\x1c\x1d x", "word " * 70_000])
def test_size(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(mixing.size_of(F.col("t")))
    assert df.first()[0] == len(WORD.findall(text))
