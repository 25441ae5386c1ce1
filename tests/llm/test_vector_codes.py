import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import store, vector_codes


def brute(rows, parts, entries, rounds, scale=256):
    """{id: (code, error)} and codebooks, by whole rounds in plain integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    w = width // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[near(v, p)[1] for p in range(parts)] for _, v in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for (_, v), c in zip(kept, codes) if c[p] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, [near(v, p) for p in range(parts)]) for i, v in kept]
    return sorted(((i, bytes(k for _, k in f), sum(d for d, _ in f)) for i, f in found), key=repr), books


def found(spark, rows, parts=4, entries=8, rounds=2, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, code string, row int")
    coded, books = vector_codes.encode(df, parts, entries, rounds, **options)
    return sorted(((r.vec_id, bytes(r.code), r.error) for r in coded.collect()), key=repr), books


@pytest.mark.parametrize("rounds", [0, 1, 2, 5])
def test_against_brute_force(spark, rounds):
    draw = random.Random(3)
    centres = [[draw.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i, [c + draw.gauss(0, 0.2) for c in centres[i % 6]]) for i in range(300)] + [(i, [0.25, -0.25] * 6) for i in range(300, 360)]
    got, books = found(spark, rows, rounds=rounds)
    want, entries = brute(rows, 4, 8, rounds)
    assert got == want and books.entries.tolist() == entries


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0, 3.0, 4.0]), (3, [1.0, 2.0, 3.0, 4.0]), (3, [0.0, 2.0, 3.0, 4.0]), (1, None), (2, [1.0, None, 1.0, 1.0]), (4, [nan, 1.0, 1.0, 1.0]), (5, [inf, 1.0, 1.0, 1.0]), (None, [9.0, -2.0, 3.0, 4.0]), (7, [1.0]), (8, []), (9, [-1.0, -0.1, 0.0, 0.001])]
    got, books = found(spark, rows, parts=2, entries=64)
    want, entries = brute([r for r in rows if r[1] is None or len(r[1]) == 4], 2, 64, 2)
    assert got == want and books.entries.tolist() == entries
    assert found(spark, [])[0] == []
    assert found(spark, [(1, [1.0, 2.0, 3.0])], parts=2)[0] == []  # can't be cut evenly


def test_large_components_stay_exact(spark):
    draw = random.Random(8)
    rows = [(i, [draw.uniform(-1, 1) * 2.0 ** draw.choice([0, 12, 20]) for _ in range(4)]) for i in range(30)]
    got, books = found(spark, rows, parts=2, entries=5)
    want, entries = brute(rows, 2, 5, 2)
    assert got == want and books.entries.tolist() == entries
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [2.0**60, 1.0])], parts=2)


def test_a_round_moves_what_changed_alone(spark):
    draw = np.random.RandomState(2)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(400, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(F.struct("vec_id").alias("row"), vector_codes.whole(F.col("embedding")).alias("vector"), F.lit(None).cast("binary").alias("code"))
    books = vector_codes.Codebooks(np.array([v for _, v in sorted((r.row.vec_id, r.vector) for r in df.collect())][:16]).reshape(16, 2, 4).transpose(1, 0, 2))
    one = store.materialize(vector_codes._assigned(df, books), "t")
    assert {(r.part, r.entry): int(r.delta) for r in vector_codes._moves(one, 2, 16, 4).where("at = 4").collect()} == {(p, k): n for p in range(2) for k, n in enumerate(np.bincount([bytes(r.code)[p] for r in one.collect()], minlength=16).tolist()) if n}
    again = store.materialize(vector_codes._assigned(one, books), "t")
    assert vector_codes._moves(again, 2, 16, 4).count() == 0  # nothing changed, nothing is shuffled
    shifted = vector_codes.Codebooks(books.entries[:, ::-1].copy())
    moved = store.materialize(vector_codes._assigned(one, shifted), "t")
    total = vector_codes._moves(moved, 2, 16, 4).groupBy("at").agg(F.sum("delta")).collect()
    assert all(r[1] == 0 for r in total)  # what leaves one entry comes to another


def test_label_errors(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "a", 3), (3, None, 4), (4, None, 5), (5, "b", 6)], "vec_id long, label string, error long")
    assert {(r.vec_id, r.label_error) for r in vector_codes.label_errors(df).collect()} == {(1, 5), (2, 5), (3, 9), (4, 9), (5, 6)}
