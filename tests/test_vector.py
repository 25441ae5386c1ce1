import numpy as np
import pytest

from termweave.operators import vector


def brute(queries, corpus, k, by_domain=True, least=-2.0):
    out = []
    for q, a, qd in queries:
        found = []
        for i, b, d in corpus:
            if a is None or b is None or i == q or len(a) != len(b) or (by_domain and (d is None or d != qd)) or not any(a) or not any(b):
                continue
            x, y = np.array(a), np.array(b)
            c = float(x @ y / np.sqrt((x @ x) * (y @ y)))
            if c >= least:
                found.append((-round(c, 9), i))
        out += [(q, i, n + 1, -c) for n, (c, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def frames(spark, queries, corpus):
    kind = "vector array<double>, domain string"
    return spark.createDataFrame(queries, f"query_id long, {kind}"), spark.createDataFrame(corpus, f"vec_id long, {kind}")


def rows(df):
    return sorted((r.query_id, r.vec_id, r["rank"], round(r.cosine, 9)) for r in df.collect())


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-8 for a, b in zip(got, want))


def clustered(n, clusters, width, seed, domains=2):
    draw = np.random.RandomState(seed)
    centres = draw.normal(size=(clusters, width))
    return [(i, (centres[i % clusters] + draw.normal(size=width) * 0.15).tolist(), f"d{i % domains}") for i in range(n)]


@pytest.mark.parametrize("by_domain", [True, False])
def test_knn_and_within_against_all_pairs(spark, by_domain, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_BYTES", 8 * 16 * 25)  # cells and their queries are cut into blocks
    monkeypatch.setattr(vector, "SCORE_BYTES", 8 * 25 * 7)
    corpus = clustered(500, 10, 16, 1)
    corpus += [(1000 + i, corpus[3][1], "d1") for i in range(40)]  # equal vectors: ties by id
    queries = corpus[::7] + [(2000, corpus[3][1], "d1"), (2001, corpus[4][1], "d9")]
    q, c = frames(spark, queries, corpus)
    index = vector.CellIndex.build(c, by_domain, cells=24)
    same(rows(vector.knn(q, index, 5)), brute(queries, corpus, 5, by_domain))
    if not by_domain:
        same(rows(vector.within(q, index, least=0.9, most=7)), brute(queries, corpus, 7, False, 0.9))


def test_odd_vectors(spark):
    corpus = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.1], "a"), (3, None, "a"), (4, [0.0, 0.0], "a"), (5, [1.0], "a"), (6, [1.0, 1.0], None), (7, [-1.0, 0.0], "a"), (2, [2.0, 0.1], "a")]
    queries = [(1, [1.0, 0.0], "a"), (9, [3.0], "a"), (10, None, "a"), (11, [0.0, 0.0], "a"), (12, [1.0, 1.0], None)]
    q, c = frames(spark, queries, corpus)
    for by_domain in (True, False):
        same(rows(vector.knn(q, c, 4, by_domain)), brute(queries, corpus, 4, by_domain))
    assert vector.knn(q, c.where("false"), 3).collect() == [] and vector.knn(q.where("false"), c, 3).collect() == []
    assert vector.within(q, c.where("false")).collect() == []


def test_less_than_half_of_the_pairs_are_compared_on_clustered_vectors(spark):
    corpus = clustered(3000, 60, 24, 5, domains=1)
    q, c = frames(spark, corpus[::50], corpus)
    index = vector.CellIndex.build(c, cells=128)
    share = index.share(q, 3)
    assert share < 0.2, share
    same(rows(vector.knn(q, index, 3)), brute(corpus[::50], corpus, 3))


def test_centres_are_bounded_by_bytes(spark):
    _, c = frames(spark, [], clustered(300, 5, 8, 2))
    index = vector.CellIndex.build(c, centre_bytes=8 * 8 * 10)
    assert sum(len(part[0]) for part in index.cells.values()) <= 10 + len(index.cells)


def test_rows_that_meet_all_centres_at_once_are_bounded():
    import pyarrow as pa

    n = 3 * vector.ROWS + 5
    batch = pa.record_batch([pa.array([i % 2 for i in range(n)]), pa.array([[1.0, float(i)] for i in range(n)])], names=["part", "vector"])
    found = list(vector._by_part(batch, 0, 1))
    assert max(len(at) for _, at, _ in found) <= vector.ROWS
    assert sorted(i for _, at, _ in found for i in at.tolist()) == list(range(n))
    assert all(units.shape == (len(at), 2) for _, at, units in found)
