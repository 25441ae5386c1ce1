"""Exact top-k search by integer inner product over an impact-ordered index.

Each component that isn't 0 is a posting of its dimension; a dimension's list is cut
into segments by quantised impact, half an octave of the component's size each. A
search takes segments, of all dimensions, by falling product of impact and query
weight, and adds their parts to the rows' scores, score at a time. What a row still
lacks is bounded by the sizes of its postings not yet taken (Cauchy-Schwarz), so the
k-th best proven score rules rows out. The search stops when it costs less to rescore the
possible members than to go on, or after the last segment, and rescores every one of
them exactly.

Rows are dealt by hash into shards, queries into blocks; each (block, shard) is one
task's cell of bounded size, and the best k of all shards are merged. That stated
query set against all rows costs ``rows * blocks + queries * shards`` rows moved.

Defined cases: vectors that are null or hold null or non-finite components take no
part; nor do rows with a null id; vectors of another length than the query's are no
candidates, and vectors of no components have no results; a query's own id is no
candidate; repeated rows count once, and of several vectors of one id the least
counts. Ties go to the smaller id. Scores are exact; one that no long can hold raises,
as does a scaled component of 2^62 or more.

What a row still lacks is kept as a whole number, so nothing is lost to rounding; sums
of squares that no long can hold make the search rescore all rows instead. Bounds
are widened by more than their doubles can be off.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm import store

#: Bytes of a shard's components and of the scores of the queries taken at a time; queries of a block.
SHARD_BYTES, SCORE_BYTES, BLOCK = 32_000_000, 32_000_000, 8_192
RESULT = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component; null for a vector that takes no part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    large = F.raise_error(F.lit("a component is too large for its posting")).cast("long")
    return F.when(whole, F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) * scale < 2.0**62, F.floor(F.lit(scale) * x.cast("double"))).otherwise(large)))


class ImpactIndex:
    """Postings of the rows' components, in segments (impact, dimension) of falling impact."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.largest = int(np.abs(rows.astype(np.float64)).max()) + 1 if rows.size else 0
        row, dim = np.nonzero(rows)
        value = rows[row, dim]
        impact = np.floor(2 * np.log2(np.abs(value.astype(np.float64)))).astype(np.int32)
        order = np.lexsort((row, dim, -impact))
        self.row, self.value, dim, impact = row[order].astype(np.int32), value[order], dim[order], impact[order]
        first = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (impact[1:] != impact[:-1])]) if len(dim) else np.zeros(0, int)
        self.start, self.end, self.dim, self.impact = first, np.r_[first[1:], len(dim)].astype(int), dim[first], impact[first]
        #: The share of all postings that searches have taken, as (taken, of).
        self.taken = [0, 0]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int):
        """For each query the positions and exact scores of its best k rows, ties to the smaller id."""
        weight = np.abs(queries.astype(np.float64))
        if max(float(weight.max(initial=0)), self.largest) * self.largest * max(1, queries.shape[1]) >= 2.0**62:
            possible = own[:, None] != self.ids[None, :]  # beyond what longs can add up
            yield from self._rescored(self.rows.astype(object), queries.astype(object), possible, k)
            return
        most = float(weight.max(initial=0)) * self.largest * max(1, queries.shape[1])
        # Whole numbers of which every sum is exact: in floats, whose products are fast, where those hold them.
        exact = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64
        q = queries.astype(exact)
        norm = np.sqrt((weight**2).sum(1))
        score = np.zeros((len(queries), len(self.rows)), exact)
        rest = (self.rows**2).sum(1)  # exact: below 2^62
        skip = own[:, None] == self.ids[None, :]
        possible, at = ~skip, min(k, len(self.rows)) - 1
        height = self.impact / 2 + np.log2(np.maximum(weight.max(0), 1e-300))[self.dim]
        order = np.argsort(-height, kind="stable")
        size = self.end - self.start
        done, of, tried, first = 0, int(size.sum()), 0.5, 0
        for n, s in enumerate(order.tolist()):
            done += int(size[s])
            if done >= tried * of or n + 1 == len(order):
                tried += 0.1
                part = self._taken(order[first : n + 1])
                score += q @ part.astype(exact).T
                rest -= (part**2).sum(1)
                first = n + 1
                # A double is off by less than 1e-15 of its value; wider bounds can only keep more rows.
                bound = norm[:, None] * np.sqrt(rest.astype(np.float64))[None, :] * (1 + 1e-9) + np.abs(score.astype(np.float64)) * 1e-12
                low = np.where(skip, -np.inf, score - bound)
                least = np.partition(low, low.shape[1] - 1 - at, axis=1)[:, low.shape[1] - 1 - at]  # k rows are proven to score as much
                possible = (score + bound >= least[:, None]) & ~skip
                if possible.sum() * queries.shape[1] <= (of - done) * len(queries):
                    break  # exact scores of these cost less than the postings that are left
        self.taken = [self.taken[0] + done * len(queries), self.taken[1] + of * len(queries)]
        yield from self._rescored(self.rows, queries, possible, k)

    def _taken(self, segments: np.ndarray) -> np.ndarray:
        """The postings of ``segments`` as a matrix that is 0 elsewhere, so that one product adds their parts of all scores."""
        part = np.zeros_like(self.rows)
        at = np.concatenate([np.arange(self.start[s], self.end[s]) for s in segments])
        part[self.row[at], np.repeat(self.dim[segments], self.end[segments] - self.start[segments])] = self.value[at]
        return part

    def _rescored(self, rows: np.ndarray, queries: np.ndarray, possible: np.ndarray, k: int):
        for i, q in enumerate(queries):
            found = np.flatnonzero(possible[i])
            exact = rows[found] @ q
            if exact.dtype == object:
                order = sorted(range(len(found)), key=lambda j: (-exact[j], self.ids[found[j]]))[:k]
            else:
                order = np.lexsort((self.ids[found], -exact))[:k]
            yield found[order], exact[order]


def _cell(asked, rows, k: int):
    import pandas as pd

    out = []
    if len(asked) and len(rows):
        matrix = np.stack(rows["vector"].to_numpy()).astype(np.int64)
        queries = np.stack(asked["vector"].to_numpy()).astype(np.int64)
        index = ImpactIndex(rows["id"].to_numpy(), matrix)
        own = asked["id"].to_numpy()
        step = max(1, SCORE_BYTES // (8 * len(matrix)))
        for low in range(0, len(queries), step):
            for q, (at, scores) in zip(own[low : low + step], index.search(queries[low : low + step], own[low : low + step], k)):
                out.append(pd.DataFrame({"query_id": q, "vec_id": index.ids[at], "score": scores.astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def search(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the best k rows for each row of ``rows`` that ``queries`` chooses."""
    spark = rows.sparkSession
    ready = rows.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked"))
    ready = ready.where("id is not null and vector is not null").groupBy("id").agg(F.min("vector").alias("vector"), F.max("asked").alias("asked")).withColumn("width", F.size("vector")).where("width > 0")
    ready = store.materialize(ready, "quantised")  # a shuffle of all vectors, read again by both sides and counted
    n, asked, widest = ready.agg(F.count("*"), F.count(F.when(F.col("asked"), 1)), F.coalesce(F.max("width"), F.lit(1))).first()
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 4096))
    shards, blocks = max(1, least, -(-n * 8 * widest // SHARD_BYTES)), max(1, -(-asked // BLOCK))
    deal = lambda count: F.pmod(F.xxhash64("id"), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = ready.where("asked").select("id", "vector", "width", deal(blocks).cast("int").alias("block"), every(shards).alias("shard"))
    right = ready.select(F.col("id").alias("id"), F.col("vector").alias("vector"), F.col("width").alias("width"), every(blocks).alias("block"), deal(shards).cast("int").alias("shard"))
    cell = ["width", "block", "shard"]
    best = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(lambda a, b: _cell(a, b, k), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
