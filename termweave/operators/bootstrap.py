"""Bootstrap intervals of many ratios at many levels, in one pass over the entities.

An entity is drawn a Poisson(1) number of times in each replicate. Its draws come from
md5 of the seed, its key and the number of four replicates at a time, so they are the
same wherever it is processed. A task keeps, for each level, sums of numerators and
denominators of all ratios in all replicates, as arrays: one product of matrices a
batch. What is shuffled is these arrays, a row a task and level and ratio, added up in
two steps, whatever the number of entities.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Draws of 0, 1, 2, ... times, in units of 2^-32: Poisson with mean 1.
_P = [1.0]
for _k in range(1, 13):
    _P.append(_P[-1] / _k)
THRESHOLDS = tuple(int(sum(_P[: k + 1]) / np.e * 2**32) for k in range(12))
#: Bytes of sums that a task holds before it passes them on; rows of a task's first sum.
HELD, SALT = 64_000_000, 64


def draws(key: str, replicates: int, seed: int = 0) -> np.ndarray:
    """How often the entity is drawn in each replicate."""
    blocks = -(-replicates // 4)
    digest = b"".join(hashlib.md5(f"{seed}/{b}/{key}".encode()).digest() for b in range(blocks))
    return np.searchsorted(THRESHOLDS, np.frombuffer(digest, ">u4")[:replicates], side="right").astype(np.float64)


def _sums(rows: DataFrame, count: int, replicates: int, seed: int) -> DataFrame:
    """level, ratio, task, nums, dens of ``rows`` (key, levels, nums, dens); place 0 of a list is the sum without draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def passed() -> pa.RecordBatch:
            levels = sorted(held)
            flat = np.stack([held[x] for x in levels]) if levels else np.zeros((0, 2, count, replicates + 1))
            lists = [pa.array(list(flat[:, i].reshape(-1, replicates + 1)), pa.list_(pa.float64())) for i in (0, 1)]
            out = pa.record_batch([pa.array(np.repeat(np.array(levels, object), count), pa.string()), pa.array(list(range(count)) * len(levels), pa.int32()), *lists], names=["level", "ratio", "nums", "dens"])
            held.clear()
            return out

        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                keys, levels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                weight = np.stack([np.r_[1.0, draws(k or "", replicates, seed)] for k in keys])
                parts = np.stack([np.array([x or [0.0] * count for x in batch.column(c).to_pylist()], np.float64) for c in (2, 3)])  # (2, rows, ratios)
                for level in sorted({x for ls in levels for x in ls}):
                    at = np.array([level in ls for ls in levels])
                    held[level] = held.get(level, 0) + parts[:, at].transpose(0, 2, 1) @ weight[at]
                if len(held) * 16 * count * (replicates + 1) > HELD:
                    yield passed()
        yield passed()

    return rows.select("key", "levels", "nums", "dens").mapInArrow(run, "level string, ratio int, nums array<double>, dens array<double>")


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    """The lists of each group added up, place by place."""
    kinds = rows.schema

    def add(group: pa.Table) -> pa.Table:
        first = {k: [group.column(k)[0].as_py()] for k in keys}
        lists = {c: [sum(np.array(x.as_py()) for x in group.column(c))] for c in ("nums", "dens")}
        return pa.table(first | lists, schema=pa.schema([group.schema.field(c) for c in (*keys, "nums", "dens")]))

    schema = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in (*keys, "nums", "dens"))
    return rows.groupBy(*keys).applyInArrow(add, schema)


def intervals(df: DataFrame, key: Column, levels: Column, ratios: dict[str, tuple[Column, Column]], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """level, ratio, point, low, high: sum(num) / sum(den) of each of ``ratios`` over the rows of each level, with its 95 % percentile interval.

    ``key`` (text) names the entity, ``levels`` (an array) what a row counts for. Replicates
    whose denominators sum to 0 don't count; a ratio over nothing is null. Counts are exact, so results
    do not depend on how rows are dealt.
    """
    count = len(ratios)
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    sides = [c for i in (0, 1) for c in (number(pair[i]) for pair in ratios.values())]
    rows = df.select(key.cast("string").alias("key"), levels.alias("levels"), *(c.alias(f"s{i}") for i, c in enumerate(sides)))
    # Rows of one key have the same draws: added up, they are drawn for once.
    rows = rows.groupBy("key", "levels").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(2 * count)))
    rows = rows.select("key", "levels", F.array(*(f"s{i}" for i in range(count))).alias("nums"), F.array(*(f"s{i}" for i in range(count, 2 * count))).alias("dens"))
    some = _sums(rows, count, replicates, seed).withColumn("task", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    done = _added(_added(some, "level", "ratio", "task"), "level", "ratio")
    pairs = F.zip_with(F.slice("nums", 2, replicates), F.slice("dens", 2, replicates), lambda n, d: F.try_divide(n, d))
    drawn = F.filter(pairs, lambda x: x.isNotNull())
    out = done.withColumn("r", F.array_sort(drawn)).withColumn("m", F.size("r"))
    at = lambda i: F.get("r", F.greatest(F.lit(0), i.cast("int")))
    point = F.try_divide(F.element_at("nums", 1), F.element_at("dens", 1))
    return out.select("level", F.element_at(F.array(*map(F.lit, ratios)), F.col("ratio") + 1).alias("ratio"), point.alias("point"), at(F.floor(F.col("m") * 0.025)).alias("low"), at(F.floor(F.col("m") * 0.975) - 1).alias("high"))
