"""Removal of duplicates with a stated winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in ``order``, which must be total."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def top_by(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows for each key; the planner limits each group before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def dedup_by_concept(df: DataFrame, score: Column, seq: Column, keys: tuple[str, ...] = ("concept_id", "concept_name")) -> DataFrame:
    """The best score for each key, the first in ``seq`` among equals; null scores are lowest."""
    return first_by(df, list(keys), F.coalesce(score, F.lit(0.0)).desc(), seq.asc())


def upsert(old: DataFrame | None, new: DataFrame, key: str, seq: str) -> DataFrame:
    """The rows of both with the last ``seq`` for each key."""
    rows = new if old is None else old.unionByName(new)
    return first_by(rows, [key], F.col(seq).desc())
