"""Batches of entities: sampling, input columns, repeated runs and their agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.operators.dedup import top_by
from termweave.sources.sinks import staged


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


#: Pages that end within so many rows are taken from a heap of that size in each task.
NEAR = 10_000


def page(df: DataFrame, skip: int, most: int | None, *order: Column, near: int = NEAR) -> DataFrame:
    """``most`` rows from the one at ``skip`` on, in ``order``; all of them if null.

    A page near the start is a top k. For others all rows are sorted into ranges, written
    and counted, and only the ranges that the page lies in are read: no task holds
    what is skipped. A count for each range reaches the driver.
    """
    if most is not None and skip + most <= near:
        return df.orderBy(*order).offset(skip).limit(most)
    place = F.monotonically_increasing_id()  # the range in the upper bits, the row's number below
    rows = staged(df.orderBy(*order).select(place.alias("_place"), F.struct(*df.columns).alias("_row")), "page")
    counts = sorted(tuple(r) for r in rows.groupBy(F.shiftright("_place", 33)).agg(F.count("*")).collect())
    total = sum(n for _, n in counts)

    def at(rank: int) -> int:
        """The place of the row of that rank."""
        for part, n in counts:
            if rank < n:
                return (part << 33) + rank
            rank -= n
        raise ValueError("beyond the last row")

    end = total if most is None else min(total, skip + most)
    if skip >= end:
        return df.limit(0)
    return rows.where(F.col("_place").between(at(skip), at(end - 1))).orderBy("_place").select("_row.*")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their key."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), key).limit(n)


def stratified(df: DataFrame, stratum: str, n: int, *order: Column) -> DataFrame:
    return top_by(df, [stratum], n, *order)


def repeat(entities: DataFrame, runs: int) -> DataFrame:
    """A row for each entity and run, numbered from 1."""
    return entities.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def is_correct(answer: Column, truth: Column) -> Column:
    """Ids equal as numbers; what is no number isn't correct."""
    number = lambda c: c.cast("string").try_cast("double").try_cast("bigint")
    return F.coalesce(number(answer) == number(truth), F.lit(False))


def status(success: Column, correct: Column) -> Column:
    return F.when(~success, "Failed").when(correct, "Correct").otherwise("Incorrect")


def agreement(runs: DataFrame, key: str, answer: str, correct: Column) -> DataFrame:
    """key, runs, identical (all answers equal, null as one of them), n_correct."""
    return runs.groupBy(key).agg(F.count("*").alias("runs"), (F.countDistinct(F.coalesce(F.col(answer).cast("string"), F.lit(""))) == 1).alias("identical"), F.count_if(correct).alias("n_correct"))


def pivot_runs(runs: DataFrame, keys: list[str], run: str, cell: Column, n: int, prefix: str = "run") -> DataFrame:
    """A column for each run 1..n; the list is given, so no pass finds it."""
    wide = runs.withColumn("_cell", cell).groupBy(*keys).pivot(run, list(range(1, n + 1))).agg(F.first("_cell", ignorenulls=True))
    return wide.withColumnsRenamed({str(i): f"{prefix}{i}" for i in range(1, n + 1)})


def mode_answer(runs: DataFrame, key: str, answer: str, seq: str, meta: str) -> DataFrame:
    """The most frequent answer, the first seen among equals, with the meta data of its last occurrence."""
    per = runs.where(F.col(answer).isNotNull()).groupBy(key, answer).agg(F.count("*").alias("run_count"), F.min(seq).alias("first_seen"), F.max_by(meta, seq).alias(meta))
    order = Window.partitionBy(key).orderBy(F.desc("run_count"), "first_seen")
    return per.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "first_seen")


def cell_text(df: DataFrame, keys: list[str], score: Column, line: Column, most: int, tie: Column) -> DataFrame:
    """keys, cell: the best ``most`` lines, separated by blank lines."""
    ranked = df.select(*keys, line.alias("line"), F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), tie)).alias("n")).where(F.col("n") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return ranked.groupBy(*keys).agg(F.array_join(lines, "\n\n").alias("cell"))
