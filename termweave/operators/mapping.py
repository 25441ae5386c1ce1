"""Results: validation order, best and alternatives, bands, and the choice among domains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.numbers import confidence

#: The domains an entity without one is tried in, and all known ones. Fixed values.
DEFAULT_DOMAINS = ("Drug", "Observation", "Procedure", "Condition", "Measurement", "Device")
DOMAINS = ("Procedure", "Condition", "Drug", "Observation", "Measurement", "Threshold", "Demographics", "Period", "Provider", "Device")
ATTEMPTS = 3


def fan_out(entities: DataFrame, domains: tuple[str, ...] = DEFAULT_DOMAINS) -> DataFrame:
    """A row for each entity and domain; entities without a domain get all of ``domains``."""
    every = F.array(*map(F.lit, domains))
    return entities.withColumn("domain_id", F.explode(F.when(F.col("domain_id").isNull(), every).otherwise(F.array("domain_id"))))


def validated(candidates: DataFrame, judge: Callable[[str, str, list], bool], attempts: int = ATTEMPTS) -> DataFrame:
    """``candidates`` (entity_id, entity_name, concept_id, concept_name, rank) with valid for the first ``attempts``; null beyond."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch["synonyms"] if "synonyms" in batch else [[]] * len(batch)
            batch["valid"] = [bool(judge(e, c, list(s) if s is not None else [])) if r <= attempts else None for e, c, s, r in zip(batch["entity_name"], batch["concept_name"], known, batch["rank"])]
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    return candidates.mapInPandas(run, f"{fields}, valid boolean")


def first_valid(df: DataFrame, key: str, rank: Column, valid: Column, attempts: int = ATTEMPTS) -> DataFrame:
    """key, valid_rank: the first of the best ``attempts`` that is valid, null if none is."""
    return df.where(rank <= attempts).groupBy(key).agg(F.min(F.when(valid, rank)).alias("valid_rank"))


def valid_first(df: DataFrame, key: str, rank: str, chosen: str) -> DataFrame:
    """The chosen row first, the others in their order, as ``final_rank``."""
    order = Window.partitionBy(key).orderBy((F.coalesce(F.col(rank) == F.col(chosen), F.lit(False))).desc(), F.col(rank))
    return df.withColumn("final_rank", F.row_number().over(order))


def best_with_alternatives(df: DataFrame, keys: list[str], rank: str, item: str, most: int = 3) -> DataFrame:
    """keys, best, alternatives: the first item and the next ``most``, in order."""
    few = df.where(F.col(rank) <= most + 1)
    items = F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda x: x[item])
    listed = few.groupBy(*keys).agg(items.alias("items"))
    return listed.select(*keys, F.get("items", F.lit(0)).alias("best"), F.slice("items", 2, most).alias("alternatives"))


def method(standard: Column) -> Column:
    return F.when(standard, "direct_standard").otherwise("non_standard_to_standard")


def results(df: DataFrame) -> DataFrame:
    """Final rows from ranked candidates (final_score, is_standard): confidence and method."""
    return df.withColumn("confidence", confidence(F.col("final_score"))).withColumn("method", method(F.col("is_standard")))


def best_of(df: DataFrame, key: str, score: Column, item: Column, seq: Column) -> DataFrame:
    """key, best, best_score: the item of the highest score, the first in ``seq`` among equals."""
    top = F.max_by(F.struct(item.alias("item"), score.alias("score")), F.struct(score, -seq))
    return df.groupBy(key).agg(top.alias("t")).select(key, F.col("t.item").alias("best"), F.col("t.score").alias("best_score"))


def failure_reason(stage1: Column, stage2: Column, stage3: Column, valid: Column) -> Column:
    """The first stage that left nothing; null if none did."""
    return F.when(stage1 == 0, "stage1_no_candidates").when(stage2 == 0, "stage2_no_candidates").when(stage3 == 0, "stage3_scoring_failed").when(valid.eqNullSafe(F.lit(False)), "validation_failed")


def fullest_domain(df: DataFrame, key: str, domain: str, s1: Column, s2: Column, s3: Column) -> DataFrame:
    """key, domain with the most candidate information: stage 3, then stage 2, then stage 1; ties by name."""
    weight = s3 * 10000 + s2 * 100 + s1
    order = Window.partitionBy(key).orderBy(weight.desc(), F.col(domain))
    return df.withColumn("weight", weight).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
