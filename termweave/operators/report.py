"""Rows for a report from candidates that hold their concept as a nested value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.functions.numbers import or_else

#: Fields of a concept in a report, all and those of the second stage. Fixed values.
FULL = ("concept_id", "concept_name", "domain_id", "vocabulary_id", "concept_class_id", "standard_concept", "concept_code", "valid_start_date", "valid_end_date", "invalid_reason")
SHORT = ("concept_id", "concept_name", "domain_id", "vocabulary_id", "standard_concept")
#: Fields that are null where the concept lacks them; others are empty.
NULLABLE = ("valid_start_date", "valid_end_date", "invalid_reason")
#: What each stage adds: column, type, and the value where it is missing. Fixed values.
ADDED = {
    1: (("elasticsearch_score", "double", None), ("search_type", "string", "unknown")),
    2: (("is_original_standard", "boolean", True), ("search_type", "string", "unknown"), ("relation_type", "string", "original"), ("elasticsearch_score", "double", 0.0)),
    3: (
        ("is_original_standard", "boolean", True), ("llm_score", "double", None), ("llm_rank", "int", None), ("llm_reasoning", "string", ""), ("final_score", "double", 0.0), ("search_type", "string", "unknown"),
        ("semantic_similarity", "double", None), ("text_similarity", "double", None),
    ),
}


def rows(candidates: DataFrame, stage: int, keys: list[str]) -> DataFrame:
    """keys, the fields of ``concept`` (a struct) and what the stage adds, a row for each candidate.

    Stage 1 takes its score from score_normalized, or from score where that is null or 0.
    Later stages have original_non_standard (id and name) of a candidate that was mapped from another, else null.
    """
    held = set(candidates.schema["concept"].dataType.names)

    def field(name: str) -> Column:
        given = F.col(f"concept.{name}").cast("string") if name in held else F.lit(None).cast("string")
        return (given if name in NULLABLE else F.coalesce(given, F.lit(""))).alias(name)

    if stage == 1:
        candidates = candidates.withColumn("elasticsearch_score", or_else(F.col("score_normalized"), F.col("score")))

    def added(name: str, kind: str, missing) -> Column:
        given = F.col(name).cast(kind) if name in candidates.columns else F.lit(None).cast(kind)
        return (given if missing is None else F.coalesce(given, F.lit(missing))).alias(name)

    out = [*keys, *(field(n) for n in (SHORT if stage == 2 else FULL)), *(added(*a) for a in ADDED[stage])]
    if stage > 1:
        kind = T.StructType([T.StructField("concept_id", T.StringType()), T.StructField("concept_name", T.StringType())])
        given = F.struct(F.coalesce(F.col("original.concept_id").cast("string"), F.lit("")).alias("concept_id"), F.coalesce("original.concept_name", F.lit("")).alias("concept_name")) if "original" in candidates.columns else F.lit(None).cast(kind)
        mapped = ~F.coalesce(F.col("is_original_standard"), F.lit(True)) if "is_original_standard" in candidates.columns else F.lit(False)
        has = F.col("original").isNotNull() if "original" in candidates.columns else F.lit(False)
        out.append(F.when(mapped & has, given).alias("original_non_standard"))
    return candidates.select(*out)
