"""Cleaning of vocabulary, relationship and synonym tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.dates import normalize_date
from termweave.functions.text import null_if

STANDARD = ("S", "C")
TEXT_COLUMNS = ("concept_name", "domain_id", "vocabulary_id", "concept_class_id", "name_type")
DATE_COLUMNS = ("valid_start_date", "valid_end_date")
ENGLISH = "4180186"


def standard_flag(c: Column) -> Column:
    return F.when(c.isin(*STANDARD), c)


def is_standard(c: Column) -> Column:
    return F.coalesce(c.isin(*STANDARD), F.lit(False))


def _dates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: normalize_date(F.col(c)) for c in DATE_COLUMNS if c in df.columns})


def clean_concepts(df: DataFrame) -> DataFrame:
    """Rows without id or name go first; then names that are blank become null and stay."""
    df = df.dropna(subset=["concept_id", "concept_name"]).withColumn("concept_id", F.col("concept_id").cast("string"))
    df = df.withColumns({c: null_if(F.col(c)) for c in TEXT_COLUMNS if c in df.columns})
    if "standard_concept" in df.columns:
        df = df.withColumn("standard_concept", standard_flag(F.col("standard_concept")))
    return _dates(df)


def clean_relationships(df: DataFrame) -> DataFrame:
    df = df.dropna(subset=["concept_id_1", "concept_id_2"])
    return _dates(df.withColumns({c: F.col(c).cast("string") for c in ("concept_id_1", "concept_id_2")}))


def clean_synonyms(df: DataFrame) -> DataFrame:
    """Names are cleaned first, so rows with a blank name go."""
    name = null_if(F.col("concept_synonym_name"), ("", "None", "nan"))
    return df.withColumn("concept_synonym_name", name).dropna(subset=["concept_id", "concept_synonym_name"]).withColumn("concept_id", F.col("concept_id").cast("string"))


def english(df: DataFrame, language: str = ENGLISH) -> DataFrame:
    return df.where(F.col("language_concept_id").cast("string") == language)


def keep_relationships(df: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """Rows of the named relationships; the predicate reaches the scan."""
    return df.where(F.col("relationship_id").isin(*ids))
