"""Standard projections of the driver's tables, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def concept(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        key.cast("string").alias("concept_id"), F.col("p_name").alias("concept_name"), F.col("p_type").alias("domain_id"), F.col("p_brand").alias("vocabulary_id"),
        F.when(key % 3 == 0, "S").when(key % 3 == 1, "C").alias("standard_concept"),
    )


def edge_rows(spark: SparkSession, d: str) -> DataFrame:
    """Relationships with their repeats."""
    rel = F.when(F.col("l_returnflag") == "R", "Maps to").when(F.col("l_returnflag") == "A", "Is a").otherwise("Marketed form of")
    return table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("concept_id_1"), F.col("l_suppkey").cast("string").alias("concept_id_2"), rel.alias("relationship_id"))


def edge(spark: SparkSession, d: str) -> DataFrame:
    return edge_rows(spark, d).distinct()


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("run_seq"), F.col("event_type").alias("answer"), F.col("value").alias("score"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("tag"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), F.col("event_id").alias("seq"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("concept_id"), F.col("text").alias("concept_name"), F.col("lang").alias("domain_id"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items; every other one is asked in English only."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), F.col("text").alias("entity_name"), F.when(F.col("item_id") % 2 == 0, "en").alias("domain_id"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("domain"))


def r6(c):
    return F.round(c, 6)


#: The same projections for the SQL side.
CONCEPT = "concept AS (SELECT CAST(p_partkey AS VARCHAR) AS concept_id, p_name AS concept_name, p_type AS domain_id, p_brand AS vocabulary_id, CASE p_partkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'C' END AS standard_concept FROM part)"
EDGE = "edge AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS concept_id_1, CAST(l_suppkey AS VARCHAR) AS concept_id_2, CASE l_returnflag WHEN 'R' THEN 'Maps to' WHEN 'A' THEN 'Is a' ELSE 'Marketed form of' END AS relationship_id FROM lineitem)"
RUNS = "runs AS (SELECT user_id AS entity, event_id AS run_seq, event_type AS answer, value AS score FROM events)"
CALLS = "calls AS (SELECT event_type AS tag, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, event_id AS seq FROM events)"


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
