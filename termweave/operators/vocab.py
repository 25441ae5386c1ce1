"""The merged vocabulary of names: concepts and their synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import doc_id
from termweave.operators.dedup import first_by, top_by

#: Relationships that are loaded. Fixed values.
LOADED = ("Maps to", "Concept alt_to to", "Concept poss_eq to", "Concept same_as to", "Marketed form of", "Tradename of", "Box of", "Has quantified form")
ADDED = "Is a"


def names(concepts: DataFrame, synonyms: DataFrame, how: str = "inner") -> DataFrame:
    """Concepts (name_type Original) and synonyms (Synonym) with their concept's columns.

    Synonyms without a concept go with ``how="inner"`` and stay, with null columns,
    with ``how="left"``. Synonyms join the concepts' other columns on the id.
    """
    meta = concepts.drop("concept_name")
    named = synonyms.select("concept_id", F.col("concept_synonym_name").alias("concept_name")).join(meta, "concept_id", how)
    both = concepts.withColumn("name_type", F.lit("Original")).unionByName(named.withColumn("name_type", F.lit("Synonym")))
    return both


def one_for_each_concept(df: DataFrame, *order: Column) -> DataFrame:
    return first_by(df, ["concept_id"], *order)


def with_doc_ids(df: DataFrame) -> DataFrame:
    """Lower-cased names and the id that makes a repeated load harmless."""
    return df.withColumn("concept_name", F.lower("concept_name")).withColumn("doc_id", doc_id(F.col("concept_id"), F.col("concept_name")))


def one_for_each_doc(df: DataFrame) -> DataFrame:
    """Where a synonym equals its concept's name, the original stays."""
    return first_by(df, ["doc_id"], F.col("name_type").asc(), F.col("concept_id").asc())


def name_type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("name_type").agg(F.count("*").alias("n"))


#: Entries that a look-up of a concept's synonyms gives at most. Fixed value.
MOST_SYNONYMS = 1000


def synonym_lists(rows: DataFrame, key: str, name: str, *order: Column, most: int = MOST_SYNONYMS) -> DataFrame:
    """key, synonyms: the distinct names among the first ``most`` rows of each key in ``order``, in that order; empty ones don't count.

    Each task passes on ``most`` rows of a key at most, so no concept is gathered whole.
    """
    few = top_by(rows.select(key, name, *(o.alias(f"_o{i}") for i, o in enumerate(order))), [key], most, *(F.col(f"_o{i}").asc() for i in range(len(order))), F.col(name).asc(), rank="_n")
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col(name) != "", F.struct("_n", name)))), lambda x: x[name])
    return few.groupBy(key).agg(F.array_distinct(listed).alias("synonyms"))
