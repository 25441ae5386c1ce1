"""Standardisation: candidates lead over relationships to standard concepts, in two rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.operators.clean import STANDARD, is_standard
from termweave.operators.dedup import dedup_by_concept, first_by

#: Relationships that transform a candidate. Fixed values.
TRANSFORM = ("Concept alt_to to", "Concept poss_eq to", "Concept same_as to", "Marketed form of", "Tradename of", "Box of", "Has quantified form", "Is a")
MAPS_TO = "Maps to"
MOST_RELATED, MOST_MAPPED = 50, 10
ENTITY_CONCEPT = ("entity_id", "concept_id", "concept_name")
CONCEPT = ("concept_id", "concept_name", "standard_concept")


def related(candidates: DataFrame, edges: DataFrame, concepts: DataFrame, relationships: tuple[str, ...] = TRANSFORM, most: int = MOST_RELATED) -> DataFrame:
    """For each candidate (concept_id) its neighbours: from_id, relation and the neighbour's columns.

    At most ``most`` edges in the order of neighbour and relationship, an edge that
    is repeated as one; a neighbour counts once, by its first edge.

    Edges are shuffled once, and the only thing that a task holds of them is one sort,
    which repeats, places and first edges are read off.
    """
    ids = candidates.select(F.col("concept_id").alias("from_id")).distinct()
    found = edges.where(F.col("relationship_id").isin(*relationships)).select(F.col("concept_id_1").alias("from_id"), F.col("concept_id_2").alias("concept_id"), F.col("relationship_id").alias("relation"))
    found = found.join(ids.hint("shuffle_hash"), "from_id", "left_semi")
    order = Window.partitionBy("from_id").orderBy(F.col("concept_id").asc(), F.col("relation").asc())
    found = found.withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= most)
    found = found.withColumn("_last", F.lag("concept_id").over(order)).where("_last is null or _last <> concept_id")
    return found.drop("_rank", "_last").join(concepts, "concept_id")


def mapped(candidates: DataFrame, edges: DataFrame, concepts: DataFrame, most: int = MOST_MAPPED) -> DataFrame:
    """For each candidate (concept_id) the standard concepts it maps to: from_id and their columns."""
    found = related(candidates, edges, concepts, (MAPS_TO,), most)
    return found.where(F.col("standard_concept").isin(*STANDARD)).drop("relation")


def one_round(candidates: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Candidates and their neighbours; standard ones as they are, others replaced by what they map to.

    ``candidates``: entity_id, seq, concept columns, from_name, score. The result has
    relation and a new seq: the candidate's, then 0 for itself or the neighbour's
    place, then the place of the mapped concept. A concept counts once for an entity,
    by its best score and first place.
    """
    here = candidates.select("entity_id", "seq", *CONCEPT, "from_name", F.lit("original").alias("relation"), "score", F.lit("").alias("via"))
    near = related(candidates, edges, concepts).select("from_id", *CONCEPT, "relation")
    hop = candidates.select("entity_id", "seq", F.col("concept_id").alias("from_id"), F.col("concept_name").alias("from_name")).join(near, "from_id")
    hop = hop.select("entity_id", "seq", *CONCEPT, "from_name", "relation", F.lit(0.0).alias("score"), F.col("concept_id").alias("via"))
    both = here.unionByName(hop)
    kept = both.where(is_standard(F.col("standard_concept"))).withColumn("target", F.lit(""))
    rest = both.where(~is_standard(F.col("standard_concept")))
    # An entity's ways to one concept lead on to the same ones, with a score of 0 and in the order of their places (of equal length), so the first stands for them.
    way = F.concat_ws("/", "seq", F.rpad("via", 12, " "))
    rest = first_by(rest.withColumn("_long", F.length(way)), ["entity_id", "concept_id", "_long"], way.asc()).drop("_long")
    to = mapped(rest, edges, concepts).select("from_id", *(F.col(c).alias(f"to_{c}") for c in CONCEPT))
    led = rest.join(to, rest["concept_id"] == to["from_id"]).select(
        "entity_id", "seq", *(F.col(f"to_{c}").alias(c) for c in CONCEPT), F.col("concept_name").alias("from_name"), F.lit(MAPS_TO).alias("relation"), F.lit(0.0).alias("score"), "via", F.col("to_concept_id").alias("target")
    )
    out = kept.unionByName(led)
    out = out.withColumn("seq", F.concat_ws("/", "seq", F.rpad("via", 12, " "), F.rpad("target", 12, " "))).drop("via", "target")
    return dedup_by_concept(out, F.col("score"), F.col("seq"), ENTITY_CONCEPT)


def two_rounds(candidates: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Standard candidates of each entity: round one, round two on its result, the best score and first place of each concept."""
    first = one_round(candidates, edges, concepts)
    second = one_round(first.drop("relation"), edges, concepts)
    both = first.withColumn("seq", F.concat(F.lit("1/"), "seq")).unionByName(second.withColumn("seq", F.concat(F.lit("2/"), "seq")))
    return dedup_by_concept(both, F.col("score"), F.col("seq"), ENTITY_CONCEPT)
