"""Candidate retrieval: lexical, semantic and combined arms, thresholds, and synonyms led back to their concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.numbers import nearness, or_else, sigmoid, unit_score
from termweave.functions.text import normalize_query
from termweave.operators import lexical, vector
from termweave.operators.dedup import dedup_by_concept, top_by
from termweave.sources.sinks import staged

#: Least raw score of each arm. Fixed values.
THRESHOLDS = {"lexical": 3.0, "semantic": 0.8, "combined": 3.0}
#: Centre and scale of the sigmoid that makes a text score comparable.
CENTER, SCALE = 15.0, 8.0
TOP_K = 3


def normalized(score):
    return sigmoid(score, CENTER, SCALE)


def lexical_arm(entities: DataFrame, docs: DataFrame, k: int = TOP_K, index: lexical.LexicalIndex | None = None) -> DataFrame:
    """entity_id, concept_id, rank, score, norm, arm; the threshold applies after the top k."""
    hits = lexical.lexical_topk(entities, docs, k, index).where(F.col("score") >= THRESHOLDS["lexical"])
    return hits.select("entity_id", "concept_id", "rank", "score", normalized(F.col("score")).alias("norm"), F.lit("lexical").alias("arm"))


#: Nearest neighbours that the combined arm counts.
NEIGHBOURS = 6


def neighbours(entity_vectors: DataFrame, doc_vectors: DataFrame, k: int = NEIGHBOURS, by_domain: bool = True) -> DataFrame:
    """entity_id, concept_id, rank, cosine: what the semantic and the combined arm both need, written once.

    ``entity_vectors``: entity_id, vector, domain; ``doc_vectors``: concept_id, vector, domain.
    """
    hits = vector.knn(entity_vectors.withColumnRenamed("entity_id", "query_id"), doc_vectors.withColumnRenamed("concept_id", "vec_id"), k, by_domain)
    return staged(hits.select(F.col("query_id").alias("entity_id"), F.col("vec_id").alias("concept_id"), "rank", "cosine"), "neighbours")


def semantic_arm(near: DataFrame, k: int = TOP_K) -> DataFrame:
    """The first ``k`` of ``neighbours`` that reach the threshold."""
    score = unit_score(F.col("cosine"))
    hits = near.where(F.col("rank") <= k).withColumn("score", score).where(F.col("score") >= THRESHOLDS["semantic"])
    return hits.select("entity_id", "concept_id", "rank", "score", F.col("score").alias("norm"), F.lit("semantic").alias("arm"))


def hybrid_scores(entities: DataFrame, docs: DataFrame, cosines: DataFrame, knn_share: float = 0.6, text_share: float = 0.4, neighbours: int = NEIGHBOURS, index: lexical.LexicalIndex | None = None) -> DataFrame:
    """entity_id, concept_id, score: 0.6 nearest-neighbour score + 0.4 text score times length similarity.

    ``cosines`` is entity_id, concept_id, cosine; its best ``neighbours`` count.
    """
    near = top_by(cosines, ["entity_id"], neighbours, F.round("cosine", 9).desc(), F.col("concept_id").asc())
    near = near.select("entity_id", "concept_id", (unit_score(F.col("cosine")) * knn_share).alias("near"))
    text = lexical.text_scores(entities, docs, with_phrase=False, match_boost=2.5, index=index)
    text = text.join(entities.select("entity_id", normalize_query(F.col("entity_name")).alias("asked")), "entity_id").join(docs.select("concept_id", F.length("concept_name").alias("chars")), "concept_id")  # of the text no more than its length moves
    text = text.select("entity_id", "concept_id", (F.col("score") * text_share * nearness(F.col("chars"), F.length("asked"))).alias("text"))
    both = near.join(text, ["entity_id", "concept_id"], "full")
    return both.select("entity_id", "concept_id", (F.coalesce("near", F.lit(0.0)) + F.coalesce("text", F.lit(0.0))).alias("score"))


def combined_arm(entities: DataFrame, docs: DataFrame, cosines: DataFrame, k: int = TOP_K, index: lexical.LexicalIndex | None = None) -> DataFrame:
    scored = hybrid_scores(entities, docs, cosines, index=index)
    best = top_by(scored, ["entity_id"], k, F.round("score", 9).desc(), F.col("concept_id").asc(), rank="rank").where(F.col("score") >= THRESHOLDS["combined"])
    return best.select("entity_id", "concept_id", "rank", "score", normalized(F.col("score")).alias("norm"), F.lit("combined").alias("arm"))


def to_originals(hits: DataFrame, names: DataFrame) -> DataFrame:
    """Hits on a synonym take the name of their original concept, and keep their score and the synonym found.

    A hit has concept_id, concept_name, name_type; ``names`` the same. A synonym
    whose original is missing stays as it is.
    """
    original = names.where("name_type = 'Original'").select("concept_id", F.col("concept_name").alias("original_name"))
    found = hits.join(original, "concept_id", "left")
    led = (F.col("name_type") == "Synonym") & F.col("original_name").isNotNull()
    return found.select(
        *(F.col(c) for c in hits.columns if c not in ("concept_name", "name_type")),
        F.when(led, F.col("concept_name")).alias("matched_synonym"),
        F.when(led, F.col("original_name")).otherwise(F.col("concept_name")).alias("concept_name"),
        F.when(led, "Original").otherwise(F.col("name_type")).alias("name_type"),
    )


ARM_ORDER = ("lexical", "semantic", "combined")


def merge_arms(arms: DataFrame, keys: tuple[str, ...] = ("entity_id", "concept_id", "concept_name")) -> DataFrame:
    """One row for each concept of an entity: the best normalised score, the earlier arm among equals.

    A normalised score of 0 counts as absent and gives way to the raw one.
    """
    arm = F.array_position(F.array(*map(F.lit, ARM_ORDER)), F.col("arm"))
    return dedup_by_concept(arms, or_else(F.col("norm"), F.col("score")), arm * 1000 + F.col("rank"), keys)
