"""The whole mapping of names to concepts as one plan: retrieve, standardise, score, validate, choose."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.numbers import or_else
from termweave.operators import batch, lexical, mapping, retrieve, score, standardize, vocab
from termweave.sources.files import exists
from termweave.sources.sinks import staged


@dataclass(frozen=True)
class Vocabulary:
    """What names are mapped to.

    ``names``: doc_id, concept_id, concept_name, name_type, domain_id, vocabulary_id,
    standard_concept, a row for each original or synonym; ``edges``: concept_id_1,
    concept_id_2, relationship_id; ``vectors``: doc_id, vector, if there are any.
    """

    names: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None

    @property
    def originals(self) -> DataFrame:
        return self.names.where("name_type = 'Original'")


def _pairs(entities: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """A row for each entity and domain; pair names it."""
    asked = mapping.fan_out(entities.select(F.col("entity_id").cast("string").alias("entity_id"), "entity_name", "domain_id"), domains)
    return asked.withColumn("pair", F.concat_ws("|", "entity_id", "domain_id"))


def retrieved(pairs: DataFrame, vocabulary: Vocabulary, entity_vectors: DataFrame | None = None) -> DataFrame:
    """Stage 1: the candidates of each pair, one row for a concept: pair, concept columns, arm, rank, score, norm, matched_synonym.

    Without vectors only the lexical arm is asked, and its hits keep that label.
    """
    asked = pairs.select(F.col("pair").alias("entity_id"), "entity_name", "domain_id")
    docs = vocabulary.names.select(F.col("doc_id").alias("concept_id"), "concept_name", "domain_id")
    index = lexical.LexicalIndex.build(asked, docs)
    arms = retrieve.lexical_arm(asked, docs, index=index)
    if entity_vectors is not None and vocabulary.vectors is not None:
        own = pairs.join(entity_vectors.select(F.col("entity_id").cast("string").alias("entity_id"), "vector"), "entity_id")
        queries = own.select(F.col("pair").alias("entity_id"), "vector", F.col("domain_id").alias("domain"))
        corpus = vocabulary.names.join(vocabulary.vectors, "doc_id").select(F.col("doc_id").alias("concept_id"), "vector", F.col("domain_id").alias("domain"))
        near = retrieve.neighbours(queries, corpus)
        arms = arms.unionByName(retrieve.semantic_arm(near)).unionByName(retrieve.combined_arm(asked, docs, near, index=index))
    named = arms.withColumnsRenamed({"concept_id": "doc_id"}).join(vocabulary.names.select("doc_id", "concept_id", "concept_name", "name_type"), "doc_id").drop("doc_id")
    led = retrieve.to_originals(named, vocabulary.names.select("concept_id", "concept_name", "name_type"))
    return retrieve.merge_arms(led).withColumnRenamed("entity_id", "pair")


def standardised(candidates: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Stage 2: standard candidates: pair, concept columns, relation, from_name, score, seq."""
    arm = F.array_position(F.array(*map(F.lit, retrieve.ARM_ORDER)), F.col("arm"))
    concepts = vocabulary.originals.select(*standardize.CONCEPT)
    found = candidates.select("pair", "concept_id", "concept_name", F.lpad((arm * 1000 + F.col("rank")).cast("string"), 6, "0").alias("seq"), or_else(F.col("norm"), F.col("score")).alias("score"))
    seeds = found.join(concepts.drop("concept_name"), "concept_id", "left").withColumn("from_name", F.lit(None).cast("string")).withColumnRenamed("pair", "entity_id")
    return standardize.two_rounds(seeds, vocabulary.edges, concepts).withColumnRenamed("entity_id", "pair")


def scored(candidates: DataFrame, pairs: DataFrame, vocabulary: Vocabulary, mode: str, judge: Callable[[str], str] | None = None, entity_vectors: DataFrame | None = None) -> DataFrame:
    """Stage 3: final_score and rank of each candidate of a pair."""
    meta = vocabulary.originals.select("concept_id", "doc_id", F.col("domain_id").alias("concept_domain"), "vocabulary_id")
    rows = candidates.join(meta, "concept_id", "left").join(pairs.select("pair", F.col("entity_id").alias("entity"), "entity_name"), "pair")
    none = F.lit(None).cast("array<double>")
    if entity_vectors is not None and vocabulary.vectors is not None:
        mine = entity_vectors.select(F.col("entity_id").cast("string").alias("entity"), F.col("vector").cast("array<double>").alias("entity_vector"))
        theirs = vocabulary.vectors.select("doc_id", F.col("vector").cast("array<double>").alias("concept_vector"))
        rows = rows.join(mine, "entity", "left").join(theirs, "doc_id", "left")
    else:
        rows = rows.withColumns({"entity_vector": none, "concept_vector": none})
    rows = rows.drop("doc_id", "entity").withColumnsRenamed({"pair": "entity_id", "concept_domain": "domain_id"})
    return score.score(rows, mode, judge).drop("entity_vector", "concept_vector").withColumnRenamed("entity_id", "pair")


def _stage(df: Callable[[], DataFrame], spark, folder: str | None, name: str) -> DataFrame:
    """A stage's table: below ``folder``, where a run before may have left it whole, else a scratch table."""
    if folder is None:
        return staged(df(), name)
    path = f"{folder.rstrip('/')}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        df().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def map_runs(
    entities: DataFrame, vocabulary: Vocabulary, runs: int = 1, mode: str = "semantic", judge: Callable[[str], str] | None = None, entity_vectors: DataFrame | None = None,
    validator: Callable[[str, str, list], bool] | None = None, domains: tuple[str, ...] = mapping.DEFAULT_DOMAINS, folder: str | None = None,
) -> DataFrame:
    """A row for each run, entity (entity_id, entity_name, domain_id) and domain.

    run, entity_id, domain_id, best concept columns, final_score, confidence, method,
    alternatives (the next three ids), is_best (over the entity's domains, the first
    among equals) and failure_reason, null where a concept was found.

    Candidates are the same in every run and found once; each run asks the judge and
    the validator again. The validator is told the concept's synonyms. With ``folder`` every stage's table is kept
    there, and a run that is started again goes on after the last one that is whole.
    """
    spark = entities.sparkSession
    pairs = _pairs(entities, domains)
    # A handful of candidates for each pair: written, they are made once and every later plan is short.
    first = _stage(lambda: retrieved(pairs, vocabulary, entity_vectors), spark, folder, "retrieved")
    second = _stage(lambda: standardised(first, vocabulary), spark, folder, "standardised")
    repeated = lambda df: df.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("pair", F.concat_ws("#", "run", "pair"))
    pairs = repeated(pairs)
    third = _stage(lambda: scored(repeated(second).drop("run"), pairs, vocabulary, mode, judge, entity_vectors), spark, folder, "scored")
    if validator is not None:
        told = vocabulary.names.where("name_type = 'Synonym'").join(third.select("concept_id").distinct(), "concept_id", "left_semi")
        hints = vocab.synonym_lists(told, "concept_id", "concept_name", F.col("doc_id"))
        asked = third.select("pair", "entity_name", "concept_id", "concept_name", "rank").join(hints, "concept_id", "left")
        judged = _stage(lambda: mapping.validated(asked, validator).select("pair", "concept_id", "rank", "valid"), spark, folder, "validated")
        chosen = mapping.first_valid(judged, "pair", F.col("rank"), F.col("valid")).withColumnRenamed("valid_rank", "chosen")
        third = mapping.valid_first(third.join(chosen, "pair", "left"), "pair", "rank", "chosen")
    else:
        third = third.withColumn("final_rank", F.col("rank")).withColumn("chosen", F.lit(1))
    others = mapping.best_with_alternatives(third, ["pair"], "final_rank", "concept_id").select("pair", "alternatives")
    best = third.where("final_rank = 1").withColumn("is_standard", F.col("relation") == "original")
    best = mapping.results(best).select("pair", "concept_id", "concept_name", F.col("domain_id").alias("concept_domain"), "relation", "final_score", "confidence", "method", "chosen").join(others, "pair")
    count = lambda df, name: repeated(df.groupBy("pair").agg(F.count("*").alias(name))).drop("run")
    out = pairs.join(count(first, "stage1"), "pair", "left").join(count(second, "stage2"), "pair", "left").join(best, "pair", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    why = mapping.failure_reason(n("stage1"), n("stage2"), F.when(F.col("concept_id").isNull(), 0).otherwise(1), F.col("chosen").isNotNull())
    out = out.withColumn("failure_reason", why).withColumn("asked", F.concat_ws("#", "run", "entity_id"))
    place = F.array_position(F.array(*map(F.lit, domains)), F.col("domain_id"))
    top = mapping.best_of(out.where("failure_reason is null"), "asked", F.col("final_score"), F.col("pair"), place).select("asked", F.col("best").alias("best_pair"))
    out = out.join(top, "asked", "left").withColumn("is_best", F.coalesce(F.col("pair") == F.col("best_pair"), F.lit(False)))
    return out.drop("asked", "pair", "best_pair", "chosen", "stage1", "stage2")


def map_entities(
    entities: DataFrame, vocabulary: Vocabulary, mode: str = "semantic", judge: Callable[[str], str] | None = None, entity_vectors: DataFrame | None = None,
    validator: Callable[[str, str, list], bool] | None = None, domains: tuple[str, ...] = mapping.DEFAULT_DOMAINS,
) -> DataFrame:
    """``map_runs`` of a single run, without its number."""
    return map_runs(entities, vocabulary, 1, mode, judge, entity_vectors, validator, domains).drop("run")


def run_summary(results: DataFrame, truth: DataFrame) -> DataFrame:
    """entity_id, runs, found, identical (all runs gave one answer, none included), n_correct, answer (the most frequent) of ``map_runs`` against ``truth`` (entity_id, truth_id).

    An entity's answer in a run is its best over the domains; a run without one counts as an answer of its own.
    """
    runs = results.groupBy("entity_id", "run").agg(F.max(F.when(F.col("is_best"), F.col("concept_id"))).alias("answer"))
    rows = runs.join(truth.select(F.col("entity_id").cast("string").alias("entity_id"), "truth_id"), "entity_id", "left")
    agreed = batch.agreement(rows, "entity_id", "answer", batch.is_correct(F.col("answer"), F.col("truth_id")))
    found = rows.groupBy("entity_id").agg(F.count("answer").alias("found"))
    mode = batch.mode_answer(rows.withColumn("at", F.lit(None).cast("int")), "entity_id", "answer", "run", "at").select("entity_id", "answer")
    return agreed.join(found, "entity_id").join(mode, "entity_id", "left").select("entity_id", "runs", "found", "identical", "n_correct", "answer")
