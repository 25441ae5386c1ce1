"""Scoring of candidates: by cosine, or by a judge's answer parsed from JSON."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.numbers import cosine, sigmoid, unit_score
from termweave.functions.text import fill_template, strip_fence

RANKINGS = "rankings array<struct<concept_id:string,reasoning:string,score:double>>"
VERDICT = "is_valid boolean, reasoning string"
UNRANKED = 999
MODES = ("llm", "llm_with_score", "semantic")
PROMPT = """Entity: {entity}
Candidates: {candidates}
Score each candidate from 0 to 5 by how well it names the entity.
Answer as JSON: {"rankings": [{"concept_id": "", "reasoning": "", "score": 0}]}"""


def semantic_scores(candidates: DataFrame, entity_vector: Column, concept_vector: Column) -> DataFrame:
    """similarity in 0..1, 0 where a vector is missing; final_score is the same."""
    similarity = F.coalesce(unit_score(cosine(entity_vector, concept_vector)), F.lit(0.0))
    return candidates.withColumn("similarity", similarity).withColumn("final_score", F.col("similarity")).withColumn("score_normalized", sigmoid(F.col("score")) if "score" in candidates.columns else F.lit(None).cast("double"))


def ranked(df: DataFrame, keys: list[str], score: Column, *ties: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), *ties)))


def prompts(candidates: DataFrame, template: str = PROMPT, with_score: bool = False) -> DataFrame:
    """entity_id and prompt, with the entity's candidates as JSON in their order (seq).

    A candidate that was mapped carries the name it was mapped from, and with
    ``with_score`` each carries its similarity.
    """
    told = [F.col(c) for c in ("concept_id", "concept_name", "domain_id", "vocabulary_id")]
    if "from_name" in candidates.columns:
        told.append(F.col("from_name").alias("original_concept"))
    if with_score:
        told.append(F.round("similarity", 4).alias("semantic_similarity"))
    row = F.struct("seq", F.struct(*told).alias("c"))
    listed = candidates.groupBy("entity_id", "entity_name").agg(F.array_sort(F.collect_list(row)).alias("list"))
    as_json = F.to_json(F.transform("list", lambda x: x["c"]))
    return listed.select("entity_id", fill_template(template, entity=F.col("entity_name"), candidates=as_json).alias("prompt"))


def judged(prompts: DataFrame, judge: Callable[[str], str]) -> DataFrame:
    """entity_id and answer of each prompt. ``judge`` runs on the executors; one that fails gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for prompt in batch["prompt"]:
                try:
                    answers.append(judge(prompt))
                except Exception:  # an answer that is missing is a failed judgement, not a failed job
                    answers.append(None)
            yield pd.DataFrame({"entity_id": batch["entity_id"], "answer": answers})

    return prompts.select("entity_id", "prompt").mapInPandas(run, f"entity_id {dict(prompts.dtypes)['entity_id']}, answer string")


def asked(prompts: DataFrame, judge: Callable[[str], str | tuple[str, str]]) -> DataFrame:
    """entity_id, answer, usage, latency_ms, error of each prompt, for a log of the calls.

    ``judge`` gives an answer, or an answer and its usage as JSON. Of one that fails the error's
    text is kept. Write the result before it is used twice, or the judge is asked twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                began, answer, usage, error = time.perf_counter(), None, None, None
                try:
                    found = judge(prompt)
                    answer, usage = found if isinstance(found, tuple) else (found, None)
                except Exception as e:  # a failed call is a record, not a failed job
                    error = f"{type(e).__name__}: {e}"
                rows.append((answer, usage, 1000 * (time.perf_counter() - began), error))
            yield pd.DataFrame(rows, columns=["answer", "usage", "latency_ms", "error"]).assign(entity_id=batch["entity_id"].to_numpy())[["entity_id", "answer", "usage", "latency_ms", "error"]]

    return prompts.select("entity_id", "prompt").mapInPandas(run, f"entity_id {dict(prompts.dtypes)['entity_id']}, answer string, usage string, latency_ms double, error string")


def parse_rankings(answers: DataFrame, key: str = "entity_id", answer: str = "answer") -> DataFrame:
    """A row for each ranking: key, concept_id, reasoning, llm_score, llm_rank. Malformed answers give none.

    The best score ranks first, the earlier entry among equals; of repeated ids the
    last entry counts.
    """
    rows = answers.select(key, F.from_json(strip_fence(F.col(answer)), RANKINGS).alias("a")).select(key, F.posexplode("a.rankings").alias("pos", "r"))
    rows = rows.select(key, "pos", F.col("r.concept_id").alias("concept_id"), F.col("r.reasoning").alias("reasoning"), F.coalesce("r.score", F.lit(0.0)).alias("llm_score"))
    rows = ranked(rows, [key], F.col("llm_score"), F.col("pos"), name="llm_rank")
    last = Window.partitionBy(key, "concept_id").orderBy(F.desc("pos"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "pos")


def backfilled(candidates: DataFrame, rankings: DataFrame, key: str = "entity_id") -> DataFrame:
    """Candidates with their ranking; one that the judge left out (left_out) scores 0 and ranks ``UNRANKED``, which a long ranking may reach too."""
    joined = candidates.join(rankings, [key, "concept_id"], "left").withColumn("left_out", F.col("llm_rank").isNull())
    return joined.withColumn("llm_score", F.coalesce("llm_score", F.lit(0.0))).withColumn("llm_rank", F.coalesce("llm_rank", F.lit(UNRANKED)))


def score(candidates: DataFrame, mode: str, judge: Callable[[str], str] | None = None) -> DataFrame:
    """``candidates`` (entity_id, entity_name, concept columns, seq, score, entity_vector, concept_vector) with final_score and rank."""
    if mode not in MODES:
        raise ValueError(f"unknown scoring mode {mode!r}; one of {', '.join(MODES)}")
    scored = semantic_scores(candidates, F.col("entity_vector"), F.col("concept_vector"))
    if mode != "semantic":
        if judge is None:
            raise ValueError(f"mode {mode!r} needs a judge")
        # The similarity is something the judge is told; the score is the judge's in either mode.
        scored = backfilled(scored, parse_rankings(judged(prompts(scored, with_score=mode == "llm_with_score"), judge)))
        scored = scored.withColumn("final_score", F.col("llm_score"))
    return ranked(scored, ["entity_id"], F.col("final_score"), F.col("seq"))


def verdict(answer: Column) -> tuple[Column, Column]:
    """(is_valid, reasoning) of a validation answer; malformed text isn't valid."""
    parsed = F.from_json(strip_fence(answer), VERDICT)
    return F.coalesce(parsed["is_valid"], F.lit(False)), parsed["reasoning"]
