"""Standardisation, scoring, validation and result queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.functions.numbers import confidence
from termweave.operators import mapping, score, standardize
from termweave.operators.batch import cell_text
from termweave.plans.tables import CONCEPT, EDGE, concept, edge_rows, query, r6, table

STD = "('S', 'C')"
NEAR = """near_{n} AS (SELECT from_id, r.concept_id, relation, concept_name, standard_concept FROM (
  SELECT *, row_number() OVER (PARTITION BY from_id, concept_id ORDER BY relation) AS once FROM (
    SELECT concept_id_1 AS from_id, concept_id_2 AS concept_id, relationship_id AS relation, row_number() OVER (PARTITION BY concept_id_1 ORDER BY concept_id_2, relationship_id) AS n FROM edge WHERE relationship_id {rel}) WHERE n <= {most}) r JOIN concept USING (concept_id) WHERE once = 1)"""
RELATED = NEAR.format(n="rel", rel="IN ('Is a', 'Marketed form of')", most=50)
MAPPED = NEAR.format(n="map", rel="= 'Maps to'", most=10)


@query(f"WITH {CONCEPT}, {EDGE}, {RELATED} SELECT from_id, concept_id, relation, concept_name FROM near_rel")
def relation_expand(spark, d):
    return standardize.related(concept(spark, d), edge_rows(spark, d), concept(spark, d)).select("from_id", "concept_id", "relation", "concept_name")


@query(f"WITH {CONCEPT}, {EDGE}, {MAPPED} SELECT from_id, concept_id, concept_name, standard_concept FROM near_map WHERE standard_concept IN {STD}")
def maps_to_standard(spark, d):
    return standardize.mapped(concept(spark, d), edge_rows(spark, d), concept(spark, d)).select("from_id", "concept_id", "concept_name", "standard_concept")


def _round(src: str, out: str) -> str:
    pad = lambda c: f"rpad({c}, 12, ' ')"
    return f"""{out}_all AS (SELECT entity_id, seq, concept_id, concept_name, standard_concept, from_name, 'original' AS relation, score, '' AS via FROM {src}
  UNION ALL SELECT s.entity_id, s.seq, r.concept_id, r.concept_name, r.standard_concept, s.concept_name, r.relation, 0.0, r.concept_id FROM {src} s JOIN near_rel r ON s.concept_id = r.from_id),
{out}_led AS (SELECT entity_id, seq || '/' || {pad("via")} || '/' || {pad("''")} AS seq, concept_id, concept_name, standard_concept, from_name, relation, score FROM {out}_all WHERE standard_concept IN {STD}
  UNION ALL SELECT a.entity_id, a.seq || '/' || {pad("via")} || '/' || {pad("m.concept_id")}, m.concept_id, m.concept_name, m.standard_concept, a.concept_name, 'Maps to', 0.0 FROM {out}_all a JOIN near_map m ON a.concept_id = m.from_id
    WHERE (a.standard_concept IS NULL OR a.standard_concept NOT IN {STD}) AND m.standard_concept IN {STD}),
{out} AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, concept_id, concept_name ORDER BY score DESC, seq) AS n FROM {out}_led) WHERE n = 1)"""


@query(f"""
WITH {CONCEPT}, {EDGE}, {RELATED}, {MAPPED}, seed AS (SELECT p_brand AS entity_id, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS seq, CAST(p_partkey AS VARCHAR) AS concept_id, p_name AS concept_name,
  CASE p_partkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'C' END AS standard_concept, CAST(NULL AS VARCHAR) AS from_name, p_retailprice AS score FROM part WHERE p_size = 1),
{_round("seed", "r1")}, {_round("r1", "r2")}
SELECT entity_id, concept_id, relation, from_name, score FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, concept_id, concept_name ORDER BY score DESC, seq) AS n FROM (
  SELECT * REPLACE ('1/' || seq AS seq) FROM r1 UNION ALL SELECT * REPLACE ('2/' || seq AS seq) FROM r2)) WHERE n = 1""")
def standardize_two_rounds(spark, d):
    """Each brand is an entity whose candidates are its parts of size 1."""
    k = F.col("p_partkey")
    seed = table(spark, d, "part").where("p_size = 1").select(
        F.col("p_brand").alias("entity_id"), F.lpad(k.cast("string"), 9, "0").alias("seq"), k.cast("string").alias("concept_id"), F.col("p_name").alias("concept_name"),
        F.when(k % 3 == 0, "S").when(k % 3 == 1, "C").alias("standard_concept"), F.lit(None).cast("string").alias("from_name"), F.col("p_retailprice").alias("score"),
    )
    return standardize.two_rounds(seed, edge_rows(spark, d), concept(spark, d)).select("entity_id", "concept_id", "relation", "from_name", "score")


@query("""
WITH r AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, floor(value) AS v FROM events WHERE event_id % 7 <> 0)
SELECT event_id, CAST(user_id AS VARCHAR) AS concept_id, k AS llm_score, CASE WHEN k >= v THEN 1 ELSE 2 END AS llm_rank FROM r
UNION ALL SELECT event_id, 'other', v, CASE WHEN k >= v THEN 2 ELSE 1 END FROM r""")
def llm_response_parse(spark, d):
    """Fenced answers with two rankings each; every seventh is malformed."""
    k, v = F.get_json_object("props", "$.k"), F.floor("value").cast("string")
    body = F.concat(F.lit('```json\n{"rankings": [{"concept_id": "'), F.col("user_id").cast("string"), F.lit('", "reasoning": "a", "score": '), k, F.lit('}, {"concept_id": "other", "score": '), v, F.lit("}]}\n```"))
    answers = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "no json").otherwise(body).alias("answer"))
    return score.parse_rankings(answers, "event_id").select("event_id", "concept_id", "llm_score", "llm_rank")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN false ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 END AS is_valid, CASE WHEN event_id % 5 <> 0 THEN event_type END AS reasoning FROM events")
def code_fence_json(spark, d):
    ok = F.when(F.get_json_object("props", "$.k").cast("bigint") > 50, "true").otherwise("false")
    body = F.concat(F.lit('```\n{"is_valid": '), ok, F.lit(', "reasoning": "'), "event_type", F.lit('"}\n```'))
    valid, why = score.verdict(F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(body))
    return table(spark, d, "events").select("event_id", valid.alias("is_valid"), why.alias("reasoning"))


@query("""
SELECT l_returnflag, CASE WHEN 1 - l_discount * 6 >= 0.95 THEN 'very_high' WHEN 1 - l_discount * 6 >= 0.85 THEN 'high' WHEN 1 - l_discount * 6 >= 0.70 THEN 'medium' WHEN 1 - l_discount * 6 >= 0.50 THEN 'low' ELSE 'very_low' END AS confidence,
  CASE WHEN l_linenumber % 2 = 0 THEN 'direct_standard' ELSE 'non_standard_to_standard' END AS method, count(*) AS n FROM lineitem GROUP BY ALL""")
def confidence_bands(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", confidence(F.lit(1) - F.col("l_discount") * 6).alias("confidence"), mapping.method(F.col("l_linenumber") % 2 == 0).alias("method"))
    return rows.groupBy("l_returnflag", "confidence", "method").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_partkey AS best, p_retailprice AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1")
def best_domain_per_entity(spark, d):
    return mapping.best_of(table(spark, d, "part"), "p_brand", F.col("p_retailprice"), F.col("p_partkey"), F.col("p_partkey"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part)
SELECT p_type, max(CASE WHEN n = 1 THEN p_partkey END) AS best, string_agg(CASE WHEN n BETWEEN 2 AND 4 THEN CAST(p_partkey AS VARCHAR) END, ',' ORDER BY n) AS alternatives FROM r WHERE n <= 4 GROUP BY p_type""")
def top1_with_alternatives(spark, d):
    ranked = score.ranked(table(spark, d, "part"), ["p_type"], F.col("p_retailprice"), F.col("p_partkey"))
    out = mapping.best_with_alternatives(ranked, ["p_type"], "rank", "p_partkey")
    return out.select("p_type", "best", F.array_join(F.transform("alternatives", lambda x: x.cast("string")), ",").alias("alternatives"))


RANKED = "r AS (SELECT user_id, event_id, event_type = 'click' AS valid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events)"


def _ranked(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_type") == "click").alias("valid"))
    return score.ranked(rows, ["user_id"], F.col("value"), F.col("event_id"))


@query(f"WITH {RANKED} SELECT user_id, min(CASE WHEN valid THEN rank END) AS valid_rank FROM r WHERE rank <= 3 GROUP BY user_id")
def first_valid_of_top3(spark, d):
    return mapping.first_valid(_ranked(spark, d), "user_id", F.col("rank"), F.col("valid"))


@query(f"WITH {RANKED}, v AS (SELECT user_id, min(CASE WHEN valid THEN rank END) AS chosen FROM r WHERE rank <= 3 GROUP BY user_id) SELECT user_id, event_id, rank, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(rank = chosen, false) DESC, rank) AS INTEGER) AS final_rank FROM r JOIN v USING (user_id)")
def validated_first(spark, d):
    ranked = _ranked(spark, d)
    chosen = mapping.first_valid(ranked, "user_id", F.col("rank"), F.col("valid")).withColumnRenamed("valid_rank", "chosen")
    return mapping.valid_first(ranked.join(chosen, "user_id"), "user_id", "rank", "chosen").select("user_id", "event_id", "rank", "final_rank")


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n, count(CASE WHEN p_size > 20 THEN 1 END) AS n2, count(CASE WHEN p_size > 40 THEN 1 END) AS n3 FROM part GROUP BY ALL)
SELECT p_brand, p_type, n3 * 10000 + n2 * 100 + n AS weight FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n3 * 10000 + n2 * 100 + n DESC, p_type) AS r FROM c) WHERE r = 1""")
def domain_most_candidates(spark, d):
    counts = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 20).alias("n2"), F.count_if(F.col("p_size") > 40).alias("n3"))
    return mapping.fullest_domain(counts, "p_brand", "p_type", F.col("n"), F.col("n2"), F.col("n3")).select("p_brand", "p_type", "weight")


@query("SELECT p_type, string_agg(p_name || ' (' || p_partkey || ')', chr(10) || chr(10) ORDER BY p_retailprice DESC, p_partkey) AS cell FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 15 GROUP BY p_type")
def candidate_cell_text(spark, d):
    line = F.concat("p_name", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")"))
    return cell_text(table(spark, d, "part"), ["p_type"], F.col("p_retailprice"), line, 15, F.col("p_partkey"))


@query("SELECT doc_id, coalesce(CAST(quality AS DOUBLE), 0.0) AS llm_score, CASE WHEN quality IS NULL THEN 999 ELSE toxic + 1 END AS llm_rank FROM documents LEFT JOIN labels USING (doc_id)")
def scores_left_backfill(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("concept_id"), F.lit("e").alias("entity_id"))
    known = table(spark, d, "labels").select(F.lit("e").alias("entity_id"), F.col("doc_id").alias("concept_id"), F.col("quality").cast("double").alias("llm_score"), (F.col("toxic") + 1).alias("llm_rank"))
    return score.backfilled(docs, known).select(F.col("concept_id").alias("doc_id"), "llm_score", "llm_rank")


@query("""
SELECT entity, domain_id, CASE WHEN domain_id = 'Drug' THEN 'stage1_no_candidates' WHEN entity % 3 = 0 THEN 'stage2_no_candidates' WHEN entity % 3 = 1 THEN 'stage3_scoring_failed' END AS failure
FROM (SELECT DISTINCT user_id AS entity FROM events), (SELECT unnest(['Drug', 'Observation', 'Procedure', 'Condition', 'Measurement', 'Device']) AS domain_id)
WHERE entity % 2 = 0 UNION ALL SELECT entity, 'Device', CASE WHEN entity % 3 = 0 THEN 'stage2_no_candidates' WHEN entity % 3 = 1 THEN 'stage3_scoring_failed' END FROM (SELECT DISTINCT user_id AS entity FROM events) WHERE entity % 2 <> 0""")
def domain_fan_out(spark, d):
    asked = table(spark, d, "events").select(F.col("user_id").alias("entity")).distinct().withColumn("domain_id", F.when(F.col("entity") % 2 != 0, "Device"))
    e = F.col("entity") % 3
    reason = mapping.failure_reason((F.col("domain_id") != "Drug").cast("int"), (e != 0).cast("int"), (e != 1).cast("int"), F.lit(True))
    return mapping.fan_out(asked).withColumn("failure", reason)


def fixed_judge(prompt: str) -> str:
    """Scores a candidate by its id, higher if the prompt tells of a similarity; leaves out every fifth id."""
    import json

    listed = next(line for line in prompt.splitlines() if line.startswith("Candidates: "))
    scores = [(c["concept_id"], int(c["concept_id"]) % 4 + (c["semantic_similarity"] > 0.8)) for c in json.loads(listed[len("Candidates: ") :])]
    return json.dumps({"rankings": [{"concept_id": i, "reasoning": "", "score": s} for i, s in scores if int(i) % 5]})


@query(f"""
WITH {CONCEPT}, p AS (
  SELECT p_brand AS entity_id, CAST(p_partkey AS VARCHAR) AS concept_id, p_partkey AS k, (1 + (p_partkey % 3) / sqrt(1 + (p_partkey % 3) ** 2)) / 2 AS similarity FROM part WHERE p_size <= 5),
s AS (SELECT *, CASE WHEN k % 5 = 0 THEN 0.0 ELSE k % 4 + CASE WHEN round(similarity, 4) > 0.8 THEN 1 ELSE 0 END END AS final_score FROM p)
SELECT entity_id, concept_id, CAST(final_score AS DOUBLE) AS final_score, round(similarity, 6) AS similarity, k % 5 = 0 AS left_out,
  CAST(row_number() OVER (PARTITION BY entity_id ORDER BY final_score DESC, k) AS INTEGER) AS rank FROM s""")
def judge_with_score(spark, d):
    """Candidates scored by a judge that is told their similarity; the final score is the judge's alone."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").where("p_size <= 5").select(
        F.col("p_brand").alias("entity_id"), F.col("p_brand").alias("entity_name"), k.cast("string").alias("concept_id"), F.col("p_name").alias("concept_name"), F.col("p_type").alias("domain_id"),
        F.lit("v").alias("vocabulary_id"), k.alias("seq"), F.array(F.lit(1.0), F.lit(0.0)).alias("entity_vector"), F.array((k % 3).cast("double"), F.lit(1.0)).alias("concept_vector"),
    )
    found = score.score(rows, "llm_with_score", fixed_judge)
    return found.select("entity_id", "concept_id", "final_score", r6(F.col("similarity")).alias("similarity"), "left_out", "rank")
