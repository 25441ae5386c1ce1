"""Queries of whole mapping runs, from names to summary."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import functions as F

from termweave.plans.mapping import Vocabulary, map_runs, run_summary
from termweave.plans.retrieval import BM25, EXACT, LEXICAL, PHRASE, TOP3
from termweave.plans.tables import query, table

DOMAINS = ("en", "de", "fr", "es")


def judge(prompt: str) -> str:
    """A fixed judge: a candidate's score is the first digit of its id's md5, modulo 6."""
    ids = re.findall(r'"concept_id":"([^"]*)"', prompt)
    return json.dumps({"rankings": [{"concept_id": i, "score": int(hashlib.md5(i.encode()).hexdigest()[0], 16) % 6} for i in ids]})


#: Every item in its domain, or in each; documents are concepts, a fifth of them not standard and mapped to the next.
_ASKED = BM25.replace(
    "e AS (SELECT item_id, trim(", "g AS (SELECT unnest(range(1, 5)) AS place, unnest(['en', 'de', 'fr', 'es']) AS lang), e AS (SELECT item_id * 10 + place AS item_id, trim("
).replace("CASE WHEN item_id % 2 = 0 THEN 'en' END AS domain", "lang AS domain").replace("AS w FROM benchmark)", "AS w FROM benchmark JOIN g ON item_id % 2 = 1 OR lang = 'en')")
RUN = f"""WITH {_ASKED}, {EXACT}, {PHRASE}, {LEXICAL}, h AS ({TOP3.format(src="t")}),
two AS (SELECT item_id, CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 ELSE doc_id END AS doc_id, doc_id % 5 = 0 AS led, rank FROM h WHERE score >= 3 AND (doc_id % 5 <> 0 OR doc_id + 1 IN (SELECT doc_id FROM documents))),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY led, rank) AS n FROM two) WHERE n = 1),
r AS (SELECT *, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) AS BIGINT) % 6 AS DOUBLE) AS final FROM one),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, rank) AS place FROM r),
o AS (SELECT item_id, min(CASE WHEN place = 1 THEN doc_id END) AS doc_id, min(CASE WHEN place = 1 THEN final END) AS final, bool_or(place = 1 AND led) AS led, string_agg(CASE WHEN place > 1 AND place <= 4 THEN doc_id END, ',' ORDER BY place) AS others FROM k GROUP BY item_id),
p AS (SELECT e.item_id, e.item_id // 10 AS entity, domain, doc_id, final, led, others, CASE WHEN e.item_id NOT IN (SELECT item_id FROM h WHERE score >= 3) THEN 'stage1_no_candidates' WHEN doc_id IS NULL THEN 'stage2_no_candidates' END AS why FROM e LEFT JOIN o USING (item_id)),
b AS (SELECT entity, arg_min(item_id, (-final, item_id)) AS item_id FROM p WHERE doc_id IS NOT NULL GROUP BY entity)"""


def _results(spark, d, runs):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), F.col("text").alias("entity_name"), F.when(F.col("item_id") % 2 == 0, "en").alias("domain_id"))
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    names = docs.select(k.cast("string").alias("doc_id"), k.cast("string").alias("concept_id"), F.col("text").alias("concept_name"), F.lit("Original").alias("name_type"), F.col("lang").alias("domain_id"), F.lit("V").alias("vocabulary_id"), F.when(k % 5 != 0, "S").alias("standard_concept"))
    edges = docs.where(k % 5 == 0).select(k.cast("string").alias("concept_id_1"), (k + 1).cast("string").alias("concept_id_2"), F.lit("Maps to").alias("relationship_id"))
    return map_runs(items, Vocabulary(names, edges), runs, "llm", judge, domains=DOMAINS)


@query(f"""{RUN}
SELECT run, CAST(entity AS VARCHAR) AS entity_id, domain AS domain_id, CAST(doc_id AS VARCHAR) AS concept_id, final AS final_score, CASE WHEN final >= 0.95 THEN 'very_high' WHEN final >= 0 THEN 'very_low' END AS confidence,
  CASE WHEN led THEN 'non_standard_to_standard' WHEN doc_id IS NOT NULL THEN 'direct_standard' END AS method, CASE WHEN doc_id IS NOT NULL THEN coalesce(others, '') END AS alternatives, item_id IN (SELECT item_id FROM b) AS is_best, why AS failure_reason FROM p, (SELECT unnest([1, 2]) AS run)""")
def map_entities_run(spark, d):
    """Two runs of the whole mapping of the benchmark's items to documents: retrieval, standardisation, judge, choice among domains."""
    found = _results(spark, d, 2)
    return found.select("run", "entity_id", "domain_id", "concept_id", "final_score", "confidence", "method", F.array_join("alternatives", ",").alias("alternatives"), "is_best", "failure_reason")


@query(f"""{RUN}
SELECT CAST(i.item_id AS VARCHAR) AS entity_id, 3 AS runs, CASE WHEN p.doc_id IS NULL THEN 0 ELSE 3 END AS found, true AS identical, CASE WHEN p.doc_id = i.item_id THEN 3 ELSE 0 END AS n_correct, CAST(p.doc_id AS VARCHAR) AS answer
FROM benchmark i LEFT JOIN b ON b.entity = i.item_id LEFT JOIN p ON p.item_id = b.item_id""")
def map_run_summary(spark, d):
    """Agreement and correctness of three runs; the truth of an item is the document of its number."""
    truth = table(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), F.col("item_id").alias("truth_id"))
    return run_summary(_results(spark, d, 3), truth)
