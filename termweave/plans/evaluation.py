"""Batch, evaluation, reshaping, metric and ingest queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from termweave.operators import batch, bootstrap, evaluate, metrics, report
from termweave.operators.dedup import first_by
from termweave.operators.score import ranked
from termweave.plans.tables import CALLS, RUNS, calls, query, r6, runs, table


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 5")
def stratified_sample(spark, d):
    return batch.stratified(table(spark, d, "documents"), "lang", 5, F.col("n_chars").desc(), F.col("doc_id").asc()).select("lang", "doc_id", "n_chars")


@query("SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '/42'), doc_id LIMIT 50")
def hash_sample(spark, d):
    return batch.hash_sample(table(spark, d, "documents"), "doc_id", 50).select("doc_id", "lang")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 100 OFFSET 50")
def paged_scan(spark, d):
    return batch.page(table(spark, d, "part").select("p_partkey", "p_name"), 50, 100, F.col("p_name").asc(), F.col("p_partkey").asc())


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_partkey DESC, l_orderkey, l_linenumber LIMIT 500 OFFSET (SELECT count(*) // 2 FROM lineitem)")
def deep_page(spark, d):
    """A page from the middle of the table, read from the ranges that hold it."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return batch.page(rows, rows.count() // 2, 500, F.col("l_partkey").desc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc(), near=500)


@query("SELECT quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95, min(l_extendedprice) AS p0, l_returnflag FROM lineitem GROUP BY l_returnflag")
def exact_percentiles(spark, d):
    return metrics.percentiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p0": 0.0})


@query("SELECT p_type, p_partkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def ranked_results(spark, d):
    return ranked(table(spark, d, "part"), ["p_type"], F.col("p_retailprice"), F.col("p_partkey")).where("rank <= 3").select("p_type", "p_partkey", "rank")


@query(f"WITH {RUNS} SELECT entity, count(*) AS runs, count(DISTINCT coalesce(answer, '')) = 1 AS identical, count(CASE WHEN answer = 'click' THEN 1 END) AS n_correct FROM runs GROUP BY entity")
def run_agreement(spark, d):
    return batch.agreement(runs(spark, d), "entity", "answer", F.col("answer") == "click")


NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY run_seq) AS run FROM runs)"


def _numbered(spark, d, most):
    return ranked(runs(spark, d), ["entity"], -F.col("run_seq"), name="run").where(F.col("run") <= most)


@query(f"WITH {RUNS}, {NUMBERED} SELECT entity, " + ", ".join(f"max(CASE WHEN run = {i} THEN coalesce(answer || '(' || run_seq || ')', 'N/A') END) AS run{i}" for i in range(1, 6)) + " FROM n WHERE run <= 5 GROUP BY entity")
def run_pivot(spark, d):
    cell = F.coalesce(F.concat("answer", F.lit("("), F.col("run_seq").cast("string"), F.lit(")")), F.lit("N/A"))
    return batch.pivot_runs(_numbered(spark, d, 5), ["entity"], "run", cell, 5)


@query(f"WITH {RUNS}, {NUMBERED}, c AS (SELECT entity, r.run, coalesce(x.score, f.score) AS score FROM (SELECT DISTINCT entity FROM runs) e CROSS JOIN (SELECT unnest(range(1, 21)) AS run) r LEFT JOIN (SELECT * FROM n WHERE run <= 20 AND run % 3 <> 0) x USING (entity, run) LEFT JOIN (SELECT entity, max(score) AS score FROM runs GROUP BY entity) f USING (entity)) SELECT entity, " + ", ".join(f"max(CASE WHEN run = {i} THEN score END) AS run{i}" for i in range(1, 21)) + " FROM c GROUP BY entity")
def run_score_grid(spark, d):
    numbered = _numbered(spark, d, 20)
    fallback = runs(spark, d).groupBy("entity").agg(F.max("score").alias("score"))
    cells = evaluate.grid(runs(spark, d), 20, numbered.where("run % 3 <> 0").select("entity", "run", "score"), fallback)
    return batch.pivot_runs(cells, ["entity"], "run", F.col("score"), 20)


@query(f"WITH {RUNS}, p AS (SELECT entity, answer, count(*) AS run_count, min(run_seq) AS first, arg_max(score, run_seq) AS score FROM runs WHERE answer IS NOT NULL GROUP BY ALL) SELECT entity, answer, run_count, score FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY run_count DESC, first) AS n FROM p) WHERE n = 1")
def mode_answer(spark, d):
    return batch.mode_answer(runs(spark, d), "entity", "answer", "run_seq", "score")


HALF = "s AS (SELECT *, CASE WHEN run_seq % 9 = 0 THEN NULL ELSE CAST(run_seq % 3 AS DOUBLE) END AS s FROM runs)"


def _scored(spark, d):
    k = F.col("run_seq")
    return runs(spark, d).withColumn("s", F.when(k % 9 != 0, (k % 3).cast("double")))


@query(f"WITH {RUNS}, {HALF} SELECT answer, round(100 * avg(CASE WHEN s IS NOT NULL THEN CASE WHEN s = 2 THEN 1.0 ELSE 0 END END), 6) AS acc2, CASE WHEN answer = 'click' THEN round(100 * avg(CASE WHEN s IS NOT NULL THEN CASE WHEN s >= 1 THEN 1.0 ELSE 0 END END), 6) END AS acc21, round(avg(s / 2) * 100, 6) AS wavg FROM s GROUP BY answer")
def run_level_accuracy(spark, d):
    out = evaluate.run_accuracy(_scored(spark, d), ["answer"], F.col("s"), F.col("answer") == "click")
    return out.select("answer", *(r6(c).alias(c) for c in ("acc2", "acc21", "wavg")))


@query(f"WITH {RUNS}, {HALF} SELECT round(avg(w), 6) AS macro FROM (SELECT answer, avg(s / 2) * 100 AS w FROM s GROUP BY answer)")
def concept_level_average(spark, d):
    return evaluate.macro_average(evaluate.concept_average(_scored(spark, d), "answer", F.col("s"))).select(r6("macro").alias("macro"))


POOLS = "p AS (SELECT entity, list_sort(list(DISTINCT run_seq % 50) FILTER (WHERE answer = 'click')) AS clicked, list_sort(list(DISTINCT run_seq % 50) FILTER (WHERE answer IN ('click', 'view'))) AS seen, list_sort(list(DISTINCT run_seq % 50) FILTER (WHERE score >= 60)) AS gold FROM runs GROUP BY entity)"


def _pools(spark, d):
    rows = runs(spark, d).withColumn("item", F.col("run_seq") % 50)
    return evaluate.pools(rows, "entity", "item", {"clicked": F.col("answer") == "click", "seen": F.col("answer").isin("click", "view"), "gold": F.col("score") >= 60})


@query(f"WITH {RUNS}, {POOLS} SELECT entity, coalesce(array_to_string(clicked, ','), '') AS clicked, coalesce(array_to_string(gold, ','), '') AS gold, coalesce(list_has_any(clicked, gold), false) AS hit FROM p")
def pool_and_gold_sets(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return _pools(spark, d).select("entity", text("clicked"), text("gold"), F.arrays_overlap("clicked", "gold").alias("hit"))


@query(f"WITH {RUNS}, {POOLS} SELECT round(avg(CASE WHEN coalesce(list_has_any(clicked, gold), false) THEN 1.0 ELSE 0 END), 6) AS clicked, round(avg(CASE WHEN coalesce(list_has_any(seen, gold), false) THEN 1.0 ELSE 0 END), 6) AS seen FROM p")
def recall_at_k(spark, d):
    return _pools(spark, d).agg(r6(evaluate.recall_at_k("clicked", "gold")).alias("clicked"), r6(evaluate.recall_at_k("seen", "gold")).alias("seen"))


@query(f"WITH {RUNS} SELECT answer, round(sum(CASE WHEN score >= 50 THEN 1 ELSE 0 END) / sum(CASE WHEN run_seq % 4 <> 0 THEN 1 ELSE 0 END), 6) AS recall FROM runs GROUP BY answer")
def recall_at_1(spark, d):
    hit, cell = (F.col("score") >= 50).cast("int"), (F.col("run_seq") % 4 != 0).cast("int")
    return runs(spark, d).groupBy("answer").agg(r6(evaluate.recall_at_1(hit, cell)).alias("recall"))


@query("SELECT lang, round(count(quality) / count(*), 6) AS coverage, round(avg(CASE WHEN quality IS NOT NULL THEN CASE WHEN quality >= 1 THEN 1.0 ELSE 0 END END), 6) AS recall FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def coverage_recall(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(r6(evaluate.coverage(F.col("quality"))).alias("coverage"), r6(evaluate.recall_covered(F.col("quality"), 1)).alias("recall"))


def _drawn(key: str, src: str) -> str:
    """key, r, w: how often each key of ``src`` is drawn in each of 1000 replicates."""
    draw = f"CAST('0x' || substr(md5('0/' || b || '/' || {key}), CAST(8 * i + 1 AS INTEGER), 8) AS BIGINT)"
    times = " + ".join(f"CASE WHEN u >= {t} THEN 1 ELSE 0 END" for t in bootstrap.THRESHOLDS)
    return f"SELECT {key}, r, {times} AS w FROM (SELECT {key}, 4 * b + i AS r, {draw} AS u FROM (SELECT DISTINCT {key} FROM {src}), range(250) x(b), range(4) y(i))"


_PICK = "list_sort(list(num / den) FILTER (den <> 0)) AS s"
_ENDS = "s[CAST(floor(len(s) * 0.025) AS BIGINT) + 1] AS low, s[CAST(floor(len(s) * 0.975) AS BIGINT)] AS high"


@query(f"WITH k AS (SELECT CAST(doc_id AS VARCHAR) AS key, quality FROM labels), w AS ({_drawn('key', 'k')}), b AS (SELECT r, CAST(sum(quality * w) AS DOUBLE) AS num, sum(w) AS den FROM k JOIN w USING (key) GROUP BY r) SELECT {_ENDS} FROM (SELECT {_PICK} FROM b)")
def bootstrap_ci(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("hits"), F.lit(1).alias("cells"))
    return evaluate.bootstrap(rows, "doc_id", "hits", "cells")


#: Parts as entities: two external scores, two pools, three runs.
ENTITIES = """e AS (SELECT p_brand AS file, p_name AS name, p_type AS grp, 'd' || p_partkey % 3 AS domain, p_partkey AS seq, CASE WHEN p_partkey % 4 <> 0 THEN p_size % 3 END AS one, CASE WHEN p_partkey % 7 = 0 THEN p_size % 2 + 1 END AS two,
  [p_partkey % 7] AS few, [p_partkey % 7, p_partkey % 5, 9] AS many, CASE WHEN p_size % 2 = 0 THEN [p_size % 7] ELSE [] END AS gold_e, [p_size % 7, p_size % 5] AS gold_a, [CASE WHEN p_size % 5 <> 0 THEN p_size % 3 END, p_size % 2, NULL] AS runs FROM part)"""
_RATIOS = {
    f"{m}/{k}_{x}": (n, c)
    for x, least in (("E", 2), ("A", 1))
    for m, k, n, c in (
        ("one", "r1", f"CASE WHEN one >= {least} THEN 1 ELSE 0 END", "CASE WHEN one IS NULL THEN 0 ELSE 1 END"), ("two", "r1", f"CASE WHEN two >= {least} THEN 1 ELSE 0 END", "CASE WHEN two IS NULL THEN 0 ELSE 1 END"),
        ("few", "rk", f"CASE WHEN list_has_any(few, gold_{x}) THEN 1 ELSE 0 END", "1"), ("many", "rk", f"CASE WHEN list_has_any(many, gold_{x}) THEN 1 ELSE 0 END", "1"),
        ("many", "r1", f"len(list_filter(runs, lambda s: s >= {least}))", "len(list_filter(runs, lambda s: s IS NOT NULL))"),
    )
}


@query(f"""
WITH {ENTITIES}, f AS (SELECT *, file || '/' || name || '/' || domain AS key, row_number() OVER (PARTITION BY file, name ORDER BY seq) = 1 AS first FROM e),
l AS (SELECT *, 'All' AS level FROM f WHERE first UNION ALL SELECT *, grp FROM f WHERE first UNION ALL SELECT *, grp || '-' || domain FROM f), w AS ({_drawn("key", "f")} UNION ALL SELECT DISTINCT key, -1, 1 FROM f),
m AS (SELECT level, key, {", ".join(f"sum({n}) AS n{i}, sum({c}) AS c{i}" for i, (n, c) in enumerate(_RATIOS.values()))} FROM l GROUP BY ALL),
b AS (SELECT level, r, {", ".join(f"CAST(sum(n{i} * w) AS DOUBLE) AS n{i}, CAST(sum(c{i} * w) AS DOUBLE) AS c{i}" for i in range(len(_RATIOS)))} FROM m JOIN w USING (key) GROUP BY ALL),
t AS ({" UNION ALL ".join(f"SELECT '{name}' AS ratio, level, r, n{i} AS num, c{i} AS den FROM b" for i, name in enumerate(_RATIOS))}),
s AS (SELECT ratio, level, list_sort(list(num / den) FILTER (den <> 0 AND r >= 0)) AS s, max(CASE WHEN r < 0 AND den <> 0 THEN num / den END) AS point FROM t GROUP BY ALL),
c AS (SELECT level, count(*) AS n, avg(CASE WHEN one IS NULL THEN 0.0 ELSE 1 END) AS one, avg(CASE WHEN two IS NULL THEN 0.0 ELSE 1 END) AS two FROM l GROUP BY level)
SELECT level, split_part(ratio, '/', 1) AS method, split_part(ratio, '/', 2) AS metric, n, CASE split_part(ratio, '/', 1) WHEN 'one' THEN one WHEN 'two' THEN two END AS coverage, point, {_ENDS} FROM s JOIN c USING (level)""")
def performance_table(spark, d):
    """Three levels by four methods, with intervals of 1000 replicates."""
    k, size = F.col("p_partkey"), F.col("p_size")
    none = F.array().cast("array<bigint>")
    entities = table(spark, d, "part").select(
        F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_type").alias("grp"), F.concat(F.lit("d"), (k % 3).cast("string")).alias("domain"), k.alias("seq"), F.when(k % 4 != 0, size % 3).alias("one"),
        F.when(k % 7 == 0, size % 2 + 1).alias("two"), F.array(k % 7).alias("few"), F.array(k % 7, k % 5, F.lit(9).cast("long")).alias("many"), F.when(size % 2 == 0, F.array((size % 7).cast("long"))).otherwise(none).alias("gold_E"),
        F.array((size % 7).cast("long"), (size % 5).cast("long")).alias("gold_A"), F.array(F.when(size % 5 != 0, size % 3), size % 2, F.lit(None).cast("int")).alias("run_scores"),
    )
    return evaluate.performance(entities, ["one", "two"], ["few", "many"], "many")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.score, a.score) AS score FROM (SELECT doc_id, quality AS score FROM labels WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, toxic + 10 AS score FROM labels WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id")
def consensus_merge(spark, d):
    labels = table(spark, d, "labels")
    return evaluate.consensus(labels.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("score")), labels.where("doc_id % 2 = 0").select("doc_id", (F.col("toxic") + 10).alias("score")), ["doc_id"])


OFFSET = """l AS (SELECT p_partkey AS idx, CASE WHEN p_partkey % 5 = 0 THEN 'same' ELSE p_name || p_partkey END AS name FROM part), r AS (SELECT p_partkey + 7 AS idx, CASE WHEN p_partkey % 7 = 0 THEN 'other' ELSE p_name || p_partkey END AS name, p_size FROM part),
o AS (SELECT r.idx - l.idx AS off, count(*) AS n FROM l JOIN r USING (name) WHERE name IN (SELECT name FROM l GROUP BY name HAVING count(*) = 1) AND name IN (SELECT name FROM r GROUP BY name HAVING count(*) = 1) GROUP BY 1 ORDER BY n DESC, off LIMIT 1)"""


@query(f"WITH {OFFSET} SELECT l.idx AS idx, l.name AS name, r.p_size AS p_size FROM l CROSS JOIN o LEFT JOIN r ON l.idx + o.off = r.idx")
def index_offset_join(spark, d):
    k, name = F.col("p_partkey"), F.concat("p_name", F.col("p_partkey").cast("string"))
    part = table(spark, d, "part")
    left = part.select(k.alias("idx"), F.when(k % 5 == 0, "same").otherwise(name).alias("name"))
    right = part.select((k + 7).alias("idx"), F.when(k % 7 == 0, "other").otherwise(name).alias("name"), "p_size")
    return evaluate.join_by_offset(left, right.drop("name"), evaluate.index_offset(left, right, "name", "idx"), "idx").select("idx", "name", "p_size")


@query("WITH l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' (x)' ELSE s_name END AS name FROM supplier), r AS (SELECT s_name AS name, s_nationkey AS v FROM supplier WHERE s_suppkey % 5 <> 0) SELECT l.s_suppkey AS s_suppkey, coalesce(a.v, b.v) AS v FROM l LEFT JOIN r a ON l.name = a.name LEFT JOIN r b ON regexp_replace(l.name, ' \\(x\\)$', '') = b.name".replace("\\\\", "\\"))
def alias_join(spark, d):
    s = table(spark, d, "supplier")
    left = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" (x)"))).otherwise(F.col("s_name")).alias("name"))
    return evaluate.join_by_name_or_alias(left, s.where("s_suppkey % 5 <> 0").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("v")), "name", "v").select("s_suppkey", "v")


CASCADE = """q AS (SELECT p_brand AS entity, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END || '(' || p_partkey || ')' AS concept, CAST(p_partkey AS VARCHAR) AS concept_id FROM part),
s AS (SELECT p_brand AS entity, p_name || '(' || p_partkey || ')' AS concept, CAST(p_partkey AS VARCHAR) AS concept_id, p_size AS score FROM part WHERE p_partkey % 4 <> 0 AND (p_brand <> 'Brand#2' OR p_partkey = (SELECT min(p_partkey) FROM part WHERE p_brand = 'Brand#2' AND p_partkey % 4 <> 0)))"""


@query(f"""WITH {CASCADE}, o AS (SELECT entity, min(score) AS s3 FROM s GROUP BY entity HAVING count(*) = 1)
SELECT q.entity AS entity, q.concept AS concept, coalesce(a.score, b.score, s3) AS score, CASE WHEN a.score IS NOT NULL THEN 'exact' WHEN b.score IS NOT NULL THEN 'id' WHEN s3 IS NOT NULL THEN 'only' END AS found
FROM q LEFT JOIN s a ON q.entity = a.entity AND q.concept = a.concept LEFT JOIN s b ON q.entity = b.entity AND q.concept_id = b.concept_id LEFT JOIN o ON q.entity = o.entity""")
def cascade_score_lookup(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    label = lambda name: F.concat(name, F.lit("("), k.cast("string"), F.lit(")")).alias("concept")
    ids = [F.col("p_brand").alias("entity"), k.cast("string").alias("concept_id")]
    asked = part.select(*ids, label(F.when(k % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))))
    few = part.where(k % 4 != 0)
    first = few.where("p_brand = 'Brand#2'").agg(F.min("p_partkey").alias("least"))
    few = few.join(F.broadcast(first)).where((F.col("p_brand") != "Brand#2") | (k == F.col("least")))  # one row
    return evaluate.cascade_scores(asked, few.select(*ids, label(F.col("p_name")), F.col("p_size").alias("score")))


#: Asked pairs and scored ones: names with and without a parenthesis, ids in the concepts' texts, brands with one concept.
LOOKUP = """a AS (SELECT p_partkey AS k, p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' (x)' ELSE '' END AS entity, CASE WHEN p_partkey % 2 = 0 THEN p_name || '(' || p_partkey || ')' ELSE upper(p_name) END AS concept, CAST(p_partkey // 4 AS VARCHAR) AS concept_id FROM part),
s AS (SELECT p_brand || CASE WHEN p_partkey % 5 = 0 THEN ' (x)' ELSE '' END AS entity, p_name || '(' || p_partkey || ')' AS concept, p_size AS score, p_partkey AS seq FROM part WHERE p_partkey % 4 <> 1 AND p_brand NOT IN ('Brand#7', 'Brand#8') OR p_partkey IN (SELECT min(p_partkey) FROM part WHERE p_brand IN ('Brand#7') GROUP BY p_brand)),
n AS (SELECT k, concept, concept_id, unnest(CASE WHEN entity LIKE '% (x)' THEN [0, 1] ELSE [0] END) AS turn, entity FROM a), m AS (SELECT *, CASE WHEN turn = 1 THEN replace(entity, ' (x)', '') ELSE entity END AS name FROM n),
h AS (SELECT k, 2 * turn + CASE WHEN m.concept = s.concept THEN 0 ELSE 1 END AS step, seq, score FROM m JOIN s ON m.name = s.entity WHERE m.concept = s.concept OR contains(s.concept, concept_id)
  UNION ALL SELECT k, 4 + turn, 0, score FROM m JOIN (SELECT entity, min(score) AS score FROM s GROUP BY entity HAVING count(*) = 1) o ON m.name = o.entity),
z AS (SELECT k, arg_min(score, (step, seq)) AS score, min(step) AS step FROM h GROUP BY k)"""


def _lookup(spark, d):
    k, part = F.col("p_partkey"), table(spark, d, "part")
    label = F.concat("p_name", F.lit("("), k.cast("string"), F.lit(")"))
    named = lambda every: F.concat("p_brand", F.when(k % every == 0, " (x)").otherwise(""))
    asked = part.select(k.alias("k"), named(3).alias("entity"), F.when(k % 2 == 0, label).otherwise(F.upper("p_name")).alias("concept"), F.floor(k / 4).cast("string").alias("concept_id"))
    one = part.where("p_brand = 'Brand#7'").agg(F.min("p_partkey").alias("least"))
    kept = part.join(F.broadcast(one)).where(((k % 4 != 1) & ~F.col("p_brand").isin("Brand#7", "Brand#8")) | (k == F.col("least")))  # one row
    return asked, kept.select(named(5).alias("entity"), label.alias("concept"), F.col("p_size").alias("score"), k.alias("seq"))


@query(f"WITH {LOOKUP} SELECT k, score, ['exact', 'id', 'alias exact', 'alias id', 'only', 'alias only'][step + 1] AS found FROM a LEFT JOIN z USING (k)")
def score_lookup_alias(spark, d):
    """Scores by concept, by id in the concept's text and of a single concept, each under name and alias."""
    return evaluate.lookup_scores(*_lookup(spark, d)).select("k", "score", "found")


@query(f"""WITH {LOOKUP} SELECT entity, k AS run, CASE WHEN k % 6 = 0 THEN -1 ELSE coalesce(score, CASE WHEN replace(entity, ' (x)', '') NOT IN ('Brand#1', 'Brand#8') THEN -1 END) END AS score FROM a LEFT JOIN z USING (k)""")
def guarded_run_grid(spark, d):
    """Cells of a grid: mapped ones are looked up, others and those without a score fall back, but for two brands that are still open."""
    asked, scored = _lookup(spark, d)
    cells = asked.withColumnRenamed("k", "run").withColumn("mapped", F.col("run") % 6 != 0)
    fallback = asked.select("entity", F.col("k").alias("run"), F.lit(-1).alias("score"))
    open_ = asked.where("entity in ('Brand#1', 'Brand#8')").select("entity")
    return evaluate.guarded_grid(cells, scored, fallback, open_)


@query("""
WITH r AS (SELECT 'Brand#' || o_custkey % 30 || CASE WHEN o_orderkey % 5 = 0 THEN ' (y)' ELSE '' END AS name, 'Brand#' || o_custkey % 30 AS short, CAST(o_orderkey % 7 AS VARCHAR) AS cid, o_orderstatus AS dom, o_orderkey AS seq FROM orders WHERE o_custkey % 30 <> 11 AND (o_custkey % 30 <> 12 OR o_orderkey % 5 = 0)),
k AS (SELECT key, arg_min(name, (turn, seq)) AS name FROM (SELECT name AS key, name, 0 AS turn, seq FROM r UNION ALL SELECT short, name, 1, seq FROM r) GROUP BY key),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, first) AS p FROM (SELECT name, cid, count(*) AS n, min(seq) AS first, arg_max(dom, seq) AS dom FROM r GROUP BY ALL)) WHERE p = 1),
s AS (SELECT 'Brand#' || p_partkey % 30 AS entity, CAST(p_partkey % 7 AS VARCHAR) AS cid, arg_max(p_size % 3, p_partkey) AS score FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 2 = 0 GROUP BY ALL),
b AS (SELECT p_partkey, p_type, p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' (x)' ELSE '' END AS entity, p_brand AS short, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size % 4 AS VARCHAR) END AS oid, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 4 AS VARCHAR) END AS uid, p_size FROM part),
u AS (SELECT entity, min(score) AS alone FROM s GROUP BY entity HAVING count(*) = 1),
j AS (SELECT b.*, m.cid, m.n, m.dom, coalesce(s.score, alone) AS score FROM b LEFT JOIN k k1 ON k1.key = entity LEFT JOIN k k2 ON k2.key = short LEFT JOIN m ON m.name = coalesce(k1.name, k2.name) LEFT JOIN s ON s.entity = replace(m.name, ' (y)', '') AND s.cid = m.cid LEFT JOIN u ON u.entity = replace(m.name, ' (y)', ''))
SELECT p_partkey AS source_id, p_type AS domain_id, entity AS entity_name, CAST(p_size AS VARCHAR) AS gt_concept_id, 'name ' || p_size AS gt_concept_name, cid AS mapomop_concept_id, 'c' || cid AS mapomop_concept_name, dom AS mapomop_domain, n AS mapomop_run_count, score AS mapomop_score,
  oid AS omophub_concept_id, 'o' || oid AS omophub_concept_name, 'D' AS omophub_domain, CAST(0.5 AS DOUBLE) AS omophub_match_score, 2 AS omophub_score, uid AS usagi_concept_id, 'u' || uid AS usagi_concept_name, 'D' AS usagi_domain, CAST(0.25 AS DOUBLE) AS usagi_match_score, 1 AS usagi_score,
  CASE WHEN oid IS NOT NULL AND uid IS NOT NULL THEN CASE WHEN oid = uid THEN 'Same' ELSE 'Different' END END AS is_same_omophub_usagi,
  CASE WHEN (oid IS NULL)::INT + (uid IS NULL)::INT + (cid IS NULL)::INT >= 2 THEN NULL WHEN len(list_distinct(list_filter([oid, uid, cid], lambda x: x IS NOT NULL))) = 1 THEN 'Same' ELSE 'Different' END AS is_same_3models, 5 AS baseline FROM j""")
def baseline_comparison(spark, d):
    """Three systems side by side; the runs' names are found by name and alias, their most frequent answers scored."""
    k, size, part, orders, o = F.col("p_partkey"), F.col("p_size"), table(spark, d, "part"), table(spark, d, "orders"), F.col("o_orderkey")
    text = lambda c: c.cast("string")
    oid, uid = F.when(k % 5 != 0, text(size % 4)), F.when(k % 6 != 0, text(k % 4))
    baseline = part.select(
        k.alias("source_id"), F.col("p_type").alias("domain_id"), F.concat("p_brand", F.when(k % 3 == 0, " (x)").otherwise("")).alias("entity_name"), text(size).alias("gt_concept_id"), F.concat(F.lit("name "), text(size)).alias("gt_concept_name"),
        oid.alias("omophub_concept_id"), F.concat(F.lit("o"), oid).alias("omophub_concept_name"), F.lit("D").alias("omophub_domain"), F.lit(0.5).alias("omophub_match_score"), F.lit(2).alias("omophub_score"),
        uid.alias("usagi_concept_id"), F.concat(F.lit("u"), uid).alias("usagi_concept_name"), F.lit("D").alias("usagi_domain"), F.lit(0.25).alias("usagi_match_score"), F.lit(1).alias("usagi_score"), F.lit(5).alias("baseline"),
    )
    brand = F.col("o_custkey") % 30
    kept = orders.where((brand != 11) & ((brand != 12) | (o % 5 == 0)))
    records = kept.select(F.concat(F.lit("Brand#"), text(brand), F.when(o % 5 == 0, " (y)").otherwise("")).alias("entity_name"), (o % 7).alias("concept_id"), F.concat(F.lit("c"), text(o % 7)).alias("concept_name"), F.col("o_orderstatus").alias("domain"), o.alias("seq"))
    scored = part.where((k % 4 != 0) & (k % 2 == 0)).select(F.concat(F.lit("Brand#"), text(k % 30)).alias("entity"), F.concat(F.lit("c"), text(k % 7), F.lit("("), text(k % 7), F.lit(")")).alias("concept"), (size % 3).alias("score"), k.alias("seq"))
    return evaluate.comparison(baseline, records, scored)


@query("""
SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS concept_id, coalesce(CASE WHEN p_partkey % 9 <> 0 THEN p_name END, '') AS concept_name, p_type AS domain_id, p_brand AS vocabulary_id, '' AS standard_concept,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice END AS final_score, p_partkey % 3 <> 0 AS is_original_standard, 'unknown' AS search_type, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) END AS from_id, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size / 2.0 AS DOUBLE) ELSE p_retailprice END AS first_score FROM part""")
def stage_report_rows(spark, d):
    """Report rows of the first and the third stage from nested candidates."""
    k = F.col("p_partkey")
    concept = F.struct(k.alias("concept_id"), F.when(k % 9 != 0, F.col("p_name")).alias("concept_name"), F.col("p_type").alias("domain_id"), F.col("p_brand").alias("vocabulary_id"))
    nested = table(spark, d, "part").select("p_partkey", concept.alias("concept"), F.when(k % 4 != 0, F.col("p_retailprice")).alias("final_score"), (k % 3 != 0).alias("is_original_standard"), F.struct(F.col("p_size").alias("concept_id"), F.lit("x").alias("concept_name")).alias("original"),
                                              F.when(k % 5 == 0, F.when(k % 10 == 0, 0.0)).otherwise(F.col("p_retailprice")).alias("score_normalized"), (F.col("p_size") / 2.0).alias("score"))
    first = report.rows(nested, 1, ["p_partkey"]).select("p_partkey", F.col("elasticsearch_score").alias("first_score"))
    third = report.rows(nested, 3, ["p_partkey"]).select("p_partkey", *report.SHORT, "final_score", "is_original_standard", "search_type", F.col("original_non_standard.concept_id").alias("from_id"))
    return third.join(first, "p_partkey")


def _counting(prompt: str) -> tuple[str, str]:
    """A judge for the query below: it counts letters, and fails where five divide them."""
    if len(prompt) % 5 == 0:
        raise ValueError("no answer")
    return prompt[:3], f'{{"usage": {{"prompt_tokens": {len(prompt)}, "completion_tokens": 3}}}}'


@query("""
WITH c AS (SELECT length(text) AS n, length(text) % 5 <> 0 AS ok, t.tag FROM conversations, (VALUES ('first'), ('second')) t(tag) WHERE text IS NOT NULL)
SELECT tag, ok AS success, CASE WHEN ok THEN NULL ELSE 'ValueError: no answer' END AS error, count(*) AS calls, CAST(sum(CASE WHEN ok THEN n + 3 ELSE 0 END) AS BIGINT) AS tokens, round(sum(CASE WHEN ok THEN n / 1e6 * 0.25 + 3 / 1e6 * 2 ELSE 0 END), 9) AS cost_usd, true AS timed FROM c GROUP BY ALL""")
def llm_call_log(spark, d):
    """Two batches of calls added to one log, failures among them."""
    from termweave.operators import score
    from termweave.sources.sinks import shared_folder

    path = f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}"
    prompts = table(spark, d, "conversations").where("text is not null").select(F.concat_ws("/", "conv_id", "turn").alias("entity_id"), F.col("text").alias("prompt"))
    for tag in ("first", "second"):
        metrics.append_calls(metrics.call_records(score.asked(prompts, _counting), tag, " gpt-5-mini", "OpenAI_API"), path)
    log = spark.read.parquet(path)
    return log.groupBy("tag", "success", "error").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 9).alias("cost_usd"), F.bool_and(F.col("latency_ms") >= 0).alias("timed"))


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 = 0 THEN 'openai/gpt-oss-20b' ELSE 'GPT_oss_20b' END WHEN 1 THEN 'GPT-5-mini' WHEN 3 THEN 'llama4_maverick' WHEN 4 THEN CASE WHEN p_partkey % 4 = 0 THEN 'meta-llama/Llama-4-Maverick-17B-128E-Instruct-FP8' ELSE 'llama4_maverick' END END AS model,
  CASE WHEN p_partkey % 6 = 1 THEN 128000 ELSE 2048 END AS cap, CAST(CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 6 = 1 THEN 2.25 ELSE 0 END AS DOUBLE) AS cost, 3 AS fixed FROM part""")
def model_names_and_caps(spark, d):
    """Short names spelled out at one provider, caps by name, and prices by provider or as given."""
    k = F.col("p_partkey")
    name = F.when(k % 6 == 0, " GPT_oss_20b").when(k % 6 == 1, "GPT-5-mini ").when(k % 6 == 2, "  ").when(k % 6 == 3, "llama4_maverick").when(k % 6 == 4, "llama4_maverick")
    by = F.when(k % 4 == 0, " Together-AI").otherwise("somewhere")
    million = F.lit(1_000_000)
    model = metrics.model_name(metrics.provider(by), name)
    return table(spark, d, "part").select("p_partkey", model.alias("model"), metrics.token_cap(name).alias("cap"), metrics.cost(million, million, model, by).alias("cost"), metrics.cost(million, million, model, by, (1.0, 2.0)).cast("int").alias("fixed"))


@query("SELECT measure, l_returnflag, round(sum(value), 2) AS total, count(*) AS n FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME measure VALUE value) GROUP BY ALL")
def unpivot_scores(spark, d):
    long = evaluate.unpivot_runs(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "measure", "value")
    return long.groupBy("measure", "l_returnflag").agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT p_partkey, pos, name, score FROM (SELECT p_partkey, 1 AS pos, p_name AS name, CAST(p_size AS DOUBLE) AS score FROM part UNION ALL SELECT p_partkey, 2, p_brand, p_retailprice FROM part)")
def positional_join(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return evaluate.paired(rows, ["p_partkey"], ["p_name", "p_brand"], ["a", "b"])


@query("""
WITH t AS (SELECT p_partkey, CAST(p_size % 3 AS VARCHAR) AS a, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size % 2 AS VARCHAR) END AS b, CASE WHEN p_partkey % 3 = 0 THEN '1' END AS c FROM part)
SELECT p_partkey, CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT < 2 THEN NULL WHEN len(list_distinct([a, b, c])) = 1 THEN 'Same' ELSE 'Different' END AS verdict FROM t""")
def three_way_compare(spark, d):
    k = F.col("p_partkey")
    a, b, c = (F.col("p_size") % 3).cast("string"), F.when(k % 2 == 0, (F.col("p_size") % 2).cast("string")), F.when(k % 3 == 0, "1")
    return table(spark, d, "part").select("p_partkey", evaluate.compare_three(a, b, c).alias("verdict"))


OK = "success AS (SELECT *, tokens % 10 <> 0 AS ok, tokens / 1e6 * 0.25 AS cost FROM calls)"


@query(f"WITH {CALLS}, {OK} SELECT tag, count(*) AS calls, count(CASE WHEN ok THEN 1 END) AS succeeded, round(avg(CASE WHEN ok THEN latency_ms END), 6) AS mean_ms, round(quantile_cont(CASE WHEN ok THEN latency_ms END, 0.5), 6) AS p50_ms, round(quantile_cont(CASE WHEN ok THEN latency_ms END, 0.95), 6) AS p95_ms, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 9) AS cost_usd FROM success GROUP BY tag")
def llm_metrics_by_tag(spark, d):
    rows = calls(spark, d).withColumn("success", F.col("tokens") % 10 != 0).withColumn("cost_usd", metrics.cost(F.col("tokens"), F.lit(0), F.lit("gpt-5-mini")))
    out = metrics.summary(rows, "tag")
    return out.select("tag", "calls", "succeeded", *(r6(c).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms")), "tokens", F.round("cost_usd", 9).alias("cost_usd"))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level, count(*) AS n, round(avg(l_discount), 4) AS mean FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))")
def grouped_levels(spark, d):
    return evaluate.levels(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", n=F.count("*"), mean=F.round(F.avg("l_discount"), 4))


@query("SELECT lang, count(*) AS missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY lang")
def eval_anti_missing(spark, d):
    return evaluate.missing_pairs(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"]).groupBy("lang").agg(F.count("*").alias("missing"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'known' WHEN quality IS NOT NULL THEN 'quality ' || quality END AS truth_name FROM documents LEFT JOIN labels USING (doc_id)")
def ground_truth_enrich(spark, d):
    from termweave.sources.files import truth_names

    labels = table(spark, d, "labels").select("doc_id", F.lit("all").alias("domain"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("name"), F.col("doc_id").alias("seq"))
    names = truth_names(labels, "doc_id", "domain", "name", "seq")
    rows = table(spark, d, "documents").select("doc_id", F.lit("all").alias("domain"), F.when(F.col("doc_id") % 2 == 0, "known").alias("truth_name"))
    return rows.join(names, ["doc_id", "domain"], "left").select("doc_id", F.coalesce("truth_name", "name").alias("truth_name"))


@query("SELECT status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE WHEN quality IS NULL THEN 'Failed' WHEN quality = doc_id % 2 THEN 'Correct' ELSE 'Incorrect' END AS status FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY status")
def correctness_summary(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    rows = joined.select(batch.status(F.col("quality").isNotNull(), batch.is_correct(F.col("quality"), F.col("doc_id") % 2)).alias("status"))
    n = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    return rows.groupBy("status").agg(F.count("*").alias("n")).join(n).select("status", "n", r6(100.0 * F.col("n") / F.col("total")).alias("share"))


@query("SELECT s.s_name AS name, s_suppkey, n_nationkey FROM (SELECT * FROM supplier) s JOIN (SELECT n_nationkey, 'Supplier#' || lpad(CAST(n_nationkey // 2 AS VARCHAR), 9, '0') AS name FROM nation) n ON s.s_name = n.name WHERE n.name IN (SELECT 'Supplier#' || lpad(CAST(n_nationkey // 2 AS VARCHAR), 9, '0') FROM nation GROUP BY 1 HAVING count(*) = 1)")
def unique_name_match(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("Supplier#"), F.lpad(F.floor(F.col("n_nationkey") / 2).cast("string"), 9, "0")).alias("name"))
    supplier = table(spark, d, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    return evaluate.unique_names(supplier, "name").join(evaluate.unique_names(nation, "name"), "name")


@query("SELECT conv_id, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS turns, count(*) AS n FROM conversations GROUP BY conv_id")
def ordered_run_lists(spark, d):
    item = F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("t"))
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    return lists.select("conv_id", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("turns"), F.size("l").cast("long").alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def streaming_ingest_final(spark, d):
    """The table that a resumable stream over ``events`` leaves."""
    from termweave.sources.sinks import KeyedTable, shared_folder
    from termweave.streaming.ingest import ingest

    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    target = KeyedTable(spark, f"{base}/table", "user_id", "event_id")
    schema = table(spark, d, "events").schema
    ingest(spark, d, schema, target, f"{base}/progress", lambda rows: rows.select("user_id", "event_id", "event_type"), pathGlobFilter="events.parquet").awaitTermination()
    return target.read()


@query("SELECT o_orderpriority, o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def sheet_last_wins(spark, d):
    return first_by(table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_custkey"), ["o_custkey", "o_orderpriority"], F.col("o_orderkey").desc())
