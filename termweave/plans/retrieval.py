"""Retrieval queries: lexical, vector and hybrid top k, and their merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.functions import numbers, text
from termweave.operators import fuzzy, lexical, retrieve, vector
from termweave.operators.dedup import dedup_by_concept, top_by
from termweave.plans.tables import CONCEPT, concept, corpus, entities, query, r6, table, vectors, words

#: Tokens, statistics and BM25 of documents for the benchmark's items.
BM25 = f"""d AS (SELECT doc_id, lang, lower(text) AS name, {words("text")} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
e AS (SELECT item_id, trim(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS asked, CASE WHEN item_id % 2 = 0 THEN 'en' END AS domain, {words("text")} AS w FROM benchmark),
tf AS (SELECT doc_id, token, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, unnest(w) AS token FROM d) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
q AS (SELECT item_id, domain, unnest(list_distinct(w)) AS token, len(list_distinct(w)) AS n_terms FROM e),
m AS (SELECT item_id, tf.doc_id, n_terms, count(*) AS matched, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.5 + 0.5 * len(d.w) / mean))) AS bm25
      FROM q JOIN tf USING (token) JOIN df USING (token) JOIN d USING (doc_id) CROSS JOIN st WHERE domain IS NULL OR domain = lang GROUP BY ALL)"""
ENOUGH = "matched >= CASE WHEN n_terms <= 1 THEN n_terms ELSE greatest(1, floor(n_terms * 0.6)) END"
EXACT = """x AS (SELECT item_id, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) / 2.2 AS exact FROM e JOIN d ON asked = name JOIN (SELECT name, count(*) AS df FROM d GROUP BY name) c ON c.name = asked CROSS JOIN st WHERE domain IS NULL OR domain = lang)"""
PHRASE = """pi AS (SELECT item_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf, count(*) AS known FROM (SELECT item_id, unnest(w) AS token FROM e) JOIN df USING (token) CROSS JOIN st GROUP BY item_id),
pt AS (SELECT m.item_id, m.doc_id, idf, len(d.w) AS size, CAST(len(list_filter(range(0, greatest(0, len(d.w) - len(e.w) + 1)), lambda i: d.w[i + 1 : i + len(e.w)] = e.w)) AS DOUBLE) AS times
       FROM m JOIN pi USING (item_id) JOIN e USING (item_id) JOIN d USING (doc_id) WHERE matched = n_terms AND known = len(e.w)),
ph AS (SELECT item_id, doc_id, idf * times / (times + 0.9 * (1 - 0.5 + 0.5 * size / mean)) AS phrase FROM pt CROSS JOIN st WHERE times > 0)"""
TEXT = f"""t AS (SELECT coalesce(a.item_id, x.item_id) AS item_id, coalesce(a.doc_id, x.doc_id) AS doc_id, coalesce(exact, 0) * 3.0 + coalesce(bm25, 0) * {{boost}} {{more}} AS score
  FROM (SELECT * FROM m WHERE {ENOUGH}) a FULL JOIN x ON a.item_id = x.item_id AND a.doc_id = x.doc_id {{join}})"""
LEXICAL = TEXT.format(boost="2.0", more="+ coalesce(phrase, 0) * 2.5", join="LEFT JOIN ph ON ph.item_id = coalesce(a.item_id, x.item_id) AND ph.doc_id = coalesce(a.doc_id, x.doc_id)")
TOP3 = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {src}) WHERE rank <= 3"


def _hits(df):
    return df.select(F.col("entity_id").alias("item_id"), F.col("concept_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), r6("score").alias("score"), r6(retrieve.normalized(F.col("score"))).alias("norm"))


@query(f"WITH {BM25}, {EXACT}, {PHRASE}, {LEXICAL} SELECT item_id, doc_id, rank, round(score, 6) AS score, round(1 / (1 + exp(-(score - 15) / 8)), 6) AS norm FROM ({TOP3.format(src='t')}) WHERE score >= 3")
def lexical_bm25_topk(spark, d):
    return _hits(lexical.lexical_topk(entities(spark, d), corpus(spark, d)).where("score >= 3"))


@query(f"WITH {BM25} SELECT item_id, count(*) AS n_docs, max(matched) AS most, min(matched) AS least FROM m WHERE {ENOUGH} GROUP BY item_id")
def lexical_min_should_match(spark, d):
    found = lexical.match_scores(entities(spark, d), corpus(spark, d))
    return found.groupBy(F.col("entity_id").alias("item_id")).agg(F.count("*").alias("n_docs"), F.max("matched").alias("most"), F.min("matched").alias("least"))


@query(f"WITH {BM25}, {EXACT}, {PHRASE} SELECT coalesce(ph.item_id, x.item_id) AS item_id, coalesce(ph.doc_id, x.doc_id) AS doc_id, round(phrase, 6) AS phrase, round(exact, 6) AS exact FROM ph FULL JOIN x ON ph.item_id = x.item_id AND ph.doc_id = x.doc_id")
def exact_and_phrase_match(spark, d):
    asked, docs = entities(spark, d), corpus(spark, d)
    index = lexical.LexicalIndex.build(asked, docs)
    phrase = lexical.phrase_scores(asked, docs, index.matches, index)
    both = phrase.join(lexical.exact_scores(asked, docs), ["entity_id", "concept_id"], "full")
    return both.select(F.col("entity_id").alias("item_id"), F.col("concept_id").alias("doc_id"), r6("phrase").alias("phrase"), r6("exact").alias("exact"))


@query(f"WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents), t AS (SELECT token, count(*) AS df, sum(tf) AS cf FROM (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS token FROM d) GROUP BY ALL) GROUP BY token) SELECT token, df, CAST(cf AS BIGINT) AS cf, n, round(mean, 6) AS mean, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM t CROSS JOIN (SELECT count(*) AS n, avg(len(w)) AS mean FROM d)")
def bm25_corpus_stats(spark, d):
    docs = corpus(spark, d)
    stats = F.broadcast(lexical.corpus_stats(docs))  # one row
    return lexical.term_stats(docs).join(stats).select("token", "df", "cf", "n", r6("mean").alias("mean"), r6(lexical.idf(F.col("n"), F.col("df"))).alias("idf"))


@query("""
WITH q(query) AS (VALUES ('red widgt'), ('smal ring'), ('blue bolt'), ('small ring'), ('xy')), n AS (SELECT DISTINCT lower(p_name) AS name FROM part),
s AS (SELECT query, name, levenshtein(name, query) AS distance FROM q CROSS JOIN n) SELECT query, name, CAST(distance AS INTEGER) AS distance FROM s WHERE distance <= CASE WHEN length(query) < 3 THEN 0 WHEN length(query) <= 5 THEN 1 ELSE 2 END""")
def fuzzy_name_search(spark, d):
    asked = spark.createDataFrame([("red widgt",), ("smal ring",), ("blue bolt",), ("small ring",), ("xy",)], "query string")
    return lexical.fuzzy_names(asked, table(spark, d, "part").select(F.lower("p_name").alias("name"))).select("query", "name", "distance")


#: Names of parts, and every fortieth of them with two letters wrong.
PART_NAMES = "n AS (SELECT p_partkey AS concept_id, p_name || ' ' || p_type || ' ' || p_brand AS name FROM part), a AS (SELECT concept_id AS query_id, substr(name, 1, 1) || 'x' || substr(name, 3, 3) || substr(name, 7) AS query FROM n WHERE concept_id % 40 = 0)"


def _field_terms(src: str, key: str, text: str) -> str:
    token = f"SELECT {key}, unnest({words(text)}) AS token FROM {src}"
    gram = f"SELECT {key}, 'grams' AS field, substr(token, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS term FROM ({token}), range(4, 6) r(k), range(1, 60) s(i) WHERE i + k - 1 <= length(token)"
    return f"SELECT {key}, 'name' AS field, token AS term FROM ({token}) UNION ALL {gram}"


@query(f"""
WITH {PART_NAMES}, t AS ({_field_terms("n", "concept_id", "name")}), q AS (SELECT query_id, field, term AS asked, count(*) AS times FROM ({_field_terms("a", "query_id", "query")}) GROUP BY ALL),
p AS (SELECT concept_id, field, term, CAST(count(*) AS DOUBLE) AS tf FROM t GROUP BY ALL), l AS (SELECT concept_id, field, sum(tf) AS len FROM p GROUP BY ALL),
st AS (SELECT field, count(*) AS n, avg(len) AS mean FROM l GROUP BY field), df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
c AS (SELECT field, asked, term, df, levenshtein(asked, term) AS edits FROM (SELECT DISTINCT field, asked FROM q) JOIN df USING (field) WHERE levenshtein(asked, term) <= CASE WHEN length(asked) < 3 THEN 0 WHEN length(asked) <= 5 THEN 1 ELSE 2 END),
w AS (SELECT field, asked, term, (1 - edits / least(length(asked), length(term))) * (CASE field WHEN 'name' THEN 2 ELSE 1 END) * ln(1 + (n - most + 0.5) / (most + 0.5)) AS weight, mean
      FROM (SELECT *, max(df) OVER (PARTITION BY field, asked) AS most FROM c) JOIN st USING (field)),
s AS (SELECT query_id, concept_id, field, sum(times * weight * tf / (tf + 0.9 * (1 - 0.5 + 0.5 * len / mean))) AS score FROM q JOIN w USING (field, asked) JOIN p USING (field, term) JOIN l USING (concept_id, field) GROUP BY ALL),
b AS (SELECT query_id, concept_id, max(score) AS score, arg_max(field, (round(score, 9), field = 'name')) AS field FROM s GROUP BY ALL)
SELECT query_id, concept_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, field FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, concept_id) AS rank FROM b) WHERE rank <= 10""")
def fuzzy_field_search(spark, d):
    k, name = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_type", "p_brand")
    docs = table(spark, d, "part").select(k.alias("concept_id"), name.alias("concept_name"))
    wrong = F.concat(F.substring("concept_name", 1, 1), F.lit("x"), F.substring("concept_name", 3, 3), F.substr("concept_name", F.lit(7)))
    found = fuzzy.search(docs.where("concept_id % 40 = 0").select(F.col("concept_id").alias("query_id"), wrong.alias("query")), docs)
    return found.select("query_id", "concept_id", "rank", r6("score").alias("score"), "field")


VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), c AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, a.label = b.label AS same, list_cosine_similarity(a.x, b.x) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"
KNN = "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM c WHERE same) WHERE rank <= {k})"


def _asked(spark, d):
    return vectors(spark, d).where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")


@query(f"WITH {VEC}, {KNN.format(k=3)} SELECT query_id, vec_id, rank, round(cosine, 6) AS cosine, round((1 + cosine) / 2, 6) AS score FROM k")
def knn_cosine_topk(spark, d):
    found = vector.knn(_asked(spark, d), vectors(spark, d))
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), r6("cosine").alias("cosine"), r6("score").alias("score"))


@query(f"WITH {VEC} SELECT query_id, vec_id, rank, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM c WHERE cosine >= 0.3) WHERE rank <= 10")
def knn_min_score(spark, d):
    found = vector.within(_asked(spark, d), vectors(spark, d), least=0.3)
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), r6("cosine").alias("cosine"))


@query(f"WITH {VEC}, {KNN.format(k=3)} SELECT query_id, vec_id, rank, round((1 + cosine) / 2, 6) AS score FROM k WHERE (1 + cosine) / 2 >= 0.62")
def topk_then_threshold(spark, d):
    found = vector.knn(_asked(spark, d), vectors(spark, d)).where("score >= 0.62")
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query(f"WITH {VEC}, {KNN.format(k=9)} SELECT query_id, vec_id, rank, round((1 + cosine) / 2, 6) AS similarity, round(1 / (1 + exp(-(cosine - 3))), 6) AS score_normalized FROM k")
def semantic_rank(spark, d):
    from termweave.operators import score

    near = vector.knn(_asked(spark, d), vectors(spark, d), k=9)
    rows = near.select("query_id", "vec_id", F.col("cosine").alias("score"))
    sides = [vectors(spark, d).select(F.col("vec_id").alias(i), F.col("vector").alias(v)) for i, v in (("query_id", "entity_vector"), ("vec_id", "concept_vector"))]
    rows = rows.join(sides[0], "query_id").join(sides[1], "vec_id")
    scored = score.semantic_scores(rows, F.col("entity_vector"), F.col("concept_vector"))
    ranked = score.ranked(scored, ["query_id"], F.round("final_score", 9), F.col("vec_id"))
    return ranked.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), r6("similarity").alias("similarity"), r6("score_normalized").alias("score_normalized"))


def _near(spark, d):
    """The nearest documents of each item: items and documents take the vector of their number modulo the number of vectors."""
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    v = vectors(spark, d).withColumnRenamed("vec_id", "at").drop("domain")
    of = lambda df, key: df.join(F.broadcast(n)).withColumn("at", F.col(key) % F.col("n")).join(v, "at")  # noqa: E731  n is one row
    asked = of(entities(spark, d).select("entity_id", "domain_id"), "entity_id").select((-1 - F.col("entity_id")).alias("entity_id"), "vector", F.lit("").alias("domain"))
    docs = of(corpus(spark, d).select("concept_id", "domain_id"), "concept_id").select("concept_id", "vector", F.lit("").alias("domain"))
    return retrieve.neighbours(asked, docs).withColumn("entity_id", -1 - F.col("entity_id"))


COS = """nv AS (SELECT count(*) AS n FROM embeddings), vv AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
cs AS (SELECT item_id, doc_id, list_cosine_similarity(a.x, b.x) AS cosine FROM benchmark CROSS JOIN documents CROSS JOIN nv JOIN vv a ON a.vec_id = item_id % n JOIN vv b ON b.vec_id = doc_id % n)"""
HYBRID = f"""h2 AS (SELECT t.item_id, t.doc_id, 0.4 * score * (1 + exp(-0.5 * pow((length(d.name) - length(asked)) / greatest(8.0, 0.8 * length(asked)), 2))) AS text FROM t JOIN e USING (item_id) JOIN d USING (doc_id)),
near AS (SELECT item_id, doc_id, 0.6 * (1 + cosine) / 2 AS near FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 9) DESC, doc_id) AS r FROM cs) WHERE r <= 6),
hy AS (SELECT coalesce(n.item_id, h.item_id) AS item_id, coalesce(n.doc_id, h.doc_id) AS doc_id, coalesce(near, 0) + coalesce(text, 0) AS score FROM near n FULL JOIN h2 h ON n.item_id = h.item_id AND n.doc_id = h.doc_id)"""


@query(f"WITH {BM25}, {EXACT}, {TEXT.format(boost='2.5', more='', join='')}, {COS}, {HYBRID} SELECT item_id, doc_id, rank, round(score, 6) AS score, round(1 / (1 + exp(-(score - 15) / 8)), 6) AS norm FROM ({TOP3.format(src='hy')})")
def hybrid_score_topk(spark, d):
    scored = retrieve.hybrid_scores(entities(spark, d), corpus(spark, d), _near(spark, d))
    return _hits(top_by(scored, ["entity_id"], 3, F.round("score", 9).desc(), F.col("concept_id").asc(), rank="rank"))


@query(f"""WITH {BM25}, {EXACT}, {PHRASE}, {LEXICAL}, {TEXT.format(boost='2.5', more='', join='').replace('t AS (', 't2 AS (', 1)}, {COS}, {HYBRID.replace('FROM t JOIN', 'FROM t2 t JOIN')},
arms AS (SELECT item_id, doc_id, rank, score, 1 / (1 + exp(-(score - 15) / 8)) AS norm, 1 AS arm FROM ({TOP3.format(src='t')}) WHERE score >= 3
  UNION ALL SELECT item_id, doc_id, rank, score, 1 / (1 + exp(-(score - 15) / 8)), 3 FROM ({TOP3.format(src='hy')}) WHERE score >= 3
  UNION ALL SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 9) DESC, doc_id) AS rank, (1 + cosine) / 2 AS score, (1 + cosine) / 2 AS norm, 2 FROM cs) WHERE rank <= 3 AND score >= 0.8)
SELECT item_id, doc_id, ['lexical', 'semantic', 'combined'][arm] AS arm, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY round(coalesce(nullif(norm, 0), score), 9) DESC, arm * 1000 + rank) AS n FROM arms) WHERE n = 1""")
def three_arm_candidates(spark, d):
    asked, docs, near = entities(spark, d), corpus(spark, d), _near(spark, d)
    index = lexical.LexicalIndex.build(asked, docs)
    arms = retrieve.lexical_arm(asked, docs, index=index).unionByName(retrieve.semantic_arm(near)).unionByName(retrieve.combined_arm(asked, docs, near, index=index))
    best = retrieve.merge_arms(arms.withColumn("norm", F.round("norm", 9)), ("entity_id", "concept_id"))
    return best.select(F.col("entity_id").alias("item_id"), F.col("concept_id").alias("doc_id"), "arm", r6("score").alias("score"))


@query(f"""
WITH {CONCEPT}, h AS (SELECT concept_id, 'alias ' || concept_name AS synonym, CASE WHEN CAST(concept_id AS BIGINT) % 2 = 0 THEN 'Synonym' ELSE 'Original' END AS name_type FROM concept)
SELECT h.concept_id, CASE WHEN name_type = 'Synonym' AND o.concept_id IS NOT NULL THEN o.concept_name ELSE synonym END AS concept_name, CASE WHEN name_type = 'Synonym' AND o.concept_id IS NOT NULL THEN synonym END AS matched_synonym,
  CASE WHEN name_type = 'Synonym' AND o.concept_id IS NOT NULL THEN 'Original' ELSE name_type END AS name_type FROM h LEFT JOIN (SELECT * FROM concept WHERE CAST(concept_id AS BIGINT) % 10 <> 0) o ON h.concept_id = o.concept_id""")
def synonym_to_original(spark, d):
    k = F.col("concept_id").cast("bigint")
    names = concept(spark, d).where(k % 10 != 0).select("concept_id", "concept_name", F.lit("Original").alias("name_type"))
    hits = concept(spark, d).select("concept_id", F.concat(F.lit("alias "), "concept_name").alias("concept_name"), F.when(k % 2 == 0, "Synonym").otherwise("Original").alias("name_type"))
    return retrieve.to_originals(hits, names).select("concept_id", "concept_name", "matched_synonym", "name_type")


@query("""
SELECT vocabulary_id, concept_name, concept_id, score FROM (SELECT p_brand AS vocabulary_id, p_name AS concept_name, CAST(p_partkey AS VARCHAR) AS concept_id, CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE CAST(p_size AS DOUBLE) END AS score,
  row_number() OVER (PARTITION BY p_brand, p_name ORDER BY CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE CAST(p_size AS DOUBLE) END DESC, p_partkey) AS n FROM part) WHERE n = 1""")
def candidate_dedup(spark, d):
    norm = F.when(F.col("p_size") % 3 == 0, 0.0).otherwise(F.col("p_size").cast("double"))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("vocabulary_id"), F.col("p_name").alias("concept_name"), F.col("p_partkey").cast("string").alias("concept_id"), numbers.or_else(norm, F.col("p_retailprice")).alias("score"), F.col("p_partkey").alias("seq"))
    return dedup_by_concept(rows, F.col("score"), F.col("seq"), ("vocabulary_id", "concept_name")).drop("seq")


@query("SELECT l_returnflag, l_linenumber, round(sum(1 / (1 + exp(-(l_quantity - 3)))), 4) AS near, round(sum(1 / (1 + exp(-(l_quantity - 15) / 8))), 4) AS far FROM lineitem GROUP BY ALL")
def sigmoid_norm(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.round(F.sum(numbers.sigmoid(q)), 4).alias("near"), F.round(F.sum(retrieve.normalized(q)), 4).alias("far"))


@query()
def projection_128(spark, d):
    """Random projection of every vector to 16 components; checked by a test for unit length and angles."""
    return table(spark, d, "embeddings").select("vec_id", numbers.project(F.col("embedding"), 16).alias("projected"))


@query(f"WITH t AS (SELECT item_id, {words('text')} AS w FROM benchmark) SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS tokens FROM t")
def tokenized_names(spark, d):
    w = text.tokens(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.size(w).cast("long").alias("n"), F.array_join(w, " ").alias("tokens"))
