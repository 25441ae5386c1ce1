"""Cleaning, vocabulary and text queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from termweave.functions import text
from termweave.functions.dates import normalize_date
from termweave.functions.numbers import or_else
from termweave.operators import batch, clean, embed, vocab
from termweave.operators.dedup import first_by, upsert
from termweave.plans.tables import CONCEPT, EDGE, concept, edge, query, strip, table, words
from termweave.sources import sinks

SYNONYM = "synonym AS (SELECT CAST(l_partkey AS VARCHAR) AS concept_id, s_name AS concept_synonym_name FROM (SELECT DISTINCT l_partkey + CASE WHEN l_suppkey % 10 = 0 THEN 1000000 ELSE 0 END AS l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey)"


def synonym(spark, d):
    """Supplier names as synonyms; a tenth belong to no concept."""
    pairs = table(spark, d, "lineitem").select((F.col("l_partkey") + F.when(F.col("l_suppkey") % 10 == 0, 1000000).otherwise(0)).alias("k"), "l_suppkey").distinct()
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("concept_synonym_name"))
    return pairs.join(names, "l_suppkey").select(F.col("k").cast("string").alias("concept_id"), "concept_synonym_name")


@query(f"""
WITH {CONCEPT}, raw AS (SELECT concept_id, CASE CAST(concept_id AS BIGINT) % 7 WHEN 0 THEN ' ' || concept_name || '  ' WHEN 1 THEN 'None' WHEN 2 THEN '  ' ELSE concept_name END AS concept_name,
  CASE CAST(concept_id AS BIGINT) % 5 WHEN 0 THEN 'nan' ELSE domain_id END AS domain_id, CASE CAST(concept_id AS BIGINT) % 4 WHEN 0 THEN 'X' ELSE standard_concept END AS standard_concept FROM concept)
SELECT concept_id, CASE WHEN trim(concept_name) NOT IN ('', 'None', 'nan', 'NaN') THEN trim(concept_name) END AS concept_name,
  CASE WHEN trim(domain_id) NOT IN ('', 'None', 'nan', 'NaN') THEN trim(domain_id) END AS domain_id, CASE WHEN standard_concept IN ('S', 'C') THEN standard_concept END AS standard_concept FROM raw""")
def scan_project_clean(spark, d):
    n = F.col("concept_id").cast("bigint")
    name = F.when(n % 7 == 0, F.concat(F.lit(" "), "concept_name", F.lit("  "))).when(n % 7 == 1, "None").when(n % 7 == 2, "  ").otherwise(F.col("concept_name"))
    raw = concept(spark, d).select("concept_id", name.alias("concept_name"), F.when(n % 5 == 0, "nan").otherwise(F.col("domain_id")).alias("domain_id"), F.when(n % 4 == 0, "X").otherwise(F.col("standard_concept")).alias("standard_concept"))
    return clean.clean_concepts(raw)


@query("""
WITH raw AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d')
  WHEN 3 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y') || '0231' END AS raw_date FROM orders)
SELECT o_orderkey, raw_date, CASE WHEN o_orderkey % 7 IN (0, 6) THEN raw_date WHEN o_orderkey % 7 <> 5 THEN strftime(coalesce(try_strptime(raw_date, '%Y-%m-%d'), try_strptime(raw_date, '%Y/%m/%d'), try_strptime(raw_date, '%d-%m-%Y'), try_strptime(raw_date, '%d/%m/%Y')), '%Y%m%d') END AS date FROM raw""")
def date_normalize(spark, d):
    k, day = F.col("o_orderkey") % 7, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(day, "yyyyMMdd")).when(k == 1, F.date_format(day, "yyyy-MM-dd")).when(k == 2, F.date_format(day, "yyyy/MM/dd")).when(k == 3, F.date_format(day, "dd-MM-yyyy"))
    raw = raw.when(k == 4, F.date_format(day, "dd/MM/yyyy")).when(k == 5, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.date_format(day, "yyyy"), F.lit("0231")))
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw_date")).withColumn("date", normalize_date(F.col("raw_date")))


_UNION = "SELECT concept_id, concept_name, domain_id, vocabulary_id, standard_concept, 'Original' AS name_type FROM concept UNION ALL SELECT s.concept_id, concept_synonym_name, domain_id, vocabulary_id, standard_concept, 'Synonym' FROM synonym s {how} JOIN concept c ON s.concept_id = c.concept_id"


@query(f"WITH {CONCEPT}, {SYNONYM} " + _UNION.format(how=""))
def concept_small_union(spark, d):
    return vocab.names(concept(spark, d), synonym(spark, d), "inner")


@query(f"WITH {CONCEPT}, {SYNONYM} " + _UNION.format(how="LEFT"))
def concept_small_left(spark, d):
    return vocab.names(concept(spark, d), synonym(spark, d), "left")


@query(f"WITH {CONCEPT}, {SYNONYM}, small AS ({_UNION.format(how='')}) SELECT name_type, count(*) AS n FROM small GROUP BY name_type")
def name_type_counts(spark, d):
    return vocab.name_type_counts(concept_small_union(spark, d))


@query("SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def dedup_first(spark, d):
    return first_by(table(spark, d, "part").select("p_name", "p_partkey", "p_brand"), ["p_name"], F.col("p_partkey").asc())


@query("SELECT p_partkey, md5(concat_ws('_', CAST(p_partkey AS VARCHAR), lower(p_name))) AS doc_id, md5(concat_ws('_', CAST(p_partkey AS VARCHAR), '', p_brand)) AS edge_id FROM part")
def doc_id_md5(spark, d):
    return table(spark, d, "part").select("p_partkey", text.doc_id(F.col("p_partkey"), F.lower("p_name")).alias("doc_id"), text.doc_id(F.col("p_partkey"), F.lit(None), F.col("p_brand")).alias("edge_id"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_last_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    old, new = rows.where("event_type <> 'click'"), rows.where("event_type = 'click'")
    return upsert(old, new, "user_id", "event_id")


@query(f"WITH {EDGE} SELECT relationship_id, count(*) AS n FROM edge WHERE relationship_id IN ('Maps to', 'Marketed form of', 'Box of') GROUP BY relationship_id")
def relationship_allowlist(spark, d):
    return clean.keep_relationships(edge(spark, d), vocab.LOADED).groupBy("relationship_id").agg(F.count("*").alias("n"))


@query(f"""
WITH {EDGE} SELECT concept_id_1, count(*) AS n_loaded, CAST(sum(CASE WHEN relationship_id = 'Is a' THEN 1 ELSE 0 END) AS BIGINT) AS n_added FROM edge GROUP BY concept_id_1""")
def is_a_additive_load(spark, d):
    first, more = clean.keep_relationships(edge(spark, d), vocab.LOADED), clean.keep_relationships(edge(spark, d), (vocab.ADDED,))
    return first.unionByName(more).groupBy("concept_id_1").agg(F.count("*").alias("n_loaded"), F.count_if(F.col("relationship_id") == vocab.ADDED).alias("n_added"))


@query("""
WITH raw AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS concept_id, CASE p_partkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'nan' WHEN 2 THEN ' ' || p_name WHEN 3 THEN NULL ELSE p_name END AS name FROM part)
SELECT 'concept' AS kind, count(*) AS n, count(CASE WHEN trim(name) NOT IN ('', 'None', 'nan', 'NaN') THEN 1 END) AS named FROM raw WHERE concept_id IS NOT NULL AND name IS NOT NULL
UNION ALL SELECT 'synonym', count(*), count(*) FROM raw WHERE concept_id IS NOT NULL AND trim(name) NOT IN ('', 'None', 'nan')""")
def key_null_cleaning(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "  ").when(k % 5 == 1, "nan").when(k % 5 == 2, F.concat(F.lit(" "), "p_name")).when(k % 5 == 3, None).otherwise(F.col("p_name"))
    raw = table(spark, d, "part").select(F.when(k % 11 != 0, k.cast("string")).alias("concept_id"), name.alias("name"))
    a = clean.clean_concepts(raw.withColumnRenamed("name", "concept_name")).agg(F.lit("concept").alias("kind"), F.count("*").alias("n"), F.count("concept_name").alias("named"))
    b = clean.clean_synonyms(raw.withColumnRenamed("name", "concept_synonym_name")).agg(F.lit("synonym").alias("kind"), F.count("*").alias("n"), F.count("concept_synonym_name").alias("named"))
    return a.unionByName(b)


@query(rf"""
SELECT event_id, lower({strip("chr(9) || event_type || '  '")}) AS normal, CASE WHEN event_id % 3 = 0 THEN 'NULL' ELSE event_type END AS shown,
  TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) = user_id, false) AS correct FROM events""")
def text_normalize(spark, d):
    k = F.get_json_object("props", "$.k")
    blank = F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", text.normalize_query(F.concat(F.lit("\t"), "event_type", F.lit("  "))).alias("normal"), text.null_display(blank).alias("shown"), text.parse_score(k).alias("number"), batch.is_correct(k, F.col("user_id")).alias("correct"))


@query(r"""
SELECT p_partkey, lower(p_name) || '(' || p_partkey || ')' AS label, CAST(p_partkey AS VARCHAR) AS concept_id, CAST(p_size AS VARCHAR) AS parsed,
  CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS score FROM part""")
def concept_label_parse(spark, d):
    label = F.concat(F.initcap("p_name"), F.lit("  ("), F.col("p_partkey").cast("string"), F.lit(") "))
    half = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")).otherwise(0.0)
    return table(spark, d, "part").select("p_partkey", text.normalize_concept(label).alias("label"), text.concept_id_of(label).alias("concept_id"), text.parse_concept_id(F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("parsed"), or_else(half, F.col("p_retailprice")).alias("score"))


@query("""
WITH j AS (SELECT p_brand, string_agg(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ; ' ELSE '/' END, '' ORDER BY p_partkey) AS names FROM part GROUP BY p_brand),
u AS (SELECT p_brand, trim(unnest(string_split_regex(names, '[;/]'))) AS name FROM j)
SELECT p_brand, string_agg(name, '|' ORDER BY name) AS names, count(*) AS n FROM (SELECT DISTINCT p_brand, name FROM u WHERE name <> '') GROUP BY p_brand""")
def synonym_split_distinct(spark, d):
    sep = F.when(F.col("p_partkey") % 2 == 0, " ; ").otherwise("/")
    rows = F.array_sort(F.collect_list(F.struct("p_partkey", F.concat("p_name", sep).alias("t"))))
    joined = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "").alias("names"))
    parts = text.split_synonyms(F.col("names"), 1000)
    return joined.select("p_brand", F.array_join(F.array_sort(parts), "|").alias("names"), F.size(parts).cast("long").alias("n"))


@query("""
SELECT l_returnflag, l_linestatus, format('{:.3f} [{:.3f}-{:.3f}]', max(l_discount), min(l_tax), max(l_tax)) AS shown, min(l_quantity) AS least FROM lineitem GROUP BY ALL""")
def metric_formatting(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(text.interval_text(F.max("l_discount"), F.min("l_tax"), F.max("l_tax")).alias("shown"), F.bround(F.min("l_quantity"), 2).alias("least"))


@query(f"""
WITH t AS (SELECT p_partkey, unnest({words("p_name")}) AS token FROM part), g AS (SELECT p_partkey, substr(token, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS gram FROM t, range(4, 6) r(n), range(1, 40) s(i) WHERE i + n - 1 <= length(token))
SELECT p_partkey, count(*) AS n, string_agg(gram, ' ' ORDER BY gram) AS grams FROM g GROUP BY p_partkey""")
def ngram_tokens(spark, d):
    grams = text.ngrams(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.size(grams).cast("long").alias("n"), F.array_join(F.array_sort(grams), " ").alias("grams")).where("n > 0")


@query("""
WITH s AS (SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 3 = 0 THEN ' (old)' ELSE '' END AS name FROM supplier),
k AS (SELECT s_suppkey, name, unnest(CASE WHEN s_suppkey % 3 = 0 THEN [name, trim(regexp_replace(name, '\\([^)]*\\)$', ''))] ELSE [name] END) AS key FROM s)
SELECT key, max(s_suppkey) AS s_suppkey FROM k GROUP BY key""".replace("\\\\", "\\"))
def alias_fanout(spark, d):
    from termweave.operators.evaluate import alias_fan_out

    name = F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, " (old)").otherwise(""))
    return alias_fan_out(table(spark, d, "supplier").select("s_suppkey", name.alias("name")), "name", "s_suppkey").select("key", "s_suppkey")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE 'N/A' END AS record_id, o_orderkey % 4 + o_orderkey % 5 AS total FROM orders""")
def fallback_columns(spark, d):
    from termweave.operators.metrics import token_usage
    from termweave.sources.files import first_column

    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k, F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise("NULL").alias("id"), F.when(k % 3 == 1, F.col("o_orderpriority")).alias("row_id"), F.lit("N/A").alias("none"))
    usage = F.concat(F.lit('{"token_usage": {"prompt_tokens": '), (k % 4).cast("string"), F.lit(', "completion_tokens": '), (k % 5).cast("string"), F.lit(', "total_tokens": 0}}'))
    fallback = first_column(rows, ("id", "row_id", "snuh_id", "note_id"))
    return rows.select("o_orderkey", F.coalesce(fallback, F.lit("N/A")).alias("record_id"), token_usage(usage)[2].alias("total"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'together' ELSE 'openai' END AS provider,
  CASE event_id % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 1.25 WHEN 2 THEN 0.15 ELSE 0.0 END * 1.0 AS price_in, round(value / 1e6 * CASE event_id % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 1.25 WHEN 2 THEN 0.15 ELSE 0.0 END
  + value * 2 / 1e6 * CASE event_id % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 10.0 WHEN 2 THEN 0.6 ELSE 0.0 END, 9) AS cost FROM events""".replace("* 1.0 AS price_in", "+ CAST(0 AS DOUBLE) AS price_in"))
def alias_map_and_price(spark, d):
    from termweave.operators import metrics

    k = F.col("event_id")
    name = F.when(k % 3 == 0, "openai_api").when(k % 3 == 1, " Together-AI ").otherwise("other")
    model = F.when(k % 4 == 0, "GPT-5-mini-x").when(k % 4 == 1, "gpt-5.1").when(k % 4 == 2, "gpt-4o-mini").otherwise("unknown")
    return table(spark, d, "events").select("event_id", metrics.provider(name).alias("provider"), metrics.price(model)[0].alias("price_in"), F.round(metrics.cost(F.col("value"), F.col("value") * 2, model), 9).alias("cost"))


@query("""
WITH n AS (SELECT l_returnflag, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'name ' || l_partkey % 300 END AS name, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'name ' || l_partkey % 300 END) AS n FROM lineitem),
f AS (SELECT l_returnflag, name, min(n) AS n FROM n WHERE n <= 1000 AND name <> '' GROUP BY ALL)
SELECT l_returnflag, string_agg(name, '|' ORDER BY n) AS synonyms FROM f GROUP BY l_returnflag""")
def bounded_synonym_lists(spark, d):
    """Three concepts of very many synonyms each: the distinct names of the first thousand."""
    name = F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("name "), (F.col("l_partkey") % 300).cast("string")))
    rows = table(spark, d, "lineitem").select("l_returnflag", name.alias("name"), "l_orderkey", "l_linenumber")
    return vocab.synonym_lists(rows, "l_returnflag", "name", F.col("l_orderkey"), F.col("l_linenumber")).select("l_returnflag", F.array_join("synonyms", "|").alias("synonyms"))


def _hashed(texts):
    """A model for the query below: four numbers of a text's md5."""
    import hashlib

    return [[int(hashlib.md5(t.encode()).hexdigest()[2 * i : 2 * i + 2], 16) / 256 for i in range(4)] for t in texts]


@query("SELECT p_partkey, " + ", ".join(f"CAST('0x' || substr(md5(lower(p_name)), {2 * i + 1}, 2) AS BIGINT) / 256 AS v{i}" for i in range(4)) + " FROM part")
def embedded_names(spark, d):
    """Names embedded as queries are, in two loads: the second finds most of its texts in the table."""
    held = sinks.KeyedTable(spark, f"{sinks.shared_folder(spark)}/vectors-{uuid.uuid4().hex}", "name", "seq")
    names = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.initcap("p_name")).alias("p_name"))
    embed.embed(names.where("p_partkey % 2 = 0"), "p_name", _hashed, held, "md5", normalize=True)
    found = embed.embed(names, "p_name", _hashed, held, "md5", normalize=True)
    return found.select("p_partkey", *(F.col("vector")[i].cast("double").alias(f"v{i}") for i in range(4)))
