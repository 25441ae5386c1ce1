"""Source and sink queries: files made of the driver's tables, read back by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from termweave.operators import batch, clean
from termweave.plans.tables import CONCEPT, EDGE, concept, edge, query, table
from termweave.sources import files, order, sinks


def _folder(spark):
    return f"{sinks.shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(f"""
WITH {CONCEPT}, k AS (SELECT *, CAST(concept_id AS BIGINT) AS k FROM concept)
SELECT concept_id, concept_name, CASE WHEN k % 5 <> 0 THEN domain_id END AS domain_id, CASE WHEN k % 4 <> 0 THEN standard_concept END AS standard_concept, '20240102' AS valid_start_date, CAST(NULL AS VARCHAR) AS invalid_reason
FROM k WHERE k % 7 NOT IN (1, 2)""")
def concept_file_scan(spark, d):
    """A tab file with headers in capitals, null tokens, one column too many and some too few."""
    k, base = F.col("concept_id").cast("bigint"), _folder(spark)
    name = F.when(k % 7 == 1, "NULL").when(k % 7 == 2, "None").otherwise(F.col("concept_name"))
    raw = concept(spark, d).select(
        F.col("concept_id").alias("CONCEPT_ID"), name.alias("Concept_Name"), F.when(k % 5 == 0, "nan").otherwise(F.col("domain_id")).alias("domain_id"),
        F.when(k % 4 == 0, "X").otherwise(F.col("standard_concept")).alias("standard_concept"), F.lit("2024-01-02").alias("valid_start_date"), F.lit("x").alias("other"),
    )
    sinks.write_delimited(raw, f"{base}/CONCEPT.csv")
    found = files.create("csv", spark, folder=base).read("concept")
    return found.select("concept_id", "concept_name", "domain_id", "standard_concept", "valid_start_date", "invalid_reason")


@query(f"WITH {EDGE} SELECT concept_id_1, concept_id_2, relationship_id FROM edge WHERE CAST(concept_id_1 AS BIGINT) % 9 <> 0")
def relationship_file_scan(spark, d):
    """The relationship file has a delimiter of its own; edges without an end go."""
    base = _folder(spark)
    to = F.when(F.col("concept_id_1").cast("bigint") % 9 != 0, F.col("concept_id_2"))
    sinks.write_delimited(edge(spark, d).select("concept_id_1", to.alias("concept_id_2"), "relationship_id"), f"{base}/CONCEPT_RELATIONSHIP.csv", ",")
    return files.create("csv", spark, folder=base, relationship_delimiter=",").read("relationship").select("concept_id_1", "concept_id_2", "relationship_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS concept_id, 'alias ' || p_name AS concept_synonym_name FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 10 <> 0")
def english_synonym_file(spark, d):
    k, base = F.col("p_partkey"), _folder(spark)
    name = F.when(k % 10 == 0, "None").otherwise(F.concat(F.lit("alias "), "p_name"))
    raw = table(spark, d, "part").select(k.alias("concept_id"), name.alias("concept_synonym_name"), F.when(k % 3 == 0, clean.ENGLISH).otherwise("4175771").alias("language_concept_id"))
    sinks.write_delimited(raw, f"{base}/CONCEPT_SYNONYM.csv")
    return clean.english(files.create("csv", spark, folder=base).read("synonym")).select("concept_id", "concept_synonym_name")


@query(f"WITH {CONCEPT} SELECT concept_id, concept_name, CASE WHEN CAST(concept_id AS BIGINT) % 2 = 0 THEN 'Synonym' ELSE 'Original' END AS name_type, vocabulary_id FROM concept")
def concept_small_file(spark, d):
    """The merged table, written as a tab file and read as a source."""
    base = _folder(spark)
    kind = F.when(F.col("concept_id").cast("bigint") % 2 == 0, "Synonym").otherwise("Original")
    sinks.write_delimited(concept(spark, d).withColumn("name_type", kind), f"{base}/CONCEPT_SMALL.csv")
    return files.create("csv", spark, folder=base).read("concept_small").select("concept_id", "concept_name", "name_type", "vocabulary_id")


@query("""
SELECT CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE upper(p_name) END AS entity_name, p_type AS domain_id, CAST(p_partkey AS VARCHAR) AS row_id, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS truth_id, CAST(NULL AS VARCHAR) AS truth_name
FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_type IN (SELECT min(p_type) FROM part UNION ALL SELECT max(p_type) FROM part)""")
def mapping_input_rows(spark, d):
    """Input rows under their preferred columns, with both filters."""
    part, k = table(spark, d, "part"), F.col("p_partkey")
    raw = part.select(
        F.when(k % 4 != 0, F.upper("p_name")).alias("source_name"), F.col("p_name").alias("source_value"), F.col("p_type").alias("domain"), k.alias("snuh_id"),
        F.when(k % 6 == 0, "none").otherwise(F.concat(k.cast("string"), F.lit(".0"))).alias("omop_concept_id"), F.col("p_brand").alias("vocabulary"),
    )
    domains = part.agg(F.min("p_type"), F.max("p_type")).first()
    return files.input_rows(raw, "snuh", vocabularies=("Brand#11", "Brand#12", "Brand#13"), domains=tuple(domains))


@query("""
SELECT n_regionkey + 1 AS run, pos, n_name AS entity_name, n_nationkey AS best_concept_id
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos FROM nation) WHERE n_nationkey % 2 = 0""")
def run_file_records(spark, d):
    """A repeat-run document, of a region a run, opened into its records; one domain's stay."""
    k, base = F.col("n_nationkey"), _folder(spark)
    record = F.struct(k, F.struct(F.col("n_name").alias("entity_name"), F.when(k % 2 == 0, "even").otherwise("odd").alias("input_domain"), k.alias("best_concept_id")).alias("record"))
    one = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["record"]).alias("records"))  # 25 nations
    whole = one.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_regionkey", "records"))), lambda x: x["records"]).alias("runs"))
    sinks.write_json(whole.select(F.size("runs").alias("num_runs"), "runs"), base)
    found = files.read_runs(spark, base, "even")
    return found.select(F.col("run").cast("long").alias("run"), F.col("pos").cast("long").alias("pos"), "entity_name", "best_concept_id")


def _in_files(spark, df, key, parts=5):
    """``df`` sorted by ``key`` over several delimited files, whose names follow that order, scanned again in small blocks."""
    base = _folder(spark)
    sinks.write_delimited(df.repartitionByRange(parts, key).sortWithinPartitions(key), base)
    return spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(base)


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_index, CASE WHEN p_partkey % 3 = 0 THEN 7 * p_partkey ELSE row_number() OVER (ORDER BY p_partkey) END AS test_index,
  CASE WHEN p_partkey % 4 = 0 THEN 'note ' || p_partkey ELSE CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS VARCHAR) END AS row_id FROM part""")
def file_row_numbers(spark, d):
    """Places of rows over several files; a test index and a row id are made of them where none is given."""
    k = F.col("p_partkey")
    raw = table(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, 7 * k).alias("test_index"), F.when(k % 4 == 0, F.concat(F.lit("note "), k.cast("string"))).alias("note_id"))
    rows = order.numbered(_in_files(spark, raw, "p_partkey"))
    return order.with_indexes(rows, test_index=F.col("test_index"), row_id=F.col("note_id")).select("p_partkey", "row_index", "test_index", "row_id")


@query("""
WITH s AS (SELECT o_orderkey, o_orderpriority || '-' || o_custkey % 40 AS entity, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT entity, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY i), ',') AS records, min(i) AS first FROM s GROUP BY entity""")
def arrival_order_groups(spark, d):
    """Records of an entity, its name stripped, in the order of several files; and the first of each."""
    name = F.concat("o_orderpriority", F.lit("-"), (F.col("o_custkey") % 40).cast("string"))
    raw = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("  "), name, F.lit(" "))).otherwise(name).alias("entity"))
    rows = order.numbered(_in_files(spark, raw, "o_orderkey")).withColumn("entity", F.trim("entity"))
    lists = order.by_entity(rows, "entity", F.col("o_orderkey"))
    first = order.first_in_file(rows, ["entity"]).select("entity", F.col("row_index").alias("first"))
    return lists.select("entity", F.array_join("records", ",").alias("records")).join(first, "entity")


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 5, 9)")
def evaluation_label_rows(spark, d):
    return files.label_filter(table(spark, d, "embeddings").select("vec_id", "label"), "label")


@query("""
WITH s AS (SELECT o_orderpriority AS entity, CAST(o_custkey AS VARCHAR) AS concept, o_totalprice AS score, o_orderstatus <> 'O' AS sheet, o_orderkey AS seq FROM orders WHERE o_orderkey % 5 <> 0)
SELECT entity, concept, score FROM (SELECT *, row_number() OVER (PARTITION BY entity, concept ORDER BY sheet DESC, seq DESC) AS n FROM s) WHERE n = 1""")
def consensus_sheet_rows(spark, d):
    """Two sheets, the later of which holds; scores that are none drop the row."""
    final = F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_totalprice").cast("string"))
    rows = table(spark, d, "orders").select("o_orderstatus", F.col("o_orderpriority").alias("entity_name"), F.col("o_custkey").cast("string").alias("concept"), final.alias("final"), F.col("o_orderkey").alias("seq"))
    return files.consensus_rows([rows.where("o_orderstatus = 'O'"), rows.where("o_orderstatus <> 'O'")], "final")


@query("SELECT o_orderpriority AS entity_name, o_orderstatus AS domain FROM orders WHERE o_orderkey >= 2 AND o_orderkey % 6 <> 0")
def positional_sheet(spark, d):
    """Columns by place under two header rows; a row without a name goes."""
    name = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority"))
    raw = table(spark, d, "orders").select(name.alias("_c0"), F.col("o_orderstatus").alias("_c1"), F.col("o_custkey").alias("_c2"), F.col("o_orderkey").alias("seq"))
    return files.positional(raw, ["entity_name", "domain"], 2, "seq")


_SHEET = {"Test Index": "event_id", "Entity Name": "event_type", "Input Domain": "CAST(user_id AS VARCHAR)", "Success": "value > 10", "Best Score": "value"}


@query("SELECT " + ", ".join(f'{_SHEET.get(h, "CAST(NULL AS VARCHAR)")} AS "{h}"' for h in sinks.DETAIL) + " FROM events")
def detail_sheet_rows(spark, d):
    raw = table(spark, d, "events").select(F.col("event_id").alias("test_index"), F.col("event_type").alias("entity_name"), F.col("user_id").cast("string").alias("input_domain"), (F.col("value") > 10).alias("success"), F.col("value").alias("best_score"))
    return sinks.detail_sheet(raw)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS p_name, p_size, p_retailprice FROM part")
def json_result_file(spark, d):
    """Nested records written as JSON, nulls kept, and read back."""
    base = _folder(spark)
    nested = F.struct("p_size", "p_retailprice").alias("more")
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("p_name"), nested)
    sinks.write_json(rows, base)
    return spark.read.schema(rows.schema).json(base).select("p_partkey", "p_name", "more.p_size", "more.p_retailprice")


@query("SELECT count(DISTINCT o_custkey) AS n_rows, true AS has_bytes, true AS enough, false AS too_many, true AS dropped FROM orders")
def table_stats_and_drop(spark, d):
    """A keyed table's statistics and check after a load, and that it is gone in the end."""
    held = sinks.KeyedTable(spark, _folder(spark), "o_custkey", "o_orderkey")
    held.upsert(table(spark, d, "orders").select("o_custkey", "o_orderkey"))
    stats = held.stats()
    checks = held.verify(stats["rows"]), held.verify(stats["rows"] + 1)
    held.drop()
    return spark.createDataFrame([(stats["rows"], stats["bytes"] > 0, *checks, held.read() is None)], "n_rows long, has_bytes boolean, enough boolean, too_many boolean, dropped boolean")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def first_rows_sample(spark, d):
    """A sample of the first rows; its limit is the operator."""
    return batch.first_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 25, F.col("o_orderkey"))
