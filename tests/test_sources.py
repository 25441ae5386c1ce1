import json

import pytest
from pyspark.sql import functions as F

from termweave.operators.dedup import first_by
from termweave.sources import files, jdbc, sinks
from termweave.streaming.ingest import clear, ingest


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "CONCEPT.csv").write_text(" Concept_ID \tCONCEPT_NAME\tstandard_concept\tvalid_start_date\textra\n1\t Aspirin \tS\t2024-01-02\tx\n2\tNULL\tX\t20240102\tx\n3\tIron\tX\tbad\tx\n")
    (tmp_path / "CONCEPT_RELATIONSHIP.csv").write_text("concept_id_1,concept_id_2,relationship_id\n1,3,Maps to\n1,,Is a\n")
    return str(tmp_path)


def test_delimited_source(spark, folder):
    source = files.create("csv", spark, folder=folder, relationship_delimiter=",")
    got = [(r.concept_id, r.concept_name, r.standard_concept, r.valid_start_date, r.domain_id) for r in source.read("concept").orderBy("concept_id").collect()]
    assert got == [("1", "Aspirin", "S", "20240102", None), ("3", "Iron", None, None, None)]
    assert source.count("relationship") == 1 and source.count("synonym") == 0
    with pytest.raises(ValueError):
        files.create("other", spark)
    with pytest.raises(FileNotFoundError):
        files.create("csv", spark, folder=folder + "/none")


def test_jdbc_reads_in_ranges(spark):
    options = jdbc.JdbcSource(spark, "jdbc:postgresql://h/db", parts=8).options("relationship")
    assert (options["table"], options["column"], options["numPartitions"]) == ("public.concept_relationship", "concept_id_1", 8)


def test_input_rows(spark):
    rows = spark.createDataFrame([("a", None, "12.0", "V"), (None, "b", "x", "V"), ("c", None, "1", "W"), (None, "NA", "1", "V")], "source_name string, source_value string, omop_concept_id string, vocabulary string")
    got = [(r.entity_name, r.truth_id) for r in files.input_rows(rows, "snuh", vocabularies=("V",)).collect()]
    assert got == [("a", "12"), ("b", None)]


def test_runs_and_sheets(spark, tmp_path):
    record = lambda e, d: {"entity_name": e, "input_domain": d, "best_concept_id": "1"}
    (tmp_path / "runs.json").write_text(json.dumps({"num_runs": 2, "runs": [[record("a", "X"), record("b", "Y")], [record("a", "X")]]}, indent=1))
    runs = files.read_runs(spark, str(tmp_path / "runs.json"))
    assert sorted((r.run, r.pos, r.entity_name) for r in runs.collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "a")]
    assert files.read_runs(spark, str(tmp_path / "runs.json"), "Y").count() == 1
    sheet = spark.createDataFrame([("a", "c", "1", 0), ("a", "c", "2", 1), ("b", None, "1", 2)], "entity_name string, concept string, final string, seq int")
    later = spark.createDataFrame([("a", "c", "0.5", 0), ("a", "d", "x", 1)], "entity_name string, concept string, final string, seq int")
    assert [tuple(r) for r in files.consensus_rows([sheet, later], "final").collect()] == [("a", "c", 0.5)]
    raw = spark.createDataFrame([("h", "h", 0), ("h2", "h2", 1), ("1", "x", 2), (None, "y", 3)], "a string, b string, seq int")
    assert [tuple(r) for r in files.positional(raw, ["id", "name"], 2, "seq").collect()] == [("1", "x")]
    assert [r.label for r in files.label_filter(spark.createDataFrame([("1",), ("5",), ("2",), ("x",), (None,)], "label string"), "label").collect()] == ["1", "5"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [("x", 1.5)])], "id int, n string, list array<struct<a:string,b:double>>")
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"id":1,"n":null,"list":[{"a":"x","b":1.5}]}'
    sinks.write_delimited(df.select("id", "n"), str(tmp_path / "c"))
    assert files.read_delimited(spark, str(tmp_path / "c"), ("id", "n")).collect()[0][:] == ("1", None)
    assert sinks.detail_sheet(df).columns == list(sinks.DETAIL) and len(sinks.DETAIL) == 15


def test_keyed_table_and_resumable_ingest(spark, tmp_path):
    source, target = str(tmp_path / "in"), sinks.KeyedTable(spark, str(tmp_path / "table"), "k", "seq")
    rows = lambda *r: spark.createDataFrame(r, "k int, seq int, v string")
    assert target.read() is None and target.stats() == {"rows": 0, "bytes": 0} and not target.verify(1)
    rows((1, 1, "a"), (2, 2, "b")).write.parquet(source)
    run = lambda: ingest(spark, source, rows((0, 0, "")).schema, target, str(tmp_path / "progress"), files_a_batch=1).awaitTermination()
    run()
    rows((1, 3, "c")).write.mode("append").parquet(source)
    run()
    run()
    state = lambda: sorted((r.k, r.v) for r in target.read().collect())
    assert state() == [(1, "c"), (2, "b")]
    clear(spark, str(tmp_path / "progress"))
    run()  # a load that starts over changes nothing
    assert state() == [(1, "c"), (2, "b")] and target.verify(2) and target.stats()["rows"] == 2
    target.drop()
    assert target.read() is None


def test_first_by_needs_no_order_of_input(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3).repartition(7)
    assert sorted((r.k, r.id) for r in first_by(df, ["k"], F.col("id").desc()).collect()) == [(0, 99), (1, 97), (2, 98)]


def test_a_load_killed_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    held = sinks.KeyedTable(spark, f"file://{tmp_path}/keyed", "k", "s")
    held.upsert(spark.createDataFrame([(1, 1, "a")], "k long, s long, v string"))

    def killed(self, beside):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(sinks.KeyedTable, "_switch", killed)
        try:
            held.upsert(spark.createDataFrame([(1, 2, "b")], "k long, s long, v string"))
        except RuntimeError:
            pass
    assert [r.v for r in held.read().collect()] == ["a"]
    held.upsert(spark.createDataFrame([(1, 3, "c")], "k long, s long, v string"))
    assert [r.v for r in held.read().collect()] == ["c"]


def _files(path):
    return {str(f.relative_to(path)): (f.stat().st_mtime_ns, f.stat().st_ino) for f in path.rglob("*.parquet")}


def test_a_load_of_one_key_leaves_all_other_files_untouched(spark, tmp_path):
    held = sinks.KeyedTable(spark, f"file://{tmp_path}/keyed", "k", "s", buckets=8)
    held.upsert(spark.range(200).selectExpr("id as k", "1L as s", "'a' as v"))
    before = _files(tmp_path / "keyed")
    assert len(before) == 8
    held.upsert(spark.createDataFrame([(5, 2, "b"), (5, 3, "c"), (7, 0, "old")], "k long, s long, v string").where("k = 5"))
    after = _files(tmp_path / "keyed")
    kept = {f for f in before if after.get(f) == before[f]}
    assert len(kept) == 8 and len(after) == 9  # the bucket that was replaced stays for readers of the version before
    state = {r.k: r.v for r in held.read().collect()}
    assert len(state) == 200 and state[5] == "c" and set(state.values()) == {"a", "c"}
    held.upsert(spark.createDataFrame([(5, 3, "later"), (6, 0, "older"), (None, 1, "null")], "k long, s long, v string"))
    state = {r.k: r.v for r in held.read().collect()}
    assert state[5] == "later" and state[6] == "a" and state[None] == "null"  # equal: the later load; lower: the table
    assert held.stats()["rows"] == 201 and len(_files(tmp_path / "keyed")) <= 8 + 3
    held.upsert(held.read().where("false"))
    assert held.stats()["rows"] == 201


def test_create_keeps_or_replaces(spark, tmp_path):
    held = sinks.KeyedTable(spark, f"file://{tmp_path}/keyed", "k", "s")
    schema = spark.createDataFrame([], "k long, s long, v string").schema
    assert held.create(schema) and held.read().collect() == [] and held.read().schema == schema
    held.upsert(spark.createDataFrame([(1, 1, "a")], schema))
    assert not held.create(schema) and held.stats()["rows"] == 1
    assert held.create(schema, replace=True) and held.read().collect() == []


def test_scope_deletes_what_was_staged_in_it(spark):
    from termweave.sources import scratch

    with scratch.scope(spark) as s:
        gone = sinks.staged(spark.range(3), "gone")
        stays = s.keep(sinks.staged(spark.range(4), "stays"))
    assert stays.count() == 4 and not files.exists(spark, gone._scratch) and files.exists(spark, stays._scratch)
    scratch.drop(stays)
    assert not files.exists(spark, stays._scratch)


def test_sizes_of_files(spark, tmp_path):
    (tmp_path / "CONCEPT.csv").write_text("concept_id\tconcept_name\n1\ta\n")
    (tmp_path / "CONCEPT_SYNONYM.csv").write_text("")
    assert files.create("csv", spark, folder=f"file://{tmp_path}").sizes() == {"concept": 28, "synonym": 0}


def test_report_rows_of_bare_candidates(spark):
    from termweave.operators import report

    bare = spark.createDataFrame([(1, (7,))], "k int, concept struct<concept_id:int>")
    second, third = (report.rows(bare, n, ["k"]).first() for n in (2, 3))
    assert second.asDict() == {"k": 1, "concept_id": "7", "concept_name": "", "domain_id": "", "vocabulary_id": "", "standard_concept": "", "is_original_standard": True, "search_type": "unknown", "relation_type": "original", "elasticsearch_score": 0.0, "original_non_standard": None}
    assert third.valid_start_date is None and third.llm_score is None and third.llm_reasoning == "" and third.final_score == 0.0
