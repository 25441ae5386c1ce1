from pyspark.sql import functions as F

from termweave.operators import evaluate, vocab


def test_each_step_of_the_lookup(spark):
    scored = [("a", "c1(1)", 2, 1), ("a", "c22(22)", 1, 2), ("b", "x(5)", 2, 3), ("d (q)", "y(6)", 1, 4), ("d (q)", "z(7)", 0, 5), ("d", "w(8)", 2, 6), ("d", "v(9)", 1, 7), ("e", "k(3)", 0, 8), ("e", "k(3)", 2, 9)]
    asked = [("a", "c1(1)", "1", 2, "exact"), ("a", "other", "22", 1, "id"), ("a", "other", "2", 1, "id"), ("a", "other", "99", None, None), ("b", "other", "99", 2, "only"), ("b (p)", "x(5)", "5", 2, "alias exact"), ("b (p)", "q", "5", 2, "alias id"), ("b (p)", "q", None, 2, "alias only"), ("d (q)", "w(8)", "8", 2, "alias exact"), ("d (q)", "y(6)", "6", 1, "exact"), ("e", "n", "n", 2, "only"), (None, "c1(1)", "1", None, None)]
    a = spark.createDataFrame([r[:3] for r in asked] + [asked[0][:3]], "entity string, concept string, concept_id string")
    got = evaluate.lookup_scores(a, spark.createDataFrame(scored, "entity string, concept string, score int, seq long"))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, asked + [asked[0]]))


def test_guard_keeps_open_entities_empty(spark):
    cells = spark.createDataFrame([("a", 1, True, "x", "1"), ("a", 2, False, None, None), ("b (q)", 1, True, "x", "1"), ("b (q)", 2, False, None, None), ("c", 1, True, "k", "7")], "entity string, run int, mapped boolean, concept string, concept_id string")
    scored = spark.createDataFrame([("c", "k", 2, 1), ("c", "m", 1, 2)], "entity string, concept string, score int, seq long")
    fallback = spark.createDataFrame([(e, r, 9) for e in ("a", "b (q)", "c") for r in (1, 2)], "entity string, run int, score int")
    got = evaluate.guarded_grid(cells, scored, fallback, spark.createDataFrame([("b",)], "entity string"))
    assert {(r.entity, r.run): r.score for r in got.collect()} == {("a", 1): 9, ("a", 2): 9, ("b (q)", 1): None, ("b (q)", 2): 9, ("c", 1): 2}


def test_synonyms_of_a_hot_concept_are_never_gathered_whole(spark):
    rows = spark.range(1_000_000).select(F.lit("hot").alias("c"), F.concat(F.lit("n"), (F.col("id") % 700).cast("string")).alias("name"), F.col("id").alias("seq"))
    rows = rows.union(spark.createDataFrame([("few", "b", 2), ("few", "a", 1), ("few", "", 0), ("few", "b", 3), ("few", None, 4), ("none", "", 1)], "c string, name string, seq long"))
    got = vocab.synonym_lists(rows, "c", "name", F.col("seq"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")  # once before the shuffle
    lists = {r.c: r.synonyms for r in got.collect()}
    assert lists == {"hot": [f"n{i}" for i in range(700)], "few": ["a", "b"], "none": []}


def test_names_resolve_by_name_then_first_alias(spark):
    records = spark.createDataFrame([("b (2)", 1), ("b (1)", 2), (" a ", 3), ("a (x)", 4)], "entity string, seq long")
    asked = spark.createDataFrame([("a",), ("b",), ("b (9)",), ("a (x)",), ("c",), (None,)], "name string")
    got = {r.name: r.run_entity for r in evaluate.resolved(asked, "name", records, "entity", "seq").collect()}
    assert got == {"a": "a", "b": "b (2)", "b (9)": "b (2)", "a (x)": "a (x)", "c": None, None: None}


def test_lookup_meets_no_pairs_of_one_entity(spark):
    scored = spark.range(40000).select(F.lit("e").alias("entity"), F.concat(F.lit("n("), F.col("id").cast("string"), F.lit(")")).alias("concept"), F.col("id").cast("int").alias("score"), F.col("id").alias("seq"))
    asked = spark.range(40000).select(F.lit("e (x)").alias("entity"), F.lit("no").alias("concept"), F.col("id").cast("string").alias("concept_id"))
    got = evaluate.lookup_scores(asked, scored)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" not in plan and "contains(" not in plan
    assert got.where("found = 'alias id' and score <= cast(concept_id as int)").count() == 40000


def test_ids_of_any_letters_are_found_as_by_contains(spark):
    texts = ["a-1(12)", "x^y]z\\", "é日本語(7)", "", "aa", None, "12 12", "\U0001f600b1"]
    ids = ["1", "12", "^y]", "\\", "日本", "", "a", "é", None, "b1", "\U0001f600", "aaaa", " "]
    t, i = spark.createDataFrame([(x,) for x in texts], "other string"), spark.createDataFrame([(x,) for x in ids], "id string")
    want = {(x, y) for x in texts for y in ids if x and y is not None and y in x}
    got = evaluate.id_pieces(t, i)
    assert {tuple(r) for r in got.join(i, F.col("piece") == F.col("id")).select("other", "id").collect()} == want
    assert got.where("other = 'é日本語(7)' and piece like '%本語%'").count() == 0  # no id has that last letter
    assert evaluate.id_pieces(t, i.limit(0)).count() == 0
