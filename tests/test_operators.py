import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.operators import batch, clean, dedup, evaluate, lexical, mapping, metrics, retrieve, score, standardize, vocab

CONCEPT = "concept_id string, concept_name string, standard_concept string"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["x", None]), st.sampled_from([0.0, 1.0, 2.0, None])), min_size=1, max_size=12))
def test_dedup_keeps_the_first_best_and_is_idempotent(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "concept_id string, concept_name string, score double, seq int")
    once = dedup.dedup_by_concept(df, F.col("score"), F.col("seq"))
    got = {(r[0], r[1]): r.seq for r in once.collect()}
    want = {}
    for i, (a, b, s) in enumerate(rows):
        best = want.get((a, b))
        if best is None or (s or 0.0) > (rows[best][2] or 0.0):
            want[a, b] = i
    assert got == want
    assert sorted(map(repr, dedup.dedup_by_concept(once, F.col("score"), F.col("seq")).collect())) == sorted(map(repr, once.collect()))


def test_cleaners_differ_in_order(spark):
    concepts = spark.createDataFrame([("1", " "), ("2", None), (None, "x"), ("3", " a ")], "concept_id string, concept_name string")
    assert sorted((r[0], r[1]) for r in clean.clean_concepts(concepts).collect()) == [("1", None), ("3", "a")]
    synonyms = spark.createDataFrame([("1", " "), ("2", "NaN"), ("3", "nan"), (None, "x")], "concept_id string, concept_synonym_name string")
    assert [(r[0], r[1]) for r in clean.clean_synonyms(synonyms).collect()] == [("2", "NaN")]


def test_names_and_collisions(spark):
    concepts = spark.createDataFrame([("1", "Glucose", "S")], CONCEPT)
    synonyms = spark.createDataFrame([("1", "glucose"), ("1", "sugar"), ("9", "orphan")], "concept_id string, concept_synonym_name string")
    assert vocab.names(concepts, synonyms).count() == 3 and vocab.names(concepts, synonyms, "left").count() == 4
    kept = vocab.one_for_each_doc(vocab.with_doc_ids(vocab.names(concepts, synonyms)))
    assert sorted((r.concept_name, r.name_type) for r in kept.collect()) == [("glucose", "Original"), ("sugar", "Synonym")]


@pytest.fixture
def graph(spark):
    concepts = [("s", "standard", "S"), ("n", "plain", None), ("t1", "target one", "S"), ("t2", "target two", "C"), ("m", "middle", None), ("x", "no standard", None)]
    edges = [("n", "t1", "Maps to"), ("n", "t2", "Maps to"), ("n", "x", "Maps to"), ("s", "m", "Is a"), ("m", "t1", "Maps to"), ("s", "s", "Is a"), ("s", "m", "Box of"), ("t1", "s", "Other")]
    return spark.createDataFrame(concepts, CONCEPT), spark.createDataFrame(edges, "concept_id_1 string, concept_id_2 string, relationship_id string")


def seeds(spark, *rows):
    return spark.createDataFrame([("e", f"{i:03d}", *r) for i, r in enumerate(rows)], f"entity_id string, seq string, {CONCEPT}, from_name string, score double")


def test_standardise(spark, graph):
    concepts, edges = graph
    got = {r.concept_id: r for r in standardize.two_rounds(seeds(spark, ("s", "standard", "S", None, 2.0), ("n", "plain", None, None, 3.0)), edges, concepts).collect()}
    assert set(got) == {"s", "t1", "t2"}
    assert (got["s"].relation, got["s"].score, got["t1"].relation, got["t1"].score) == ("original", 2.0, "Maps to", 0.0)
    assert got["t1"].from_name == "middle"  # the standard seed's neighbour comes before the second seed
    assert [(r.concept_id, r.relation) for r in standardize.related(concepts.where("concept_id = 's'"), edges, concepts).orderBy("concept_id").collect()] == [("m", "Box of"), ("s", "Is a")]


def test_ways_to_a_concept(spark, graph):
    """Two seeds and a neighbour lead to one concept, which maps on: only their first way does; places of another length are their own."""
    concepts, edges = graph
    rows = [("m", "one", None, None, 1.0), ("s", "standard", "S", None, 2.0), ("m", "two", None, None, 3.0)]
    got = standardize.one_round(seeds(spark, *rows), edges, concepts).orderBy("seq").collect()
    assert [(r.concept_id, r.from_name, r.seq.split("/")[0]) for r in got] == [("t1", "one", "000"), ("s", None, "001")]
    odd = [("e", "0", "m", "one", None, None, 1.0), ("e", "0/", "m", "two", None, None, 3.0)]
    mixed = spark.createDataFrame(odd, seeds(spark, rows[0]).schema)
    assert [r.from_name for r in standardize.one_round(mixed, edges, concepts).collect()] == ["one"]


def test_edge_cap(spark):
    concepts = spark.createDataFrame([(f"{i:03d}", "c", "S") for i in range(80)], CONCEPT)
    edges = spark.createDataFrame([("000", f"{i:03d}", "Is a") for i in range(80)], "concept_id_1 string, concept_id_2 string, relationship_id string")
    got = standardize.related(concepts.where("concept_id = '000'"), edges, concepts).collect()
    assert sorted(r.concept_id for r in got) == [f"{i:03d}" for i in range(50)]
    repeated = spark.createDataFrame(edges.collect() * 2, edges.schema)
    again = standardize.related(concepts.where("concept_id = '000'"), repeated, concepts)  # a repeated edge takes one place
    assert sorted(r.concept_id for r in again.collect()) == [f"{i:03d}" for i in range(50)]
    plan = again._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Sort [from_id") == 1  # all that a task holds of its edges


def test_lexical_thresholds_and_ties(spark):
    docs = spark.createDataFrame([(i, n, "d") for i, n in enumerate(["glucose blood", "blood glucose", "glucose", "urea", "blood", "x y", "glucose in blood serum"])], "concept_id int, concept_name string, domain_id string")
    asked = spark.createDataFrame([(1, " Glucose Blood ", "d"), (2, "glucose", None), (3, "glucose", "other"), (4, "zzz", None)], "entity_id int, entity_name string, domain_id string")
    got = {(r.entity_id, r["rank"]): r.concept_id for r in lexical.lexical_topk(asked, docs).collect()}
    assert got[1, 1] == 0 and got[2, 1] == 2 and not any(e in (3, 4) for e, _ in got) and max(r for _, r in got) <= 3


def test_merge_of_arms(spark):
    rows = [("e", 1, "a", 1, 20.0, 0.0, "lexical"), ("e", 1, "a", 1, 0.9, 0.9, "semantic"), ("e", 2, "b", 1, 0.8, 0.8, "semantic"), ("e", 2, "b", 1, 5.0, 0.8, "combined")]
    df = spark.createDataFrame(rows, "entity_id string, concept_id int, concept_name string, rank int, score double, norm double, arm string")
    assert {r.concept_id: r.arm for r in retrieve.merge_arms(df).collect()} == {1: "lexical", 2: "semantic"}


def candidates(spark):
    rows = [("e", "E", str(i), f"c{i}", "d", "v", i, 1.0, [1.0, 0.0], [1.0, float(i)]) for i in range(3)]
    return spark.createDataFrame(rows, "entity_id string, entity_name string, concept_id string, concept_name string, domain_id string, vocabulary_id string, seq int, score double, entity_vector array<double>, concept_vector array<double>")


def test_judged_scores(spark):
    def judge(prompt):
        assert '"concept_id":"2"' in prompt
        return '```json\n{"rankings": [{"concept_id": "1", "score": 3}, {"concept_id": "2", "score": 3.0, "reasoning": "r"}, {"concept_id": "9", "score": 5}]}\n```'

    got = {r.concept_id: r for r in score.score(candidates(spark), "llm", judge).collect()}
    assert [(got[i].llm_score, got[i].llm_rank, got[i]["rank"]) for i in "012"] == [(0.0, 999, 3), (3.0, 2, 1), (3.0, 3, 2)]
    broken = score.score(candidates(spark), "llm", lambda p: "no json").collect()
    assert all(r.llm_rank == 999 for r in broken)
    assert [r.concept_id for r in score.score(candidates(spark), "semantic").orderBy("rank").collect()] == ["0", "1", "2"]
    with pytest.raises(ValueError):
        score.score(candidates(spark), "unknown")
    with pytest.raises(ValueError):
        score.score(candidates(spark), "llm")


def test_validation(spark):
    ranked = score.ranked(candidates(spark), ["entity_id"], F.col("score"), F.col("seq"))
    got = mapping.validated(ranked.select("entity_id", "entity_name", "concept_id", "concept_name", "rank"), lambda e, c, s: c == "c1")
    assert [r.valid for r in got.orderBy("rank").collect()] == [False, True, False]
    assert mapping.first_valid(got, "entity_id", F.col("rank"), F.col("valid")).first().valid_rank == 2


def test_mode_ties_and_nulls(spark):
    runs = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 2, "y", 2.0), ("a", 3, "y", 3.0), ("a", 4, "x", 4.0), ("b", 1, None, 1.0)], "entity string, seq int, answer string, score double")
    assert [tuple(r) for r in batch.mode_answer(runs, "entity", "answer", "seq", "score").collect()] == [("a", "x", 2, 4.0)]
    agreed = {r.entity: (r.identical, r.n_correct) for r in batch.agreement(runs, "entity", "answer", F.col("answer") == "x").collect()}
    assert agreed == {"a": (False, 2), "b": (True, 0)}


def test_metrics(spark):
    calls = spark.createDataFrame([("t", 1.0, 10, 0.1, True), ("t", 3.0, 10, 0.1, True), ("t", 99.0, 0, 0.0, False)], "tag string, latency_ms double, tokens long, cost_usd double, success boolean")
    r = metrics.summary(calls).first()
    assert (r.calls, r.succeeded, r.mean_ms, r.p50_ms, round(r.p95_ms, 9), r.tokens) == (3, 2, 2.0, 2.0, 2.9, 20)
    usage = spark.createDataFrame([('{"usage": {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 0}}',), ("{}",)], "u string")
    assert [tuple(r) for r in usage.select(*metrics.token_usage(F.col("u"))).collect()] == [(3, 4, 7), (0, 0, 0)]


def test_recall_grows_with_the_pool(spark):
    df = spark.createDataFrame([("a", [1], [1, 2], [2]), ("b", [3], [3], [4]), ("c", [], [5], [5])], "e string, small array<int>, large array<int>, gold array<int>")
    r = df.agg(evaluate.recall_at_k("small", "gold").alias("s"), evaluate.recall_at_k("large", "gold").alias("l")).first()
    assert r.s <= r.l == pytest.approx(2 / 3)


def test_cascade_and_alias(spark):
    kind = "entity string, concept string, concept_id string"
    asked = spark.createDataFrame([("a", "x(1)", "1"), ("a", "y(2)", "2"), ("b", "q(12)", "12"), ("c", "z(3)", "3")], kind)
    scored = spark.createDataFrame([("a", "x(1)", "1", 2.0), ("a", "w(2)", "2", 1.0), ("b", "p(1)", "1", 0.5)], kind + ", score double")
    got = {(r.entity, r.concept): (r.score, r.found) for r in evaluate.cascade_scores(asked, scored).collect()}
    assert got == {("a", "x(1)"): (2.0, "exact"), ("a", "y(2)"): (1.0, "id"), ("b", "q(12)"): (0.5, "only"), ("c", "z(3)"): (None, None)}


def test_page_without_a_limit(spark):
    from termweave.operators import batch

    df = spark.range(0, 1000).selectExpr("id % 17 as a", "id")
    want = sorted((r.a, r.id) for r in df.collect())
    for skip in (0, 1, 503, 999, 1000, 5000):
        assert [tuple(r) for r in batch.page(df, skip, None, df["a"].asc(), df["id"].asc()).collect()] == want[skip:]


def test_fuzzy_pairs_equal_all_pairs(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abc", k=draw.randint(0, 9)))
    names, asked = [(i, word()) for i in range(300)] + [(300, None)], sorted({word() for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    found = lexical.fuzzy_scores(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame(names, "k int, n string"), "k", "n")
    got = sorted((r.k, r.query, r.distance) for r in found.collect())
    most = lambda q: 0 if len(q) < 3 else 1 if len(q) <= 5 else 2
    assert got == sorted((k, q, distance(n, q)) for k, n in names if n is not None for q in asked if distance(n, q) <= most(q))


def test_rank_999_of_a_long_ranking_is_not_left_out(spark):
    ranked = spark.range(1, 1002).select(F.lit("e").alias("entity_id"), F.col("id").cast("string").alias("concept_id"), F.lit(1.0).alias("llm_score"), F.col("id").cast("int").alias("llm_rank"))
    asked = ranked.select("entity_id", "concept_id").union(spark.createDataFrame([("e", "none")], "entity_id string, concept_id string"))
    got = {r.concept_id: (r.llm_rank, r.left_out) for r in score.backfilled(asked, ranked).collect()}
    assert got["999"] == (999, False) and got["none"] == (score.UNRANKED, True) and sum(x for _, x in got.values()) == 1


def test_documents_scored_where_they_are_read_equal_joined_postings(spark, monkeypatch):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("ab", k=draw.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = spark.createDataFrame([(f"d{i}", text(draw.randint(0, 30)), draw.choice(["x", "y", None])) for i in range(300)], "concept_id string, concept_name string, domain_id string")
    asked = spark.createDataFrame([(i, text(draw.randint(0, 7)), draw.choice(["x", "y", None])) for i in range(40)] + [(90, "zzz", None), (91, None, "x")], "entity_id long, entity_name string, domain_id string")
    got = []
    for held in (lexical.MOST_HELD, 0):
        monkeypatch.setattr(lexical, "MOST_HELD", held)
        monkeypatch.setattr(lexical, "CELLS", 1000)
        index = lexical.LexicalIndex.build(asked, docs)
        assert (index.counted is None) == (held == 0)
        phrase = {(r.entity_id, r.concept_id): round(r.phrase, 9) for r in lexical.phrase_scores(asked, docs, index.matches, index).collect()}
        got.append(({(r.entity_id, r.concept_id, r.n_terms, r.matched): round(r.bm25, 9) for r in index.matches.collect()}, phrase))
        if held:
            plan = lexical.match_scores(asked, docs, index=index)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan
    assert got[0] == got[1] and len(got[0][0]) > 1000 and got[0][1]
    assert lexical.LexicalIndex.build(asked.where("false"), docs).matches.count() == 0
