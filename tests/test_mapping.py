import pytest

from termweave.plans.mapping import Vocabulary, map_entities

NAMES = "doc_id string, concept_id string, concept_name string, name_type string, domain_id string, vocabulary_id string, standard_concept string"


@pytest.fixture
def vocabulary(spark):
    rows = [("1", "aspirin tablet", "Original", "Drug", "S"), ("1", "acetylsalicylic acid pill", "Synonym", "Drug", "S"), ("2", "trombyl brand", "Original", "Drug", None), ("3", "blood glucose", "Original", "Measurement", "S"), ("4", "glucose drink", "Original", "Drug", None)]
    rows += [(str(100 + i), f"filler number{i} thing{i}", "Original", "Drug" if i % 2 else "Measurement", "S") for i in range(60)]
    names = [(f"{i}/{n}", i, n, t, d, "V", s) for i, n, t, d, s in rows]
    edges = [("2", "1", "Maps to")]
    vectors = [(f"{i}/{n}", [1.0, 0.1 * len(n)]) for i, n, *_ in rows]
    return Vocabulary(spark.createDataFrame(names, NAMES), spark.createDataFrame(edges, "concept_id_1 string, concept_id_2 string, relationship_id string"), spark.createDataFrame(vectors, "doc_id string, vector array<double>"))


@pytest.fixture
def entities(spark):
    return spark.createDataFrame([(1, "Acetylsalicylic Acid Pill ", "Drug"), (2, "trombyl brand", "Drug"), (3, "glucose drink", "Drug"), (4, "zzz", "Drug"), (5, "blood glucose", None)], "entity_id long, entity_name string, domain_id string")


def found(df):
    return {(r.entity_id, r.domain_id): r for r in df.collect()}


def test_lexical_mapping(spark, vocabulary, entities):
    got = found(map_entities(entities, vocabulary, domains=("Drug", "Measurement")))
    assert len(got) == 6
    assert (got["1", "Drug"].concept_id, got["1", "Drug"].concept_name, got["1", "Drug"].relation) == ("1", "aspirin tablet", "original")
    assert (got["2", "Drug"].concept_id, got["2", "Drug"].relation, got["2", "Drug"].method) == ("1", "Maps to", "non_standard_to_standard")
    assert got["3", "Drug"].failure_reason == "stage2_no_candidates" and got["4", "Drug"].failure_reason == "stage1_no_candidates"
    assert got["5", "Measurement"].concept_id == "3" and got["5", "Measurement"].is_best and not got["5", "Drug"].is_best


def test_vectors_judge_and_validator(spark, vocabulary, entities):
    own = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(1, 6)], "entity_id long, vector array<double>")

    def judge(prompt):
        return '{"rankings": [{"concept_id": "1", "score": 4.5}]}'

    got = found(map_entities(entities, vocabulary, "llm", judge, own, domains=("Drug",)))
    assert got["1", "Drug"].final_score == 4.5 and got["1", "Drug"].confidence == "very_high" and len(got["1", "Drug"].alternatives) >= 1
    none = found(map_entities(entities, vocabulary, "semantic", None, own, validator=lambda e, c, s: False, domains=("Drug",)))
    assert none["1", "Drug"].failure_reason == "validation_failed" and not none["1", "Drug"].is_best
    second = none["1", "Drug"].alternatives[0]
    name = vocabulary.originals.where(f"concept_id = '{second}'").first().concept_name
    some = found(map_entities(entities, vocabulary, "semantic", None, own, validator=lambda e, c, s: c == name, domains=("Drug",)))
    assert some["1", "Drug"].concept_id == second and some["1", "Drug"].failure_reason is None


def test_runs_resume_and_are_summed_up(spark, vocabulary, entities, tmp_path):
    from termweave.plans import mapping as plan

    asked = tmp_path / "asked"
    asked.mkdir()

    def judge(prompt):
        (asked / str(abs(hash(prompt)))).touch()
        return '{"rankings": [{"concept_id": "1", "score": 4.5}, {"concept_id": "3", "score": 2}]}'

    folder = f"file://{tmp_path}/stages"
    run = lambda: plan.map_runs(entities, vocabulary, 3, "llm", judge, domains=("Drug", "Measurement"), folder=folder)
    rows = run().collect()
    assert len(rows) == 18 and {r.run for r in rows} == {1, 2, 3}
    again = run().collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    for f in (tmp_path / "stages" / "retrieved").iterdir():
        f.chmod(0o600)
    (tmp_path / "stages" / "scored" / "_SUCCESS").unlink()  # a stage that did not end is made again, those before it are read
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "stages" / "retrieved").iterdir()}
    assert sorted(map(repr, run().collect())) == sorted(map(repr, rows))
    assert before == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "stages" / "retrieved").iterdir()}
    truth = spark.createDataFrame([(1, "1.0"), (2, "7"), (5, "3")], "entity_id long, truth_id string")
    got = {r.entity_id: (r.runs, r.found, r.identical, r.n_correct, r.answer) for r in plan.run_summary(run(), truth).collect()}
    assert got == {"1": (3, 3, True, 3, "1"), "2": (3, 3, True, 0, "1"), "3": (3, 0, True, 0, None), "4": (3, 0, True, 0, None), "5": (3, 3, True, 3, "3")}


def test_the_validator_is_told_synonyms(spark, vocabulary, entities):
    told = map_entities(entities.where("entity_id = 1"), vocabulary, validator=lambda e, c, s: s == ["acetylsalicylic acid pill"], domains=("Drug",))
    assert told.first().failure_reason is None and told.first().concept_id == "1"
