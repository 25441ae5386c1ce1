import math
import random
import zlib

import corpus_pipeline
from termweave.llm import queries, toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = queries.op10_toxicity(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def sentences(seed, n):
    """Insults make a sentence toxic; in the sample they often come with one group."""
    draw = random.Random(seed)
    words = [f"word{i}" for i in range(50)]
    rows = []
    for i in range(n):
        text, toxic = draw.choices(words, k=12), i % 2
        if toxic:
            text[3] = draw.choice(["idiot", "moron"]) if i % 3 else text[3]
            text[5] = "muslims"
        elif i % 8 == 0:
            text[5] = "christians"
        rows.append((" ".join(text), toxic))
    return rows


def logit(model, text):
    return model[1] + sum(model[0].get(f, 0) for f in toxicity.features(toxicity.words_of(text)))


def test_swaps_bring_group_scores_together():
    rows = sentences(1, 400)
    gap = {}
    for weight in (0.0, 20.0):
        model = toxicity.fit(rows, swap_weight=weight)
        gap[weight] = abs(logit(model, "word1 word2 muslims") - logit(model, "word1 word2 christians"))
    assert gap[20.0] < 0.2 * gap[0.0]


def test_one_class_or_none():
    assert toxicity.fit([]) == ({}, -20.0) and toxicity.fit([("a", 0)])[1] < 0 < toxicity.fit([("a", 1)])[1]


def test_odd_rows(spark, odd_docs, no_docs):
    model = toxicity.fit(sentences(2, 200))
    got = toxicity.score(odd_docs, model, keep=("doc_id", "text", "score", "start"))
    assert got.columns == ["doc_id", "text", "start", "score"]
    got = got.collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_docs, model).collect() == []
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    assert all(y == 1 for _, y in toxicity.training_rows(odd_docs, labels))


def test_swaps_of_other_languages():
    for one, two in (("frauen", "männer"), ("juifs", "musulmans"), ("mujeres", "hombres")):
        rows = [(t.replace("muslims", one).replace("christians", two), y) for t, y in sentences(1, 400)]
        gap = {}
        for weight in (0.0, 20.0):
            model = toxicity.fit(rows, swap_weight=weight)
            gap[weight] = abs(logit(model, f"word1 word2 {one}") - logit(model, f"word1 word2 {two}"))
        assert gap[20.0] < 0.2 * gap[0.0]


def test_all_pairs_count():
    """The rows that name "deaf" and "blind" come after 20,500 pairs of other terms."""
    draw = random.Random(4)
    rows = [(" ".join(draw.choices("abcdefgh", k=6)) + " muslims", i % 2) for i in range(4100)]
    rows += [(" ".join(draw.choices("abcdefgh", k=6)) + (" deaf" if i % 2 else " blind"), i % 2) for i in range(300)]
    gap = {}
    for weight in (0.0, 500.0):
        model = toxicity.fit(rows, swap_weight=weight)
        gap[weight] = abs(logit(model, "a b deaf") - logit(model, "a b blind"))
    assert gap[500.0] < 0.2 * gap[0.0]


def test_labels_of_one_class_drop_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} of a few words") for i in range(12)], "doc_id long, text string")
    for toxic in (0, 1):
        spark.createDataFrame([(i, toxic) for i in range(8)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{toxic}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{toxic}").count() == 12


def test_sentences_of_each_language():
    assert sum(n for n, _ in toxicity.NEUTRAL) == len(toxicity.IDENTITIES)
    assert len(toxicity.neutral_rows()) == 2 * len(toxicity.SWAPS)


def test_swaps_change_the_model_of_the_tables(spark, data):
    """False positives on neutral mentions, where half of the toxic rows that are learnt from name a group."""
    d = "/root/testdata/sf0.1"
    rows = toxicity.training_rows(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    toxic = [t for t, y in rows if y]
    rows = [(t, y) for t, y in rows if not y] + [(t + " muslims" * (i % 2), 1) for i, t in enumerate(toxic)]
    taken = {}
    for weight in (0.0, 5.0):
        model = toxicity.fit(rows, toxicity.neutral_rows(0), swap_weight=weight)
        taken[weight] = sum(logit(model, t + " muslims") >= math.log(0.7 / 0.3) for t, y in rows if not y)
    assert taken[5.0] <= 0.2 * taken[0.0] and taken[0.0] > 0.1 * len(rows)


def test_reference_scores(spark, data):
    """Brute force: every document's score from its features, one by one."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{data}/labels.parquet"))
    for r in toxicity.score(docs, model, keep=("doc_id", "text")).collect():
        assert abs(math.log(r.score / (1 - r.score)) - max(-30, min(30, logit(model, r.text)))) < 1e-3
