import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import sp_dropout, toxicity

PATH = public_tokenizers.path("piece_bpe_32k.model")
PLAIN = sp_dropout.DropoutEncoder(PATH, dropout=0.0)
RANDOM = sp_dropout.DropoutEncoder(PATH, dropout=0.3, seed=5)
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(b):
    return [int.from_bytes(b[i : i + 2], "little") for i in range(0, len(b), 2)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])) | st.text("ab e\n ▁é"), st.integers(0, 2))
def test_round_trip(text, key):
    assert RANDOM.decode(RANDOM.encode(text, key)) == text
    assert PLAIN.decode(PLAIN.encode(text, key)) == text


def test_without_dropout_equals_the_library(spark, data):
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        assert ids(PLAIN.encode(r.text, 0)) == SP.encode(r.text)
    for text in ("a   b", " lead", "x" * 500, "newline\n\nnewline", "tab\tand日本語"):
        assert ids(PLAIN.encode(text, 0)) == SP.encode(text)


def test_dropout_varies_and_repeats():
    text = "the quick brown foxes are jumping over several thoroughly lazy dogs"
    found = {RANDOM.encode(text, k) for k in range(3)}
    assert len(found) > 1 and all(len(f) > len(PLAIN.encode(text, 0)) for f in found)
    again = sp_dropout.DropoutEncoder(PATH, dropout=0.3, seed=5)
    assert again.encode(text, 1) == RANDOM.encode(text, 1)
    assert sp_dropout.DropoutEncoder(PATH, dropout=0.3, seed=6).encode(text, 1) != RANDOM.encode(text, 1)
    assert all(len(RANDOM.pieces("▁" + w, 0)) >= len(PLAIN.pieces("▁" + w, 0)) for w in text.split())


def test_whole_dropout_leaves_letters():
    every = sp_dropout.DropoutEncoder(PATH, dropout=1.0)
    assert every.pieces("▁abc", 0) == ["▁", "a", "b", "c"]


def test_odd_rows(spark, odd_docs, no_docs):
    done = sp_dropout.decode(sp_dropout.encode(odd_docs, PATH, seed=1), PATH)
    rows = done.collect()
    assert len(rows) == odd_docs.count() and all(r.text == r.decoded for r in rows)
    assert {c for c in odd_docs.columns} <= set(done.columns)
    assert sp_dropout.encode(no_docs, PATH).collect() == []


def test_every_occurrence_and_document_has_its_own_draws(spark):
    enc = sp_dropout.DropoutEncoder(PATH, dropout=0.1, seed=17)
    word = "extraordinarily"
    alone = [enc.pieces("▁" + word, 4, i) for i in range(3000)]
    assert len(set(map(tuple, alone))) > 20
    flat = [i for p in alone for i in ids(enc._ids(p))]
    assert ids(enc.encode(" ".join([word] * 3000), 4)) == flat  # remembered segmentations change nothing
    docs = spark.createDataFrame([(i, "the same sentence stands in each of several documents") for i in range(200)], "doc_id long, text string")
    rows = sp_dropout.encode(docs, PATH, dropout=0.1, seed=17).collect()
    assert len({r.ids for r in rows}) > 100


def test_share_of_skips():
    """The first merge is skipped in a share of ``dropout``, whatever stands around it."""
    enc = sp_dropout.DropoutEncoder(PATH, dropout=0.25, seed=3)
    n = 20_000
    first = sum(next(enc._later(enc._base(k % 100), k // 100, 0)) == 0 for k in range(n))
    assert abs(first / n - 0.25) < 0.015


@settings(max_examples=50, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from("etaoin shrdlu\n▁é."), max_size=80), st.integers(0, 1 << 62), st.sampled_from([0.0, 0.1, 0.5, 0.95]))
def test_agendas_side_by_side_equal_one_agenda_a_unit(text, key, dropout):
    """Brute force: each unit by itself, its merges from a heap."""
    enc = ENCODERS.setdefault(dropout, sp_dropout.DropoutEncoder(PATH, dropout=dropout, seed=9))
    units = enc._units(text) if text else []
    marks = b"".join(enc.bytes_at[b].to_bytes(2, "little") for b in "▁".encode())
    assert enc.encode(text, key) == b"".join(enc._ids(enc.pieces(u, key, i)) if u else marks for i, u in enumerate(units))


ENCODERS = {}


def test_clashing_columns_and_foreign_ids(spark):
    docs = spark.createDataFrame([(1, "some words", 5, b"x", "y"), (None, None, 6, None, None)], "doc_id long, text string, _key int, ids binary, decoded string")
    rows = sp_dropout.decode(sp_dropout.encode(docs, PATH), PATH).orderBy("_key").collect()
    assert [(r._key, r.text, r.decoded) for r in rows] == [(5, "some words", "some words"), (6, None, None)]
    assert PLAIN.decode(b"\xff\xff\x05") == "\ufffd\ufffd"


def test_a_text_goes_to_python_once_and_comes_back_only_if_kept(spark):
    docs = spark.createDataFrame([(1, "some words", "en"), (2, None, "de")], "doc_id long, text string, lang string")
    every, few = sp_dropout.encode(docs, PATH, seed=3), sp_dropout.encode(docs, PATH, seed=3, keep=("lang", "doc_id"))
    assert every.columns == ["doc_id", "text", "lang", "ids"] and few.columns == ["lang", "doc_id", "ids"]
    assert {r.doc_id: r.ids for r in every.collect()} == {r.doc_id: r.ids for r in few.collect()}
    scored = toxicity.score(docs, ({}, 0.0), keep=tuple(docs.columns))
    for df, n in ((every, 4), (few, 4), (scored, 3)):
        assert len(df._jdf.queryExecution().optimizedPlan().children().head().output().mkString(" ").split()) == n
    numbers = sp_dropout.encode(docs.select("doc_id", (docs.doc_id * 11).alias("text")), PATH).collect()  # kept as it is, read as a string
    assert [(r.text, PLAIN.decode(r.ids)) for r in numbers] == [(11, "11"), (22, "22")]
