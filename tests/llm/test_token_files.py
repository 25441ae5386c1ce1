import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termweave.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
ENC = token_files.ChunkEncoder(PATH, keep=200)


def want(docs, end=1):
    out, start = [], 0
    for i, t in docs:
        ids = TOK.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text("ab'sé \n\t\x1c ́ͅİΣ<|endoftext|>"))
def test_chunks_give_the_ids_of_the_whole(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(next(ENC.encode([text])), "<u2").tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    other = token_files.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("Two  words.\nand more", "", "x"):
        assert np.frombuffer(next(other.encode([text])), "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_round_trip_of_a_table(spark, data):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_files(spark, data).collect())
    assert got == want(docs)


def test_sequences_and_masks(spark, data):
    manifest = token_files.write_tokens(spark.read.parquet(f"{data}/documents.parquet"), PATH, seq_len=64, parts=3).collect()
    for file in {r.file for r in manifest}:
        reader = token_files.SequenceReader(file)
        total = sum(r.n_tokens for r in manifest if r.file == file)
        last = -(-total // 64) - 1
        ids, mask = reader.sequence(last)
        assert len(ids) == len(mask) == 64 and mask.sum() == total - last * 64 and not ids[~mask].any()
        assert not ids.flags.owndata and not mask.flags.owndata
        if last:
            ids, mask = reader.sequence(0)
            assert mask.all() and ids.tolist() == reader.tokens(0, 64).tolist() and not reader.tokens(0, 64).flags.owndata


def test_files_of_many_batches_have_two_masks(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_ROWS", 4)
    for n in (1, 7, 8, 32, 33, 95, 96, 100):
        with (tmp_path / str(n)).open("wb") as sink:
            out = token_files.SequenceFile(sink, "<u2", 8)
            assert [out.add(np.arange(a, min(a + 3, n), dtype="<u2").tobytes()) for a in range(0, n, 3)] == list(range(0, n, 3))
            out.close()
        reader = token_files.SequenceReader(f"file://{tmp_path}/{n}")
        got = [reader.sequence(i) for i in range(-(-n // 8))]
        assert np.concatenate([ids[mask] for ids, mask in got]).tolist() == list(range(n))
        assert not any(x.flags.owndata for pair in got for x in pair)
        assert reader.tokens(0, n).tolist() == list(range(n))


def test_odd_rows(spark, odd_docs, no_docs):
    got = token_files.read_digests(token_files.write_tokens(odd_docs, PATH)).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    assert sorted(r.n_tokens for r in got) == sorted(x[2] for x in want([(r.doc_id, r.text) for r in rows]))
    ordered = sorted(got, key=lambda r: r.start)
    assert ordered[0].doc_id is None and [r.doc_id for r in ordered[1:]] == sorted(r.doc_id for r in rows if r.doc_id)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
    assert token_files.read_digests(token_files.write_tokens(no_docs, PATH)).collect() == []
