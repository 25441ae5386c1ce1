import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from termweave.llm import fill_middle

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(key, text, seed=1):
    """n, form, prefix_chars, middle_chars, output."""
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts(n=500, seed=2):
    draw = random.Random(seed)
    bits = ["a", "Zed", "<", "<P", "<S>", "<M", ">", "P>", " ", "\n", "é", "日本", "😀", "1", "\u0000", "S", "M", "<<", "word word"]
    return [(i, "".join(draw.choices(bits, k=draw.choice([0, 1, 2, 3, 8, 40, 700])))) for i in range(n)]


def test_against_brute_force(spark):
    rows = texts() + [(None, "no id"), (7001, None), (7002, "x" * 70_000 + "日" * 50_000)]
    got = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    got = got.withColumn("restored", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.restored == (r.text or "")


def test_the_state_depends_on_two_bytes_alone():
    kinds = [ord(c) for c in "aP<> "] + [ord("S"), ord("M"), 0x80, 0xC3, 0xE6, 0xF0, 0xFF]
    step = lambda state, b: int(fill_middle.TABLE[state * 256 + b]) >> 3
    for a, b in itertools.product(kinds, repeat=2):
        assert len({step(step(s, a), b) for s in range(4)}) == 1
    alike = {tuple(fill_middle.TABLE[s * 256 + b] for s in range(4)) for b in range(256)}
    assert alike == {tuple(fill_middle.TABLE[s * 256 + b] for s in range(4)) for b in kinds}  # the bytes above stand for all


def test_lanes_agree_with_one_scan():
    draw = random.Random(5)
    data = np.frombuffer("".join(draw.choices("aZ<PSM> é日", k=9000)).encode(), np.uint8)
    state, want = 0, []
    for b in data.tolist():
        moved = int(fill_middle.TABLE[state * 256 + b])
        state = moved >> 3
        want.append(moved & 7)
    assert fill_middle.emissions(data).tolist() == want
    assert fill_middle.emissions(data[:0]).tolist() == []


def test_sliced_and_large_arrays(monkeypatch):
    monkeypatch.setattr(fill_middle, "BATCH", 300)
    rows = [t for _, t in texts(60, 8)]
    draw = np.random.RandomState(1).randint(0, 1 << 32, (2, 60))
    for kind in (pa.string(), pa.large_string()):
        whole = fill_middle.cuts(pa.array(rows, kind), *draw)
        part = fill_middle.cuts(pa.array(rows, kind).slice(11, 30), draw[0][11:41], draw[1][11:41])
        assert all((whole[k][11:41] == part[k]).all() for k in whole)
        assert whole["n"].tolist() == [len(UNITS.findall(t)) for t in rows]
        assert (whole["sentinel"] > 0).tolist() == [any(s in t for s in ("<P>", "<S>", "<M>")) for t in rows]


def test_odd_rows(spark, odd_docs, no_docs):
    got = fill_middle.transform(odd_docs.withColumn("form", F.lit("mine")).withColumn("_row", F.lit(1)))
    assert got.count() == odd_docs.count() and got.columns == [*(c for c in odd_docs.columns if c != "n"), "_row", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in got.collect():
        assert (r.form, r.output) == brute(r.doc_id, r.text)[1::3]
    assert fill_middle.transform(no_docs).collect() == []
