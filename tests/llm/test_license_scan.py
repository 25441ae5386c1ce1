import random

from termweave.llm import license_scan

TEMPLATES = [license_scan.Template(k, v) for k, v in license_scan.TEMPLATES.items()]


def names(text):
    return [h[0] for h in license_scan.find(text, TEMPLATES)]


def test_exact_and_edited_texts():
    draw = random.Random(8)
    for name, text in license_scan.TEMPLATES.items():
        body = "some words before it\n" + text.upper() + "\nand the rest of the text under it"
        hits = {h[0]: h for h in license_scan.find(body, TEMPLATES)}
        assert hits[name][1] == 1.0 and body[hits[name][2] : hits[name][3]].upper() == text.upper().rstrip(".")
        words = text.split()
        if len(words) > 20:
            for _ in range(len(words) // 20):
                words[draw.randrange(len(words))] = "changed"
            assert name in names("x " * 50 + " ".join(words) + " y" * 50)


def test_repeated_and_near_notices():
    line = license_scan.TEMPLATES["MIT"]
    assert names(f"{line} and more of the text\n" * 3) == ["MIT"] * 3
    assert names("Released under the BSD License.") == []
    assert names("the license under which it was released by MIT") == []
    assert names("") == [] and names("İstanbul " + line) == ["MIT"]


def test_lis_and_patience():
    a, b = "a x b y c".split(), "a b z c".split()
    assert license_scan.patience(a, b) == [(0, 0), (2, 1), (4, 3)]
    assert license_scan.patience([], b) == []
    assert len(license_scan.patience("p q r s t".split(), "s t p q r".split())) == 3


def test_screen_loses_nothing(spark, data):
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        for t in TEMPLATES:
            if not t.may_hold(r.text.lower()):
                words = license_scan.WORD.findall(r.text.lower())
                where = {}
                for i, w in enumerate(words):
                    where.setdefault(w, []).append(i)
                assert t.find(words, where) == []


def test_planted_lines_are_found(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    want = sorted((r.doc_id, k) for r in docs.collect() for k, line in lines.items() for _ in range(r.text.count(line)))
    got = sorted((r.doc_id, r.license) for r in license_scan.scan(docs).collect())
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    assert license_scan.scan(odd_docs).collect() == [] and license_scan.scan(no_docs).collect() == []
    more = spark.createDataFrame([(None, license_scan.TEMPLATES["MIT"]), (1, license_scan.TEMPLATES["MIT"]), (1, license_scan.TEMPLATES["MIT"])], "doc_id long, text string")
    assert sorted(repr(r.doc_id) for r in license_scan.scan(more).collect()) == ["1", "1", "None"]


def test_adjacent_notices_are_all_found():
    for name in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0", "ISC-text"):
        for k in (2, 3, 4, 9):
            assert names("\n".join([license_scan.TEMPLATES[name]] * k)).count(name) == k
    line = license_scan.TEMPLATES["MIT"]
    assert names(" ".join([line, line, "Released under the old MIT License.", line, line])) == ["MIT"] * 5


def test_notices_with_many_inserted_words():
    for name in ("MIT-text", "GPL-3.0-header", "BSD-2-Clause-text"):
        words = license_scan.TEMPLATES[name].split()
        for each in (1, 2, 3):
            body = " ".join(f"{w} " + " ".join(f"in{i}x{k}" for k in range(each)) for i, w in enumerate(words))
            assert names(f"text before {body} text after") == [name], (name, each)
        middle = words[:30] + [f"new{i}" for i in range(len(words) // 2)] + words[30:]
        assert names(" ".join(middle)) == [name]
