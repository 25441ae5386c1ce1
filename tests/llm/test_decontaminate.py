import itertools
import random
import re

import pytest

from termweave.llm import decontaminate, queries

WORDS = [a + b for a in "kal mer tos vin dra pel".split() for b in "on er ix ul am ep".split()]


def brute(docs, items, window=13, similarity=0.8):
    out = {}
    for i, text in docs:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        for j, item in items:
            b = re.findall(r"[^\W_]+", (item or "").lower())
            masks = list(decontaminate.MASKS) + (["1" * len(b)] if 5 <= len(b) < max(map(len, decontaminate.MASKS)) else [])
            for m in masks:
                for p in range(len(w) - len(m) + 1):
                    for q in range(len(b) - len(m) + 1):
                        if len(b) >= 5 and all(w[p + k] == b[q + k] for k, bit in enumerate(m) if bit == "1"):
                            of = min(window, len(b))
                            for s in (min(q, len(b) - of), max(0, q + len(m) - of)):
                                same = sum(0 <= p - q + s + k < len(w) and w[p - q + s + k] == b[s + k] for k in range(of))
                                if same + 1e-9 >= similarity * of:
                                    best, first = out.get((i, j), (0, 1 << 30))
                                    out[i, j] = max(best, same), min(first, p)
    return out


def found(df):
    return {(r.doc_id, r.item_id): (r.best, r.first_word) for r in df.collect()}


@pytest.fixture
def planted(spark):
    draw = random.Random(5)
    text = lambda n: draw.choices(WORDS, k=n)
    items = [(j, " ".join(text(n))) for j, n in enumerate((20, 40, 15, 7, 6, 3))]
    docs = []
    for i in range(60):
        body = text(30)
        if i % 3 == 0:
            passage = items[i // 3 % 5][1].split()
            for _ in range(len(passage) // 8 if i % 2 else 0):
                passage[draw.randrange(len(passage))] = "other"
            body[10:10] = passage
        docs.append((i, " ".join(body).title() + "."))
    return docs + [(90, None), (91, ""), (None, items[0][1]), (92, items[0][1]), (92, items[0][1])], items + [(None, "a b c d e f g"), (9, None)]


def test_against_brute_force(spark, planted):
    docs, items = planted
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, p int, seed string")
    bench = spark.createDataFrame([(*b, 5) for b in items], "item_id long, text string, n int")
    want = brute(docs, items)
    assert len(want) > 15
    assert found(decontaminate.matches(df, bench)) == want
    assert found(decontaminate.matches(df, bench, most_seeds=20)) == want  # in blocks
    hit = {i for i, _ in want if i is not None}
    assert sorted(repr(r.doc_id) for r in decontaminate.clean(df, bench).collect()) == sorted(repr(i) for i, _ in docs if i not in hit)


def test_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "plain text of a few words here")], "item_id long, text string")
    assert found(decontaminate.matches(no_docs, bench)) == {}
    assert found(decontaminate.matches(odd_docs, bench.where("false"))) == {}
    assert set(found(decontaminate.matches(odd_docs, bench))) == {(1, 1)}


def test_plan_is_native(spark, data):
    plan = queries.op4_decontaminate(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def all_windows(docs, items, window=13, similarity=0.8):
    """Best of every window of every item over every place of every document, without masks."""
    out = {}
    for i, text in docs:
        w = re.findall(r"[^\W_]+", text.lower())
        for j, item in items:
            b = re.findall(r"[^\W_]+", item.lower())
            of = min(window, len(b))
            for off in range(-len(b), len(w)):
                for s in range(len(b) - of + 1):
                    same = sum(0 <= off + s + k < len(w) and w[off + s + k] == b[s + k] for k in range(of))
                    if same + 1e-9 >= similarity * of:
                        out[i, j] = max(out.get((i, j), 0), same)
    return out


def test_every_window_placement(spark):
    """Runs of 13 words of a longer item, any two substituted."""
    draw = random.Random(9)
    vocab = [f"{a}{i}" for a in WORDS for i in range(20)]
    item = draw.sample(vocab, 30)
    docs = []
    for a in range(13):
        for b in range(a):
            run = item[8:21]
            run[a], run[b] = "other", "another"
            docs.append((len(docs), " ".join(draw.choices(vocab, k=9) + run + draw.choices(vocab, k=9))))
    items = [(1, " ".join(item))]
    want = all_windows(docs, items)
    assert len(want) == 78
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.best for r in got} == want


def test_short_items_with_substitutions(spark):
    """Items of 5 to 13 words, as many of them substituted as 80 % allow, in all places."""
    vocab = [f"{a}{i}" for a in WORDS for i in range(20)]
    draw = random.Random(2)
    items, docs = [], []
    for n in range(5, 14):
        item = draw.sample(vocab, n)
        items.append((n, " ".join(item)))
        for places in itertools.combinations(range(n), n // 5):
            passage = ["other" if k in places else x for k, x in enumerate(item)]
            docs.append((1000 * n + len(docs), " ".join(draw.choices(vocab, k=4) + passage + draw.choices(vocab, k=4))))
    want = {(i, i // 1000): (i // 1000 - i // 1000 // 5, 4) for i, _ in docs}
    assert found(decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == want


def test_clean_judges_repeated_ids_by_text(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "nothing of it"), (1, f"before {item} after"), (2, item), (None, item)], "doc_id long, text string")
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in kept), key=repr) == [(1, "nothing of it"), (None, item)]


def test_masks_miss_no_pattern_of_substitutions():
    fits = lambda mask, at, bad: not any(bit == "1" and at + i in bad for i, bit in enumerate(mask))
    for bad in itertools.combinations(range(13), 2):
        assert any(fits(m, at, bad) for m in decontaminate.MASKS for at in range(13 - len(m) + 1)), bad
    for n in range(decontaminate.FEWEST, 14):
        few = int(0.2 * n + 1e-9)
        masks = [*decontaminate.whole_masks(n, few)] or ["1" * n]
        for bad in itertools.combinations(range(n), few):
            assert any(fits(m, 0, bad) for m in masks) or any(fits(m, at, bad) for m in decontaminate.MASKS for at in range(n - len(m) + 1)), (n, bad)


def test_sql_has_the_same_criterion(spark):
    from oracle import same

    import duckdb

    item = [f"w{i}" for i in range(20)]
    inside = item[4:17]
    inside[5], inside[6] = "x", "y"
    short = ["one", "two", "three", "four", "five", "six"]
    docs = [(1, " ".join(["a", "b", *inside, "c"])), (2, "zero one two odd four five six seven"), (3, " ".join(inside)), (4, "two three four five six"), (5, None), (6, " ".join(item[:11])), (7, "one two three four odd odd")]
    bench = [(1, " ".join(item)), (2, " ".join(short)), (3, "just four words here"), (4, " ".join(item[:13]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", d.toPandas()), ("benchmark", b.toPandas())):
        con.register(f"{name}_df", df)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_df")
    got = decontaminate.matches(d, b)
    same(got, con, queries.oracle_sql()["op4_decontaminate"])
    assert {(r.doc_id, r.item_id) for r in got.collect()} >= {(1, 1), (2, 2), (3, 1)}
