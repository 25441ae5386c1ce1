import math
import random

import pytest

from termweave.llm import jaccard_join


def brute(docs, n, percent):
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                common = len(x & y)
                if common * 100 >= percent * (len(x) + len(y) - common):
                    parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None and sets[k]:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least.get(root(k), i) if sets[k] else i) for k, (i, _) in enumerate(docs)), key=repr)


def grouped(spark, docs, n, percent, most=32, exact=False):
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, class int")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.groups(df, n, percent, most=most, exact=exact).collect()), key=repr)


def corpus(seed, size, vocabulary=400):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    template, passage = draw.choices(words, k=90), draw.choices(words, k=60)
    docs = []
    for i in range(size):
        kind = i % 4
        text = draw.choices(words, k=draw.randint(1, 120))
        if kind == 0:  # near copies, more and less edited
            text = list(template)
            for _ in range(draw.randint(0, 8)):
                text[draw.randrange(len(text))] = draw.choice(words)
        elif kind == 1:  # a common passage
            text = text[:50] + passage + text[50:]
        elif kind == 2 and docs and draw.random() < 0.5:
            text = (docs[draw.randrange(len(docs))][1] or "x").split()
            text += draw.choices(words, k=draw.randint(0, 3))
        docs.append((i, " ".join(text)))
    return docs


@pytest.mark.parametrize("n, percent, most, exact", [(4, 85, 6, False), (5, 80, 32, False), (3, 60, 4, True), (2, 20, 8, False)])
def test_against_brute_force(spark, n, percent, most, exact):
    docs = corpus(n, 240)
    assert grouped(spark, docs, n, percent, most, exact) == brute(docs, n, percent)


def test_links_come_through_regions(spark, monkeypatch):
    """Near copies by the dozen, whose every key is hot, and a passage that chains them: only pivots, rings and cells find these links."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    passage, docs = draw.choices(words, k=80), []
    for f in range(6):
        family = draw.choices(words, k=90)
        for i in range(14):
            text = list(family)
            for _ in range(draw.choice((0, 0, 1, 1, 3))):
                text[draw.randrange(90)] = draw.choice(words)
            docs.append((100 * f + i, " ".join(text + passage)))
    made, run = [], jaccard_join._regions

    def seen(*args):
        made.append(run(*args))
        return made[-1]

    monkeypatch.setattr(jaccard_join, "_regions", seen)
    assert grouped(spark, docs, 3, 85, 3) == brute(docs, 3, 85)
    assert len(made) == 1


@pytest.mark.parametrize("percent", [80, 85])
def test_keys_shared_by_linked_classes(percent):
    """The bound on what linked classes share, against draws of pairs just at the limit."""
    import numpy as np

    least = jaccard_join.least_shared(percent)
    draw, shared = np.random.RandomState(percent), []
    size, common = 1000, percent * 10
    for _ in range(4000):
        h = draw.permutation(size)
        both, rest = h[:common], h[common:]
        cut = draw.randint(0, len(rest) + 1)
        x, y = (np.sort(np.concatenate([both, r]))[: jaccard_join.KEYS] for r in (rest[:cut], rest[cut:]))
        shared.append(len(np.intersect1d(x, y)))
    tail = sum(math.comb(48, k) * (percent / 100) ** k * (1 - percent / 100) ** (48 - k) for k in range(least))
    assert tail <= jaccard_join.MISS and min(shared) >= least
    t = 36  # where the bound is large enough to be seen
    expected = sum(math.comb(48, k) * (percent / 100) ** k * (1 - percent / 100) ** (48 - k) for k in range(t))
    assert sum(s < t for s in shared) / 4000 <= expected + 4 * math.sqrt(expected / 4000)


def test_percent_out_of_range(spark, no_docs):
    with pytest.raises(ValueError):
        jaccard_join.groups(no_docs, percent=0)


def test_odd_rows(spark, no_docs):
    docs = [(5, "a b"), (4, "A  b"), (3, ""), (2, None), (1, " \t"), (None, "a b"), (None, "c d"), (9, "x y z x y z x y z"), (9, "x y z x y z x y z"), (8, "É É"), (7, "é é")]
    assert grouped(spark, docs, 4, 85) == brute(docs, 4, 85)
    assert jaccard_join.groups(no_docs).collect() == []


def test_one_of_each(spark, odd_docs):
    docs = spark.createDataFrame([(3, "one two three four five six", "a"), (2, "One two three four five six", "b"), (4, "else", "c"), (5, None, "d")], "doc_id long, text string, class string")
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(docs).collect()) == [2, 4, 5]
    assert jaccard_join.one_of_each(odd_docs).count() == odd_docs.count()


def test_one_of_each_judges_repeated_ids_by_text(spark):
    keep = lambda rows: sorted((tuple(r) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert keep([(1, "a b c d e f"), (2, "x y z u v w"), (2, "a b c d e f")]) == [(1, "a b c d e f"), (2, "x y z u v w")]
    near = ["a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y Z"]
    assert len(keep([(1, near[0]), (1, near[1] + " end"), (3, near[0])])) == 1
    same = "one two three four five"
    assert keep([(4, same), (4, same), (None, same), (5, same)]) == [(4, same), (4, same), (None, same)]


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for x in range(500))


def test_postings_are_gone_before_texts_are_compared(spark, monkeypatch):
    """Of the tables that hold a row's keys, only the classes' own is on disk while sets are made and compared."""
    from pathlib import Path

    from termweave.llm import store

    here = lambda: {p.name for p in Path(store.shared_dir(spark).removeprefix("file:")).iterdir()}
    before, seen, compared = here(), [], jaccard_join.compared
    monkeypatch.setattr(jaccard_join, "compared", lambda *a: seen.append({x.split("-")[0] for x in here() - before}) or compared(*a))
    docs = [(i, " ".join(f"w{i // 2}x{k}" for k in range(60))) for i in range(20)]
    docs += [(100 + i, " ".join(f"c{k}" for k in range(80)) + f" own{i}") for i in range(40)]  # more than a cool key may have
    assert grouped(spark, docs, 4, 80) == brute(docs, 4, 80)
    assert len(seen) == 2 and all("classes" in x and "pairs" in x and not x & {"shingled", "keys", "posted", "hot"} for x in seen)
    assert "sets" not in seen[0] | seen[1]
