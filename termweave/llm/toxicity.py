"""Toxicity by a counterfactual-regularised linear classifier.

Features of a text: its distinct words, their beginnings of four to seven letters,
and the beginnings that several of its words share. A logistic regression learns their weights; for each labelled sentence
that names an identity, a copy with the term swapped is made, and a change of the
score between the two is penalised, so that neutral mentions of a group don't
raise a score. Neutral sentences with each term, labelled clean, are learnt from
beside the sample, so that every term has its swaps however rare it is there.

Defined cases: a null or empty text scores by the bias alone; repeated rows and
null ids are kept and scored; labels other than 0 and 1 and null ids are not
learnt from; a doc_id labelled twice counts as toxic if any row says so; where
the sample lacks either class all documents score 0 (``learn``). Other columns are
ignored; one that has the result's name and is to be kept gives way to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.workers import memory, slices, with_text

WORD = re.compile(r"[^\W\d_]+")
#: Identity terms, in sets of terms of a language that may stand for one another; none is in two. Fixed values.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual"),
    ("young", "old", "elderly"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann", "junge"),
    ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("christen", "muslime", "juden", "hinduisten", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiatische", "arabische"),
    ("afrikaner", "europäer", "amerikaner", "mexikaner", "chinesen", "inder", "türken"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    ("behindert", "taub"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("africains", "européens", "américains", "mexicains", "chinois", "indiens"),
    ("homosexuel", "lesbienne", "bisexuel", "hétérosexuel"),
    ("jeune", "vieux", "âgé"),
    ("handicapé", "aveugle", "sourd"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "latinos", "árabes"),
    ("africanos", "europeos", "americanos", "mexicanos", "chinos", "indios"),
    ("lesbiana", "homosexual"),
    ("joven", "viejo", "anciano"),
    ("discapacitado", "ciego", "sordo"),
)
#: Neutral sentences by language, and how many of the sets above are the language's, in their order. Fixed values.
NEUTRAL = (
    (10, ("our neighbours are {} and we met them at the market", "a {} teacher spoke about the history of the city")),
    (8, ("unsere nachbarn sind {} und wir trafen sie auf dem markt", "in der stadt leben viele {} seit langer zeit")),
    (9, ("nos voisins sont {} et nous les avons vus au marché", "dans la ville vivent aussi {} depuis longtemps")),
    (9, ("nuestros vecinos son {} y los vimos en el mercado", "en la ciudad viven también {} desde hace tiempo")),
)
SWAPS = {t: [x for x in group if x != t] for group in IDENTITIES for t in group}
PREFIXES = (4, 5, 6, 7)


def parts(word: str) -> list[str]:
    """The word, and with a trailing ``*`` its beginnings if it is longer. An identity term has no beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if word not in SWAPS else [word]


def features(words: set[str]) -> set[str]:
    """The parts of all words; a beginning that two and more words share also counts with ``**``."""
    seen = Counter(p for w in words for p in parts(w))
    return seen.keys() | {p + "*" for p, n in seen.items() if n > 1}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def fit(rows: list[tuple[str, int]], neutral: list[tuple[str, int]] = (), most_features: int = 800, least_z: float = 5.0, l2: float = 0.2, swap_weight: float = 5.0, steps: int = 300) -> tuple[dict[str, float], float]:
    """Weights by feature and the bias, from (text, label) rows.

    The loss is the mean log loss, its classes weighted alike, plus ``l2`` on the
    weights and ``swap_weight`` times the mean squared change of the logit between a
    text and each of its copies with one identity term swapped. The rows of
    ``neutral`` don't choose features; all of them weigh a fifth of a class.
    """
    n_pos = sum(y for _, y in rows)
    n_neg = len(rows) - n_pos
    if not n_pos or not n_neg:
        return {}, -20.0 if not n_pos else 20.0
    bags = [words_of(t) for t, _ in rows]
    seen = {0: Counter(), 1: Counter()}
    for bag, (_, y) in zip(bags, rows):
        seen[y].update(features(bag))
    rank = {}
    for f in seen[0].keys() | seen[1].keys():
        a, b = seen[1][f], seen[0][f]
        if a + b >= 3:
            p = (a + b) / len(rows)
            rank[f] = abs(a / n_pos - b / n_neg) / math.sqrt(p * (1 - p) * (1 / n_pos + 1 / n_neg) + 1e-9)
    chosen = sorted(rank, key=lambda f: (-rank[f], f))[:most_features]
    chosen = [f for i, f in enumerate(chosen) if i < 20 or rank[f] >= least_z]  # chance alone gives some of many words a z of 4
    chosen += sorted(t for t in SWAPS if t not in set(chosen))  # a swap must have a weight on either side
    index = {f: i for i, f in enumerate(chosen)}

    def matrix(all_bags: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(all_bags), len(index)), np.float32)
        for i, bag in enumerate(all_bags):
            x[i, [index[f] for f in features(bag) if f in index]] = 1
        return x

    bags += [words_of(t) for t, _ in neutral]
    x, y = matrix(bags), np.array([y for _, y in [*rows, *neutral]], np.float32)
    # A term has no beginnings, so a swap takes one feature away and adds one at most: the squared changes are sums over term pairs.
    pairs = Counter((t, other, other in bag) for bag in bags for t in bag & SWAPS.keys() for other in SWAPS[t])
    changes = np.zeros((len(SWAPS), len(SWAPS)))
    row = {t: k for k, t in enumerate(sorted(SWAPS))}
    terms = [index[t] for t in row]
    for (t, other, held), n in sorted(pairs.items()):
        i, j = row[t], row[other]
        changes[i, i] += n
        if not held:
            changes[j, j] += n
            changes[i, j] -= n
            changes[j, i] -= n
    changes = (swap_weight * 2 / max(1, pairs.total()) * changes).astype(np.float32)
    share = np.where(y == 1, 0.5 / n_pos, 0.5 / n_neg).astype(np.float32)
    share[len(rows) :] = 0.1 / max(1, len(neutral))
    w, bias = np.zeros(len(index), np.float32), 0.0
    m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        err = share * (p - y)
        grad_w = x.T @ err + l2 * w / len(rows)
        grad_w[terms] += changes @ w[terms]
        grad = np.append(grad_w, err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = (w - move[:-1]).astype(np.float32), bias - move[-1]
    return {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, float(bias)


def neutral_rows(which: int | None = None) -> list[tuple[str, int]]:
    """Clean sentences that name each identity term; all of them, or those of one template a language."""
    groups, out = iter(IDENTITIES), []
    for n, templates in NEUTRAL:
        for group in islice(groups, n):
            out += [(t.format(term), 0) for term in group for t in (templates if which is None else templates[which : which + 1])]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (1500, 3000), longest: int = 20_000) -> list[tuple[str, int]]:
    """The bounded labelled sample: the ``most`` toxic and clean rows whose ids hash lowest.

    Rows whose ``crc32(doc_id) % 3`` is 1 are held out. Documents over ``longest``
    characters aren't learnt from, so the sample's size is bounded.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, most[0]), (0, most[1]))]
    sample = F.broadcast(ids[0].unionByName(ids[1]))  # at most sum(most) rows
    got = docs.select("doc_id", "text").join(sample, "doc_id").where(F.length("text") <= longest)
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sum(most))
    return [(r.text, r.toxic) for r in got.select("text", "toxic").collect()]


def learn(docs: DataFrame, labels: DataFrame, **options) -> tuple[dict[str, float], float]:
    """The model of the labelled sample and the neutral sentences; where the sample lacks a class, one by which all documents score 0."""
    rows = training_rows(docs, labels)
    return fit(rows, neutral_rows(), **options) if len({y for _, y in rows}) == 2 else ({}, -20.0)


def score(docs: DataFrame, model: tuple[dict[str, float], float], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The columns ``keep`` and ``out_col`` (0 to 1) of every document, in one pass without a shuffle."""
    kept = [k for k in keep if k.lower() != out_col.lower()]
    rows, at = with_text(docs, kept, text_col, "scored")
    schema = T.StructType([*rows.schema.fields[: len(kept)], T.StructField(out_col, T.DoubleType())])

    name = hashlib.sha256(repr((sorted(model[0].items()), model[1])).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model
        known = memory(f"toxicity/{name}")  # the weighted parts of words seen
        for batch in slices(batches):
            out = []
            for text in batch.column(at).to_pylist():
                bag = words_of(text)
                for w in bag.difference(known):
                    known[w] = tuple(p for p in parts(w) if p in weights or p + "*" in weights)
                seen = Counter(p for found in map(known.__getitem__, bag) if found for p in found)
                z = bias + math.fsum(weights.get(p, 0.0) + (weights.get(p + "*", 0.0) if n > 1 else 0.0) for p, n in seen.items())
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                if len(known) > 300_000:
                    known.clear()
            yield pa.record_batch([*batch.columns[: len(kept)], pa.array(out, pa.float64())], names=[*kept, out_col])

    return rows.mapInArrow(run, schema)
