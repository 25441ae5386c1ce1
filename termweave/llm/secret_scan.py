"""Secrets in text: fixed patterns, and strings that look random rather than named.

Two first-order character Markov models, one of random strings and one of ordinary
identifiers, are trained from labelled samples; a token whose log-likelihood ratio
is high enough is reported besides what the patterns find. The limits are those that
part held-out labelled tokens best.

Defined cases: a null text counts as empty and has no span; offsets count code
points, ends are exclusive; spans sort by start, then by kind as in ``KINDS``;
repeated rows and null ids are kept; other columns are ignored by ``scan``, and a
column ``spans`` that is to be kept gives way to the result. An
empty table trains on generated strings alone and gives no row.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.workers import fresh, slices

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 and more: the long ones of [0-9a-f]+
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z_-]{3,}")
#: Words that identifiers are made of. Fixed values.
NAMES = "user account key primary get set find by id name value index list map table row column file path read write open close stream buffer data cache queue task thread pool lock config option default factory proxy builder handler manager service client server request response session token parser reader writer context state event error message number count size max min total first last next text string array byte node tree graph model layer batch train test image audio video memory device kernel driver direct remote local abstract singleton bean controller adapter provider registry module package version update delete create insert select query result".split()
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, where the secret itself starts) of the fixed patterns, by kind."""
    out = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return out


class MarkovRatio:
    """Log-likelihood ratio, in nats a character, of random strings over identifiers."""

    def __init__(self, random_counts: Counter, word_counts: Counter):
        self.least, self.total = 0.0, 0.0
        tables = []
        for counts in (random_counts, word_counts):
            rows = Counter()
            for (a, _), n in counts.items():
                rows[a] += n
            tables.append((counts, rows))
        size = len(ALPHABET)
        self.step = {}
        for a in "^" + ALPHABET:
            for b in ALPHABET:
                p, q = ((c[a, b] + 0.5) / (r[a] + 0.5 * size) for c, r in tables)
                self.step[a + b] = math.log(p / q)

    def score(self, token: str) -> float:
        step = self.step
        return step["^" + token[0]] + sum(map(step.__getitem__, map("".join, zip(token, token[1:]))))

    def set_limit(self, random: list[str], ordinary: list[str], false_alarms: float = 0.001) -> None:
        """The least ratio a character that no more than that share of the ordinary tokens reaches, half way to the random ones it parts them from."""
        calm = sorted(self.score(t) / len(t) for t in ordinary)
        top = calm[-1 - int(false_alarms * len(calm))]
        above = [x for t in random if (x := self.score(t) / len(t)) > top]
        self.least = (top + min(above)) / 2 if above else math.inf

    def is_random(self, token: str) -> bool:
        return self.score(token) >= self.least * len(token)


def _grams(token: str) -> Iterator[tuple[str, str]]:
    return zip("^" + token, token)


def generated(n: int = 3000, seed: int = 7) -> list[str]:
    """Random strings as keys have them: base 64, letters with digits, hex."""
    draw = random.Random(seed)
    sets = (ALPHABET[:64], ALPHABET[:62], "0123456789abcdef", ALPHABET[26:62])
    return ["".join(draw.choices(sets[i % len(sets)], k=draw.randint(16, 48))) for i in range(n)]


def ordinary(n: int = 6000, seed: int = 8) -> list[str]:
    """Ordinary tokens: identifiers in the usual ways of joining words, with and without digits, paths, numbers, rules and keyboard rows."""
    draw = random.Random(seed)
    rows = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
    out = []
    while len(out) < n:
        words = draw.choices(NAMES, k=draw.randint(2, 5))
        words = [w.upper() if draw.random() < 0.08 else w for w in words]
        digits = str(draw.randrange(10 ** draw.randint(1, 4))) if draw.random() < 0.4 else ""
        joined = (
            words[0] + "".join(w[:1].upper() + w[1:] for w in words[1:]), "".join(w[:1].upper() + w[1:] for w in words), "_".join(words), "_".join(words).upper(), "-".join(words), "/".join(words),
        )[draw.randrange(6)]
        kind = draw.random()
        if kind < 0.1:
            token = str(draw.randrange(10**15, 10 ** draw.randint(16, 24)))
        elif kind < 0.13:
            token = draw.choice("-=_+/.") * draw.randint(16, 60)
        elif kind < 0.17:
            row = draw.choice(rows) + draw.choice(rows)
            token = row.upper() if draw.random() < 0.5 else row
        elif kind < 0.22:
            token = f"{draw.randint(1990, 2030)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}T{draw.randint(0, 23):02d}{draw.randint(0, 59):02d}{draw.randint(0, 59):02d}"
        else:
            token = joined + digits
        if len(token) >= 16:
            out.append(token)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = {0: Counter(), 1: Counter()}
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            text = text or ""
            spans = base_spans(text)
            for _, _, end, start in spans:
                found[1].update(_grams(text[start:end]))
            at = 0
            for start, end in sorted((s, e) for _, s, e, _ in spans) + [(len(text), len(text))]:
                for m in IDENTIFIER.finditer(text, at, max(at, start)):
                    found[0].update(_grams(m[0]))
                at = max(at, end)
    rows = [(k, a + b, n) for k, c in found.items() for (a, b), n in c.items()]
    if rows:
        yield pa.record_batch([pa.array(x) for x in zip(*rows)], names=["kind", "gram", "n"])


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = 2000) -> MarkovRatio:
    """Fit both models.

    Labelled samples: the values that the fixed patterns find and generated strings
    are random; the words outside them and made-up identifiers are ordinary. Of what
    is made up two thirds are learnt from, and the rest sets the limit. The others come from the
    ``sample_docs`` documents whose ids hash lowest: the ids alone are sorted, and the
    texts are counted where they are. Only counts of letter pairs, at most
    ``2 * 69 * 68`` rows, reach the driver.
    """
    lowest = F.xxhash64(id_col)
    cut = docs.select(lowest.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    sample = docs.where(lowest <= F.lit(cut).cast("long")).select(F.col(text_col).cast("string").alias("text"))
    counts = {0: Counter(), 1: Counter()}
    for r in sample.mapInArrow(_count, "kind long, gram string, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n")).collect():
        counts[r.kind][r.gram[0], r.gram[1]] += r.n
    made = {1: generated(), 0: ordinary()}
    for kind, tokens in made.items():
        for i, s in enumerate(tokens):
            if i % 3:
                counts[kind].update(_grams(s))
    # Prose has far more pairs than the rest; each half of the ordinary side counts alike.
    model = MarkovRatio(counts[1], counts[0])
    model.set_limit(made[1][::3], made[0][::3])
    return model


def find(text: str, model: MarkovRatio) -> list[tuple[str, int, int, int]]:
    """All spans of a text, sorted. A token that touches a pattern's span is not tried."""
    spans = base_spans(text)
    taken = sorted((a, b) for _, a, b, _ in spans)
    at = reach = 0  # the pattern's spans that start before a token's end, and the furthest end among them
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][0] < e:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= s and model.is_random(m[0]):
            spans.append(("markov", s, e, s))
    spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return spans


def scan(docs: DataFrame, model: MarkovRatio, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``spans`` of every document, in one pass without a shuffle."""
    keep = tuple(k for k in keep if k.lower() != "spans")
    rows = docs.select(*(F.col(k) for k in keep), F.col(text_col).cast("string").alias(fresh("scanned", list(keep))))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret_start", pa.int32())]))
    names = [*keep, "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[dict(zip(("kind", "start", "end", "secret_start"), s)) for s in find(t or "", model)] for t in batch.column(len(keep)).to_pylist()]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(spans, kind)], names=names)

    found = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("start", "end", "secret_start"))]))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("spans", found)]))


def redact(docs: DataFrame, model: MarkovRatio, text_col: str = "text", mask: str = "[REDACTED]", size_col: str | None = None) -> DataFrame:
    """The same rows and columns; secrets in the text give way to ``mask``, and ``size_col`` is the new length. A text without any is untouched."""
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(size_col) if size_col else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, sizes = [], batch.column(size_at).to_pylist() if size_col else []
            for row, text in enumerate(batch.column(at).to_pylist()):
                spans = find(text, model) if text else []
                parts, done = [], 0
                for _, _, end, start in spans:
                    if end > done:
                        parts += [text[done : max(done, start)], mask]
                        done = end
                texts.append("".join([*parts, text[done:]]) if parts else text)
                if parts and size_col:
                    sizes[row] = len(texts[-1])
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            if size_col:
                cols[size_at] = pa.array(sizes, cols[size_at].type)
            yield pa.record_batch(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
