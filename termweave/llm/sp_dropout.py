"""SentencePiece merge-type encoding with seeded merge-dropout, and lossless decoding.

Pieces and merge order come from a merge-type (BPE) model file. A text is cut into
units, a run of blanks with what is behind it; no piece of such a model reaches across
units. In each unit candidate merges wait on an agenda; when one is taken, it is
skipped with the chance ``dropout``. Skipped merges stay skipped. The draws are hashes
of seed, document id, the unit's place in the document and their number, so each
occurrence of a word and each copy of a text has its own; a draw says how many merges
pass until the next skip. Words are also cut before punctuation, where the model's
pieces show that none reaches over that place.

The agendas of many units are worked off side by side, a merge of each at a time, as
columns of one array. Only what no draw touches is remembered: a unit's number of
merges and its ids without a skip. Units with a letter that is no piece, and long
ones, have an agenda each.

Defined cases: a null text gives null ids and decodes to null, an empty text gives
no ids. A letter without a piece, and the blank mark itself where a text has it,
become byte pieces, so that decoding gives back every text exactly. Repeated rows
with the same id and text get the same ids; other columns are kept, but for one that
has the name of the result, which it replaces. Ids that the model lacks, half an id
at the end, and bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import accumulate, chain, filterfalse, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.workers import fresh, memory, slices, with_text

MARK = "▁"
ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_M64 = (1 << 64) - 1
#: A gap between skips that no unit is long enough for.
_NEVER = 1 << 50
#: Units of up to so many letters go side by side, so many units and so many of a batch's units at a time.
_WIDTHS, _ABREAST, _UNITS = (4, 8, 12, 16, 31), 8192, 60_000
#: No merge here: behind all ranks. An entry of the agenda is ``rank * 32 + place``, so models may have 2^26 pieces.
_NONE = np.int32((1 << 31) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))



def unit_pattern(pieces: list[str]) -> re.Pattern:
    """What cuts a text, its blanks being marks, into units that no piece reaches over.

    Cuts are before each run of marks; between letters or digits and ASCII
    punctuation, for such of them as no piece holds side by side; and around line
    feeds if no piece holds one.
    """
    ends = {c for c in ASCII_MARKS}
    met = {a for p in pieces for a, b in zip(p, p[1:]) if b in ends}
    letters = "[^\\W_" + re.escape("".join(sorted(c for c in met if c.isalnum()))) + "]"
    if any("\n" in p for p in pieces):
        return re.compile(f"{MARK}*{letters}+(?=[{re.escape(ASCII_MARKS)}{MARK}]|\\Z)|{MARK}*[^{MARK}]+|{MARK}+")
    return re.compile(f"{MARK}*{letters}+(?=[{re.escape(ASCII_MARKS)}{MARK}\\n]|\\Z)|{MARK}*[^{MARK}\\n]+|{MARK}+|\\n")


class _Ids(dict):
    """Ids of a piece, little-endian; byte pieces for anything else."""

    def __init__(self, ids: dict[str, int], bytes_at: list[int], dtype: str):
        super().__init__((p, np.array([i], dtype).tobytes()) for p, i in ids.items())
        self.bytes_at, self.dtype = bytes_at, dtype

    def __missing__(self, piece: str) -> bytes:
        return np.array([self.bytes_at[b] for b in piece.encode()], self.dtype).tobytes()


class _Merges:
    """Two symbols to the symbol they merge to, as an open-addressed table for arrays of pairs."""

    def __init__(self, ids: dict[str, int], n: int):
        found = [(ids[p[:k]] * n + ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        keys, values = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        self.n, self.bits = n, max(4, (8 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged symbols, -1 where there is none."""
        keys = a.astype(np.int64) * self.n + b
        at = self._slot(keys)
        out, held = self.values[at], self.keys[at]
        left = np.flatnonzero((held != keys) & (held >= 0))
        out[held != keys] = -1
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class DropoutEncoder:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, dropout: float = 0.1, seed: int = 0, keep: int = 200_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = sp.id_to_piece(list(range(n)))
        self.bytes_at = [0] * 256
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.out: list[bytes] = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                b = int(p[1:-1], 16)
                self.bytes_at[b] = i
                self.out.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"")
            else:
                self.ids[p] = i
                self.rank[p] = -sp.get_score(i)
                self.out.append(p.replace(MARK, " ").encode())
        self.out.append("\ufffd".encode())  # for all other ids
        self.dtype = "<u2" if n <= 1 << 16 else "<u4"
        self.bytes_of = _Ids(self.ids, self.bytes_at, self.dtype)
        self.dropout, self.seed, self.keep = dropout, seed, keep
        self.log_pass = math.log1p(-dropout) if dropout < 1 else -math.inf
        self.unit = unit_pattern(list(self.ids))
        scores = sorted(set(self.rank.values()))
        place = {r: k for k, r in enumerate(scores)}
        #: The place of a symbol's merge among all merges; equal scores have one place.
        self.order = np.zeros(n, np.int32)
        for p, i in self.ids.items():
            self.order[i] = place[self.rank[p]]
        self.letter = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.letter[ord(p)] = i
        self.merges = _Merges(self.ids, n)
        self.whole: dict[str, tuple[int, bytes]] = {}  # unit: its merges, and its ids without a skip

    def _base(self, key: int) -> int:
        return ((key & _M64) ^ (self.seed * 0x9E3779B97F4A7C15)) & _M64

    def _gaps(self, bases: np.ndarray, rounds: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How many merges pass before the next skip, for numbers of draws and places of units."""
        if not self.dropout:
            return np.full(np.broadcast(bases, rounds, places).shape, _NEVER)
        x = _mix(bases + rounds.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        x = _mix(x + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        u = ((x >> np.uint64(11)) + 0.5) * 2.0**-53
        return np.minimum(np.log(u) / self.log_pass, _NEVER).astype(np.int64)

    def _later(self, base: int, place: int, number: int) -> Iterator[int]:
        """The gaps of a unit from draw ``number`` on."""
        block = 16
        while True:
            yield from self._gaps(np.array([base], np.uint64), np.arange(number, number + block), np.array([place])).tolist()
            number, block = number + block, min(2 * block, 4096)

    def _segment(self, unit: str, gaps: Iterator[int]) -> tuple[list[str], int]:
        """Pieces, and the number of merges taken or skipped. Merges go by rank, then from the left."""
        rank, n = self.rank, len(unit)
        done, skip = 0, next(gaps)
        ends = list(range(1, n + 1))  # end of the piece that starts here; 0: no piece starts here
        before = list(range(-1, n - 1))
        agenda = [(rank[p], i, i + 2) for i in range(n - 1) if (p := unit[i : i + 2]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, j = heapq.heappop(agenda)
            mid = ends[i]
            if not mid or mid >= j or ends[mid] != j:
                continue  # one of its parts has been merged otherwise
            done += 1
            if done > skip:
                skip = done + next(gaps)
                continue
            ends[i], ends[mid] = j, 0
            if j < n:
                before[j] = i
                if (p := unit[i : ends[j]]) in rank:
                    heapq.heappush(agenda, (rank[p], i, ends[j]))
            if (h := before[i]) >= 0 and (p := unit[h:j]) in rank:
                heapq.heappush(agenda, (rank[p], h, j))
        out, i = [], 0
        while i < n:
            out.append(unit[i : ends[i]])
            i = ends[i]
        return out, done

    def pieces(self, unit: str, key: int, place: int = 0) -> list[str]:
        """The segmentation of the unit that stands at ``place`` of a text with that key."""
        return self._segment(unit, self._later(self._base(key), place, 0))[0]

    def _ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, pieces))

    def _side_by_side(self, sym: np.ndarray, size: np.ndarray, bases: np.ndarray | None, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_segment`` for the columns of ``sym`` (letters down, ``size`` of them): which places hold a symbol at the end, and the merges taken or skipped."""
        wide, n = sym.shape
        cols, rows = np.arange(n), np.arange(wide)[:, None]
        alive = rows < size
        after, before = np.repeat(rows + 1, n, 1), np.repeat(rows - 1, n, 1)  # the next and the last place that holds a symbol
        agenda, becomes = np.full((wide, n), _NONE, np.int32), np.zeros((wide, n), np.int32)

        def weigh(at: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            new = self.merges(left, right)
            becomes[at, c] = new
            agenda[at, c] = np.where(new >= 0, self.order[new] * 32 + at, _NONE)

        i, c = np.nonzero(alive[1:])
        weigh(i, c, sym[i, c], sym[i + 1, c])
        done, draws = np.zeros(n, np.int64), np.ones(n, np.int64)
        skip = np.full(n, _NEVER) if bases is None else self._gaps(bases, np.zeros(1, np.int64), places)
        while len(cols):
            first = agenda[:, cols].min(0) if len(cols) < n else agenda.min(0)
            go = first != _NONE
            if not go.all():
                cols, first = cols[go], first[go]
            at = first & 31
            done[cols] += 1
            agenda[at, cols] = _NONE
            skipped = done[cols] > skip[cols]
            if skipped.any():
                c = cols[skipped]
                skip[c] = done[c] + self._gaps(bases[c], draws[c], places[c])
                draws[c] += 1
                at, c = at[~skipped], cols[~skipped]
            else:
                c = cols
            new = becomes[at, c]
            gone = after[at, c]
            then = after[gone, c]
            sym[at, c], after[at, c], alive[gone, c], agenda[gone, c] = new, then, False, _NONE
            more = np.flatnonzero(then < size[c])
            if len(more):
                a, k, t = at[more], c[more], then[more]
                before[t, k] = a
                weigh(a, k, new[more], sym[t, k])
            more = np.flatnonzero(before[at, c] >= 0)
            if len(more):
                k = c[more]
                t = before[at[more], k]
                weigh(t, k, sym[t, k], new[more])
        return alive, done

    def _segments(self, units: list[str], bases: np.ndarray | None, places: np.ndarray) -> tuple[list[bytes], list[int]]:
        """Ids of each unit, and its merges taken or skipped; without ``bases`` none is skipped."""
        out, done = [b""] * len(units), np.zeros(len(units), np.int64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        letters = self.letter[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        start = np.concatenate([[0], np.cumsum(size)])
        known = np.concatenate([[0], np.cumsum(letters < 0)])
        fits = (known[start[1:]] == known[start[:-1]]) & (size <= _WIDTHS[-1])
        for i in np.flatnonzero(~fits).tolist():
            pieces, done[i] = self._segment(units[i], repeat(_NEVER) if bases is None else self._later(int(bases[i]), int(places[i]), 0))
            out[i] = self._ids(pieces)
        low = 0
        for wide in _WIDTHS:
            those = np.flatnonzero(fits & (size > low) & (size <= wide))
            low = wide
            for k in range(0, len(those), _ABREAST):
                some = those[k : k + _ABREAST]
                at = np.minimum(start[some] + np.arange(wide)[:, None], len(letters) - 1)
                sym = letters[at]
                alive, done[some] = self._side_by_side(sym, size[some], None if bases is None else bases[some], places[some])
                flat = sym.T[alive.T].astype(self.dtype).tobytes()
                cuts = [0, *accumulate((alive.sum(0) * np.dtype(self.dtype).itemsize).tolist())]
                for i, a, b in zip(some.tolist(), cuts, cuts[1:]):
                    out[i] = flat[a:b]
        return out, done.tolist()

    def _units(self, text: str) -> list[str]:
        """The units of a text; an empty one stands for a blank mark in it."""
        if MARK not in text:
            return self.unit.findall(MARK + text.replace(" ", MARK))
        out = []
        for i, part in enumerate(text.split(MARK)):
            out += [""] * bool(i) + self.unit.findall(("" if i else MARK) + part.replace(" ", MARK))
        return out

    def encode(self, text: str, key: int) -> bytes:
        """Ids, little-endian, of a text; ``key`` stands for its document."""
        return self.encode_all([text], [key])[0]

    def encode_all(self, texts: list[str | None], keys: list[int]) -> list[bytes | None]:
        """``encode`` of each text; null gives null."""
        out: list[bytes | None] = [None if t is None else b"" for t in texts]
        todo, held = [], 0
        for i, t in enumerate(texts):
            if t:
                todo.append((i, keys[i], self._units(t)))
                held += len(todo[-1][2])
                if held >= _UNITS:
                    self._encode(todo, out)
                    todo, held = [], 0
        self._encode(todo, out)
        return out

    def _encode(self, todo: list[tuple[int, int, list[str]]], out: list[bytes | None]) -> None:
        if not todo:
            return
        sizes = [len(units) for _, _, units in todo]
        units = list(chain.from_iterable(units for _, _, units in todo))
        bases = np.repeat(np.array([self._base(key) for _, key, _ in todo], np.uint64), sizes)
        places = np.arange(len(units)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        whole = self.whole
        if len(whole) > self.keep:
            whole.clear()
        if not whole:
            whole[""] = 0, np.array([self.bytes_at[b] for b in MARK.encode()], self.dtype).tobytes()
        if new := list(set(filterfalse(whole.__contains__, units))):
            ids, merges = self._segments(new, None, np.zeros(len(new), np.int64))
            whole.update(zip(new, zip(merges, ids)))
        found = list(map(whole.__getitem__, units))
        ids = list(map(itemgetter(1), found))
        skips = np.flatnonzero(self._gaps(bases, np.zeros(1, np.int64), places) < np.fromiter(map(itemgetter(0), found), np.int64, len(units)))
        if len(skips):
            again, _ = self._segments([units[i] for i in skips.tolist()], bases[skips], places[skips])
            for i, b in zip(skips.tolist(), again):
                ids[i] = b
        at = 0
        for (i, _, _), n in zip(todo, sizes):
            out[i] = b"".join(ids[at : at + n])
            at += n

    def decode(self, ids: bytes) -> str:
        size = np.dtype(self.dtype).itemsize
        rest = len(ids) % size
        got = np.minimum(np.frombuffer(ids[: len(ids) - rest], self.dtype), len(self.out) - 1)
        text = b"".join(map(self.out.__getitem__, got.tolist())).decode(errors="replace") + "\ufffd" * bool(rest)
        return text.removeprefix(" ")


def encoder(path: str, dropout: float = 0.0, seed: int = 0) -> DropoutEncoder:
    """One for each Python worker and setting; it lives on from task to task."""
    known = memory("sp_dropout")
    key = (path, dropout, seed)
    if key not in known:
        known[key] = DropoutEncoder(path, dropout, seed)
    return known[key]


def _names(df: DataFrame, name: str) -> list[str]:
    return [c for c in df.columns if c.lower() != name.lower()]


def _with(df: DataFrame, names: list[str], name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in names), T.StructField(name, kind)])


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with the ids as little-endian integers of 16 bits (32 for over 65,536 pieces) in ``out_col``."""
    names = [c for c in keep or docs.columns if c.lower() != out_col.lower()]
    key = fresh("key", docs.columns)
    rows, at = with_text(docs.withColumn(key, F.xxhash64(F.col(id_col), F.lit(seed))), [*names, key], text_col, "units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path, dropout, seed)
        for batch in slices(batches):
            ids = enc.encode_all(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(ids, pa.binary())], names=[*names, out_col])

    return rows.mapInArrow(run, _with(docs, names, out_col, T.BinaryType()))


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``out_col``."""
    names = _names(encoded, out_col)
    rows = encoded.select(*(f"`{c}`" for c in names), F.col(ids_col).alias(fresh("encoded", names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in slices(batches):
            *kept, ids = batch.columns
            texts = [None if x is None else enc.decode(x) for x in ids.to_pylist()]
            yield pa.record_batch([*kept, pa.array(texts, pa.string())], names=[*names, out_col])

    return rows.mapInArrow(run, _with(encoded, names, out_col, T.StringType()))
