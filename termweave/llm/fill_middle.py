"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put together again behind sentinels.

A unit is a run of ASCII letters or any other character. One scan of the UTF-8 bytes
by a table-driven automaton finds where units and characters start (a byte that
continues a character starts neither) and whether a sentinel stands in the text. Each
transition carries what it emits; sums of these count units and characters, and a
second pass finds, for the units drawn, the bytes to cut at.

The automaton forgets all but the last two bytes: from any state they lead to the same
one. So a batch of texts, with a byte between them that resets it, is cut into lanes
that start two bytes early and are scanned side by side, a table lookup for all lanes
at a step. A text of any length is spread over lanes like many short ones.

Defined cases: a null text counts as empty and stays plain; a null id is drawn for like
an empty one; equal ids draw equal hashes, so repeated rows have equal results. Bytes
that aren't UTF-8 cut where a character could start. Columns of the input that clash give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What a transition emits: the start of a unit, the start of a character, the end of a sentinel.
UNIT, CHAR, SENTINEL = 1, 2, 4
#: Between texts; no byte of UTF-8.
RESET = 0xFF
#: States: nothing open, in letters, after "<", after "<" and a sentinel's letter.
OPEN, LETTERS, LESS, NAMED = range(4)
#: Bytes after which the state no longer depends on where the scan began.
MEMORY = 2
#: Bytes scanned at a time, and of a lane.
BATCH, LANE = 4_000_000, 1_024


def _table() -> np.ndarray:
    """next state * 8 + emission, by state * 256 + byte."""
    out = np.empty((4, 256), np.uint8)
    for state in range(4):
        for b in range(256):
            letter = 65 <= b <= 90 or 97 <= b <= 122
            if b == RESET:
                to, emits = OPEN, 0
            elif 0x80 <= b < 0xC0:
                to, emits = OPEN, 0
            elif letter:
                named = state == LESS and chr(b) in (PREFIX + SUFFIX + MIDDLE).replace("<", "").replace(">", "")
                to, emits = NAMED if named else LETTERS, CHAR | (0 if state in (LETTERS, NAMED) else UNIT)
            else:
                to, emits = LESS if b == ord("<") else OPEN, CHAR | UNIT | (SENTINEL if state == NAMED and b == ord(">") else 0)
            out[state, b] = to * 8 + emits
    return out.ravel()


TABLE = _table()


def emissions(data: np.ndarray) -> np.ndarray:
    """What the automaton emits at each byte of ``data``, begun with nothing open."""
    n = len(data)
    lanes = -(-n // LANE)
    padded = np.full((lanes * LANE) + MEMORY, RESET, np.uint8)
    padded[MEMORY : MEMORY + n] = data
    steps = np.lib.stride_tricks.as_strided(padded, (LANE + MEMORY, lanes), (1, LANE)).copy()  # step by step, the lanes side by side
    out = np.empty((LANE, lanes), np.uint8)
    state = np.zeros(lanes, np.intp)
    for i in range(LANE + MEMORY):
        moved = TABLE[state * 256 + steps[i]]
        state = (moved >> 3).astype(np.intp)
        if i >= MEMORY:
            out[i - MEMORY] = moved & 7
    return out.T.ravel()[:n]


def _batches(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts of about ``BATCH`` bytes; a longer text is one of its own."""
    out, low = [], 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BATCH, "right")) - 1)
        out.append((low, high))
        low = high
    return out


def cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
    """n, sentinel, prefix_chars, middle_chars of each text, the places drawn by two numbers for each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out = {name: np.zeros(len(texts), np.int64) for name in ("n", "sentinel", "prefix_chars", "middle_chars")}
    for low, high in _batches(offsets):
        size = offsets[low + 1 : high + 1] - offsets[low:high]
        start = np.cumsum(size + 1) - size - 1  # each text is followed by the byte that resets
        data = np.full(int(size.sum()) + len(size), RESET, np.uint8)
        if len(size) == 1:
            data[:-1] = body[offsets[low] : offsets[high]]
        else:
            data[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = body[offsets[low] : offsets[high]]
        found = emissions(data)
        end = start + size
        units, chars = np.flatnonzero(found & UNIT), np.flatnonzero(found & CHAR)
        ahead = np.searchsorted(units, start)
        n = np.searchsorted(units, end) - ahead
        cut = np.sort(np.stack([first[low:high] % (n + 1), second[low:high] % (n + 1)]), axis=0)
        # The second pass: unit k of a text starts at the byte to cut at; the last cut may be the text's end.
        at = np.where(cut < n, np.append(units, 0)[np.minimum(ahead + cut, len(units))], end)
        before = np.searchsorted(chars, np.stack([start, at[0], at[1]]))
        ends = np.flatnonzero(found & SENTINEL)
        out["n"][low:high] = n
        out["sentinel"][low:high] = np.searchsorted(ends, end) - np.searchsorted(ends, start)
        out["prefix_chars"][low:high], out["middle_chars"][low:high] = before[1] - before[0], before[2] - before[1]
    return out


def _scanned(text: Column, first: Column, second: Column) -> Column:
    @F.arrow_udf("struct<n:long,sentinel:long,prefix_chars:long,middle_chars:long>")
    def run(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        found = cuts(texts, a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(v) for v in found.values()], names=list(found))

    return run(text, first, second)


def _drawn(key: Column, i: int) -> Column:
    """Number ``i``, from 0, of the hash ``key``: 8 hexadecimal digits."""
    return F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output.

    ``percent`` of the texts are rearranged, ``spm_percent`` of these with the suffix first.
    The text itself stays with its row; Python sees it once and returns four numbers.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    names = [f"`{c}`" for c in docs.columns if c.lower() not in added]
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*names).alias("_row"), text.alias("_text"), key.alias("_key"))
    rows = rows.withColumn("_cut", _scanned(F.col("_text"), _drawn(F.col("_key"), 0), _drawn(F.col("_key"), 1)))
    plain = (F.col("_text") == "") | (F.col("_cut.sentinel") > 0) | (_drawn(F.col("_key"), 2) % 100 >= percent)
    form = F.when(plain, "plain").when(_drawn(F.col("_key"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    p, m = F.col("_cut.prefix_chars").cast("int"), F.col("_cut.middle_chars").cast("int")
    prefix, middle, suffix = F.substr("_text", F.lit(1), p), F.substr("_text", p + 1, m), F.substr("_text", p + m + 1)
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    cut = lambda c: F.when(F.col("form") != "plain", F.col(f"_cut.{c}")).alias(c)
    return rows.withColumn("form", form).select("_row.*", F.col("_cut.n").alias("n"), "form", cut("prefix_chars"), cut("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output. A text that is rearranged holds no sentinel, and none arises at a cut, so each stands once."""
    between = lambda left, right: F.substring_index(F.substring_index(output, right, 1), left, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
