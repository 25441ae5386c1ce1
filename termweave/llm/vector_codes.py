"""Vector codes by product quantisation: codebooks by Lloyd's rounds that move only what changed.

A vector of whole components is cut into equal parts; each part has a codebook. A round
assigns every part of every vector to its nearest entry, then moves each entry to the
mean of its parts. The assignments of a round are written with the vectors, and sums
and counts of each entry are kept from round to round: a round adds the parts that came
to an entry and takes away those that left it. Only parts whose assignment changed
contribute, added up within each task before the shuffle, so a round moves at most
parts * entries * (width / parts + 1) numbers a task, however many rows there are; an
entry of a third of all rows is one row a task. Sums, distances and means are whole numbers
and exact, whatever the order.

What reaches the driver is the codebooks and their sums: entries * width numbers, by parameters.

Defined cases: vectors that are null or hold null or non-finite components take no part;
nor do those whose length isn't that of the first kept row's, or if that can't be cut
evenly. The rows of the least ids start the codebooks, null ids after all others, the
lesser vector first among equal ids; with fewer rows there are fewer entries, an empty
table has an empty result. Repeated rows count as often as they occur. Components whose
scaled size reaches 2^52 raise, as does a row's distance that no long holds. Ties go to the lower entry. Columns of the input that clash give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm import store
from termweave.llm.workers import slices

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows compared at a time.
ROWS = 2048
#: Whole numbers below are exact as doubles.
EXACT = 1 << 53


def whole(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component; null for a vector that takes no part."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    large = F.raise_error(F.lit("a component is too large for its code")).cast("long")
    one = lambda x: F.when(F.abs(x.cast("double")) * scale < float(1 << 52), F.floor(F.lit(float(scale)) * x.cast("double"))).otherwise(large)
    return F.when(fits, F.transform(vector, one))


@dataclass(frozen=True)
class Codebooks:
    """``entries[p][k]``: entry k of part p, as whole numbers."""

    entries: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part of ``rows`` and its squared distance."""
        parts, count, width = self.entries.shape
        codes = np.empty((len(rows), parts), np.uint8)
        largest = max(int(np.abs(rows).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        fast = 4 * largest * largest * width < EXACT  # every term below is then a whole number that doubles hold
        far = np.empty((len(rows), parts), np.int64 if fast else object)
        for p in range(parts):
            x, c = rows[:, p * width : (p + 1) * width], self.entries[p]
            if fast:
                x, c = x.astype(np.float64), c.astype(np.float64)
                d = (c * c).sum(1)[None, :] - 2 * (x @ c.T) + (x * x).sum(1)[:, None]
            else:
                d = ((x.astype(object)[:, None, :] - c.astype(object)[None, :, :]) ** 2).sum(2)
            codes[:, p] = d.argmin(1)
            far[:, p] = d[np.arange(len(rows)), codes[:, p]]
        return codes, far


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` (row, vector, code) with the assignment before in was, the new one in code and the distances summed in error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            row, vector, was = batch.columns
            codes, far = books.nearest(_matrix(vector))
            error = pa.array([int(x) for x in far.sum(1)], pa.int64())
            yield pa.record_batch([row, vector, was, pa.array([c.tobytes() for c in codes], pa.binary()), error], names=["row", "vector", "was", "code", "error"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "vector", "code").mapInArrow(run, f"row {kind}, vector array<bigint>, was binary, code binary, error bigint")


def _moves(rows: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """part, entry, at, delta: what ``rows`` (vector, was, code) add to and take from sums; ``at`` is a place in the part, its width stands for the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), object)  # of the task, exact beyond 64 bits
        for batch in slices(batches, ROWS):
            x = _matrix(batch.column(0)).reshape(batch.num_rows, parts, width)
            new = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, parts)
            old = np.stack([np.full(parts, -1, np.int16) if b is None else np.frombuffer(b, np.uint8).astype(np.int16) for b in batch.column(1).to_pylist()])
            for p in range(parts):
                moved = np.flatnonzero(old[:, p] != new[:, p])
                some = np.zeros((entries, width + 1), np.int64)
                ones = np.concatenate([x[moved, p], np.ones((len(moved), 1), np.int64)], axis=1)
                np.add.at(some, new[moved, p], ones)
                left = old[moved, p] >= 0
                np.subtract.at(some, old[moved, p][left], ones[left])
                sums[p] += some
        part, entry, at = np.nonzero(sums)
        yield pa.record_batch(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(at, pa.int32()), pa.array([str(v) for v in sums[part, entry, at]], pa.string())], names=["part", "entry", "at", "delta"]
        )

    changed = rows.where(F.col("was").isNull() | (F.col("was") != F.col("code"))).select("vector", "was", "code")
    out = changed.mapInArrow(run, "part int, entry int, at int, delta string")
    return out.groupBy("part", "entry", "at").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("delta"))


def encode(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
    keep: tuple[str, ...] | None = None,
) -> tuple[DataFrame, Codebooks]:
    """The columns ``keep`` (all) of the kept rows with code (a byte a part) and error (its squared distance), and the codebooks.

    Each round's rows are written in the shared folder; a lost executor repeats its tasks of one round.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    spark = rows.sparkSession
    names = [f"`{c}`" for c in rows.columns if c.lower() not in ("code", "error") and (keep is None or c in keep)]
    ready = rows.select(F.struct(*names).alias("row"), F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), scale).alias("vector")).where("vector is not null")
    first = ready.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()  # the codebooks' start
    width = len(first[0].vector) if first else 0
    if width == 0 or width % parts:
        none = ready.where(F.lit(False)).select("row.*", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        return none, Codebooks(np.zeros((parts, 0, 0), np.int64))
    start = np.array([r.vector for r in first if len(r.vector) == width], np.int64)
    books = Codebooks(start.reshape(len(start), parts, width // parts).transpose(1, 0, 2).copy())
    now = ready.where(F.size("vector") == width).select("row", "vector", F.lit(None).cast("binary").alias("code"))
    sums = np.zeros((parts, len(start), width // parts + 1), object)
    for _ in range(rounds):
        now = store.materialize(_assigned(now, books), "assigned")
        for r in _moves(now, parts, len(start), width // parts).collect():
            sums[r.part, r.entry, r["at"]] += int(r.delta)
        moved = books.entries.copy()
        used = sums[:, :, -1] > 0
        moved[used] = (sums[used][:, :-1] // sums[used][:, -1:]).astype(np.int64)
        books = Codebooks(moved)
    done = _assigned(now, books).select("row.*", "code", "error")
    return done, books


def label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with label_error, the error summed over rows of the same label; nulls are one.

    Sums are made within tasks first, so a label of a third of all rows is a row a task; their table is joined by its size.
    """
    sums = coded.groupBy(F.col(label_col).alias("_of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col(label_col).eqNullSafe(F.col("_of"))).drop("_of")
