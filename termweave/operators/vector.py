"""Vector retrieval: exact nearest neighbours by cosine, over cells that the triangle inequality rules out.

Angles between vectors are a metric. Centres are drawn from the corpus and each vector
belongs to the cell of its nearest centre; a cell's radius is the widest angle in it, so
nothing in it is nearer to a query than the query's angle to the centre less the
radius. A query first looks into its nearest cells, until they hold enough; the k-th
angle found there rules out every cell that can't hold a nearer vector, and the others
are compared. So results are exact, whatever the vectors; how much is compared depends on
how they cluster.

Vectors of a cell are dealt into blocks of bounded bytes, and queries of a cell
likewise if there are many; a (cell, block, query block) is one group, compared by one
matrix product. What goes to every executor is the centres, whose bytes are bounded
by a parameter. Building an index and asking it runs jobs: the first draws centres, the second
writes the corpus by cells, the third counts it, and ``knn`` finds the first angles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.numbers import unit_score
from termweave.operators.dedup import top_by
from termweave.sources.sinks import spread, staged

#: Centres drawn, and the most bytes of them; bytes of a block of vectors, and of the scores compared at a time.
CELLS, CENTRE_BYTES, BLOCK_BYTES, SCORE_BYTES = 1024, 16_000_000, 16_000_000, 32_000_000
#: Domains share so many separate sets of cells; cosines are ranked to 1e-9; what doubles may be off by, in an angle.
PARTS, TIE, SLACK = 64, 1e-9, 1e-7
#: Vectors whose angles to the centres are held at once, and copies of queries that are passed on at once.
ROWS, COPIES = 512, 8192
WIDEST = 4.0  # more than any angle


def _part(vector: Column, domain: Column) -> Column:
    """Vectors that can be compared share a part: their length, and a number for their domain."""
    return (F.size(vector) * PARTS + F.pmod(F.hash(domain), F.lit(PARTS))).cast("long")


def _rows(df: DataFrame, key: str, by_domain: bool) -> DataFrame:
    """key, domain, vector, part of the vectors that have a direction; all of one domain unless ``by_domain``."""
    domain = F.col("domain").cast("string") if by_domain else F.lit("")
    found = df.select(key, domain.alias("domain"), F.col("vector").cast("array<double>").alias("vector"))
    found = found.where("domain is not null and vector is not null").where(F.exists("vector", lambda x: x != 0) & F.forall("vector", lambda x: x.isNotNull()))
    return found.withColumn("part", _part(F.col("vector"), F.col("domain")))


def _units(vectors: pa.Array) -> np.ndarray:
    m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return m / np.sqrt((m * m).sum(1))[:, None]


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def _by_part(batch: pa.RecordBatch, part: int, vector: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Part, rows and unit vectors of each part of a batch, ``ROWS`` at most at a time: each meets every centre."""
    parts = batch.column(part).to_numpy()
    for p in np.unique(parts).tolist():
        whole = np.flatnonzero(parts == p)
        for low in range(0, len(whole), ROWS):
            at = whole[low : low + ROWS]
            yield p, at, _units(batch.column(vector).take(pa.array(at)))


@dataclass(frozen=True)
class CellIndex:
    """``rows``: key, domain, vector, cell, block, written once. ``cells``: by part, the cells' numbers, centres, sizes, radii and blocks.

    A part none of whose vectors became a centre is one cell, which no angle rules out.
    """

    rows: DataFrame
    cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    by_domain: bool

    @staticmethod
    def build(corpus: DataFrame, by_domain: bool = True, cells: int = CELLS, centre_bytes: int = CENTRE_BYTES) -> CellIndex:
        """An index of ``corpus`` (vec_id, vector, domain).

        Centres are the rows of least id hash, as many as the root of all rows, ``cells``
        and ``centre_bytes`` at most; they reach the driver.
        """
        rows = _rows(spread(corpus), "vec_id", by_domain)
        n, widest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
        cells = min(cells, int(np.ceil(np.sqrt(n))))
        drawn = rows.select("part", "vector", F.xxhash64("vec_id").alias("h")).orderBy("h", "part").limit(max(1, min(cells, centre_bytes // (8 * widest)))).collect()
        centres: dict[int, np.ndarray] = {}
        for p in sorted({r.part for r in drawn}):
            m = np.unique(np.array([r.vector for r in drawn if r.part == p]), axis=0)
            centres[p] = m / np.sqrt((m * m).sum(1))[:, None]
        first = dict(zip(centres, np.cumsum([0, *map(len, centres.values())])[:-1].tolist()))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, angle = np.empty(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                for p, at, units in _by_part(batch, 3, 2):
                    if p in centres:
                        found = _angles(units, centres[p])
                        cell[at] = first[p] + found.argmin(1)
                        angle[at] = found.min(1)
                    else:
                        cell[at] = -1 - p
                yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(angle)], names=["vec_id", "domain", "vector", "part", "cell", "angle"])

        key = dict(rows.dtypes)["vec_id"]
        rows = staged(rows.mapInArrow(assign, f"vec_id {key}, domain string, vector array<double>, part long, cell long, angle double"), "cells")
        found = {}
        for r in rows.groupBy("part", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).orderBy("cell").collect():  # a row a cell
            width = r.part // PARTS
            centre = centres[r.part][r.cell - first[r.part]] if r.cell >= 0 else np.zeros(width)
            found.setdefault(r.part, []).append((r.cell, centre, r.n, r.radius if r.cell >= 0 else WIDEST, -(-r.n * 8 * width // BLOCK_BYTES)))
        return CellIndex(rows, {p: tuple(map(np.array, zip(*c))) for p, c in found.items()}, by_domain)

    def _planned(self, asked: DataFrame, k: int | None, after: bool, blocks: dict[int, int]) -> DataFrame:
        """query, domain, vector, cell, block, qblock of what each of ``asked`` (query, domain, vector, part, h, angle) is compared with.

        With ``k`` the nearest cells, until they hold more than k vectors; ``after`` that the
        others that ``angle`` doesn't rule out. Without, all that it doesn't.
        """
        cells = self.cells

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, cell, block = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
                for p, at, units in _by_part(batch, 3, 2):
                    if p not in cells:
                        continue
                    ids, centres, sizes, radii, count = cells[p]
                    angles = _angles(units, centres)
                    wanted = angles - radii[None, :] - SLACK <= batch.column(5).to_numpy()[at][:, None]
                    if k is not None:
                        order = np.argsort(angles, axis=1, kind="stable")
                        held = np.cumsum(sizes[order], axis=1) - sizes[order]
                        first = np.zeros_like(wanted)
                        np.put_along_axis(first, order, held <= k, axis=1)  # the query itself may be one
                        wanted = wanted & ~first if after else first
                    r, c = np.nonzero(wanted)
                    times = count[c]
                    rows.append(np.repeat(at[r], times))
                    cell.append(np.repeat(ids[c], times))
                    block.append(np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
                r, c = np.concatenate(rows), np.concatenate(cell)
                split = np.array([blocks.get(x, 1) for x in c.tolist()], np.int64)
                b = np.concatenate(block)
                for low in range(0, max(1, len(r)), COPIES):
                    some = slice(low, low + COPIES)
                    kept = batch.take(pa.array(r[some], pa.int64()))
                    qblock = kept.column(4).to_numpy() % split[some] if len(r) else split
                    yield pa.record_batch([*kept.columns[:3], pa.array(c[some], pa.int64()), pa.array(b[some], pa.int64()), pa.array(qblock, pa.int64()), kept.column(5)], names=["query", "domain", "vector", "cell", "block", "qblock", "angle"])

        key = dict(asked.dtypes)["query"]
        return asked.mapInArrow(plan, f"query {key}, domain string, vector array<double>, cell long, block long, qblock long, angle double")

    def compare(self, asked: DataFrame, most: int, k: int | None = None, after: bool = False, least: float | None = None, split: bool = False) -> DataFrame:
        """query, vec_id, cosine, near: the best ``most`` of each group that a query meets, near being the cosine to 1e-9.

        ``split`` deals a cell's queries into blocks, for which it counts them first.
        """
        blocks: dict[int, int] = {}
        if split:
            counts = self._planned(asked, k, after, {}).where("block = 0").groupBy("cell").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("w")).collect()  # a row a cell
            blocks = {r.cell: n for r in counts if (n := -(-r.n * 8 * r.w // BLOCK_BYTES)) > 1}
        left = self._planned(asked, k, after, blocks)
        dealt = {int(c): int(n) for part in self.cells.values() for c, n in zip(part[0], part[4]) if n > 1}
        number = lambda of: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x).cast("long") for pair in of.items() for x in pair)), F.col("cell")), F.lit(1)) if of else F.lit(1).cast("long")
        right = self.rows.select("vec_id", "domain", "vector", "cell", F.pmod(F.xxhash64("vec_id"), number(dealt)).alias("block"))
        right = right.withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), number(blocks) - 1)) if blocks else F.lit(0).cast("long"))
        queries, keys = dict(left.dtypes)["query"], dict(right.dtypes)["vec_id"]
        by_domain = self.by_domain

        def best(_key: tuple, one: pa.Table, many: pa.Table) -> pa.Table:
            return _best(one, many, most, least, by_domain)

        group = ["cell", "block", "qblock"]
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(best, f"query {queries}, vec_id {keys}, cosine double, near double")

    def share(self, queries: DataFrame, k: int) -> float:
        """The share of the pairs of ``queries`` with the vectors of their part that ``knn`` compares."""
        asked = _asked(queries, self.by_domain)
        size = {int(c): int(n) for part in self.cells.values() for c, n in zip(part[0], part[2])}
        count = lambda df: sum(size[r.cell] * r["count"] for r in df.where("block = 0").groupBy("cell").count().collect())
        near = _bounded(asked, self.compare(asked, k, k), k)
        of = sum(int(self.cells[r.part][2].sum()) * r["count"] for r in asked.groupBy("part").count().collect() if r.part in self.cells)
        return (count(self._planned(asked, k, False, {})) + count(self._planned(near, k, True, {}))) / max(1, of)


def _best(one: pa.Table, many: pa.Table, most: int, least: float | None, by_domain: bool) -> pa.Table:
    """The best ``most`` rows of ``many`` for each query of ``one``, ties to the smaller id; none below a query's own bound."""
    names = ["query", "vec_id", "cosine", "near"]
    kinds = [one.schema.field("query").type, many.schema.field("vec_id").type, pa.float64(), pa.float64()]
    out: list[tuple] = []
    if one.num_rows and many.num_rows:
        rows, asked = (_units(t.column("vector").combine_chunks()) for t in (many, one))
        ids, own = many.column("vec_id").to_pylist(), one.column("query").to_pylist()
        place = {i: n for n, i in enumerate(sorted(set(ids)))}
        rank = np.array([place[i] for i in ids])
        at = {}
        for n, i in enumerate(ids):
            at.setdefault(i, []).append(n)
        domains = np.unique(np.array(one.column("domain").to_pylist() + many.column("domain").to_pylist(), object).astype(str), return_inverse=True)[1] if by_domain else None
        floor = np.cos(np.minimum(one.column("angle").to_numpy(), np.pi)) - 2 * TIE if least is None else np.full(len(own), least)
        step = max(1, SCORE_BYTES // (8 * len(ids)))
        for low in range(0, len(own), step):
            cosines = asked[low : low + step] @ rows.T
            fits = cosines >= floor[low : low + step, None]
            if domains is not None:
                fits &= domains[low : low + len(cosines), None] == domains[None, len(own) :]
            for i, (scores, possible) in enumerate(zip(cosines, fits), low):
                for n in at.get(own[i], ()):
                    possible[n] = False
                found = np.flatnonzero(possible)
                if not len(found):
                    continue
                near = np.round(scores[found], 9)
                if len(found) > most:
                    keep = near >= -np.partition(-near, most - 1)[most - 1]
                    found, near = found[keep], near[keep]
                order = np.lexsort((rank[found], -near))[:most]
                out += [(own[i], ids[n], float(scores[n]), float(v)) for n, v in zip(found[order].tolist(), near[order].tolist())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, kinds)], names=names)


def _asked(queries: DataFrame, by_domain: bool) -> DataFrame:
    rows = _rows(queries.withColumnRenamed("query_id", "query"), "query", by_domain)
    return rows.withColumn("h", F.pmod(F.xxhash64("query"), F.lit(1 << 40))).withColumn("angle", F.lit(WIDEST))


def _bounded(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``asked`` with the angle of the k-th of ``found``; any angle where there are fewer."""
    last = top_by(found, ["query"], k, F.desc("near"), F.col("vec_id").asc(), rank="n").where(F.col("n") == k)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("near") - 2 * TIE))).alias("found_angle")
    return asked.drop("angle").join(last.select("query", angle), "query", "left").withColumn("angle", F.coalesce("found_angle", F.lit(WIDEST))).drop("found_angle")


def _many(asked: DataFrame) -> bool:
    """Whether the queries are more than one block can hold."""
    return asked.agg(F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0)) * 8).first()[0] > BLOCK_BYTES


def knn(queries: DataFrame, corpus: DataFrame | CellIndex, k: int = 3, by_domain: bool = True) -> DataFrame:
    """The ``k`` nearest for each query, with rank, cosine and score (1 + cosine) / 2; ties to 1e-9 by vec_id.

    ``queries`` has query_id, vector, domain; ``corpus`` vec_id, vector, domain, or is
    an index of them. A query's own id is no neighbour. Null and zero vectors take no part, nor
    do vectors of another length or, with ``by_domain``, another domain.
    """
    index = corpus if isinstance(corpus, CellIndex) else CellIndex.build(corpus, by_domain)
    asked = _asked(queries, index.by_domain)
    split = _many(asked)
    first = staged(index.compare(asked, k, k, split=split), "nearest")  # at most k rows a query and cell looked into
    rest = index.compare(_bounded(asked, first, k), k, k, after=True, split=split)
    best = top_by(first.unionByName(rest), ["query"], k, F.desc("near"), F.col("vec_id").asc(), rank="rank")
    return best.select(F.col("query").alias("query_id"), "vec_id", "rank", "cosine", unit_score(F.col("cosine")).alias("score"))


def within(queries: DataFrame, corpus: DataFrame | CellIndex, least: float = 0.7, most: int = 10) -> DataFrame:
    """query_id, vec_id, rank, cosine: the nearest ``most`` of all domains whose cosine is at least ``least``."""
    index = corpus if isinstance(corpus, CellIndex) else CellIndex.build(corpus, by_domain=False)
    asked = _asked(queries, index.by_domain).withColumn("angle", F.lit(float(np.arccos(max(-1.0, min(1.0, least - TIE))))))
    found = index.compare(asked, most, least=least, split=_many(asked))
    best = top_by(found, ["query"], most, F.desc("near"), F.col("vec_id").asc(), rank="rank")
    return best.select(F.col("query").alias("query_id"), "vec_id", "rank", "cosine")
