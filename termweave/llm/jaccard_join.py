"""Exact n-gram Jaccard join and its groups, as a join in a metric space.

Jaccard distance, one less the similarity, is a metric. Documents of the same
shingle set form a class; classes are joined in rounds:

* Every class posts its ``KEYS`` smallest shingle hashes (all, if it has fewer). Of
  the ``KEYS`` smallest of two linked classes together each is in both with the
  chance of their similarity, so they share at least ``least_shared(percent)`` but
  for a chance below ``MISS``, and for certain where both post all.
* Keys of at most ``most`` classes are cool: the classes of such a cell are pairs,
  and compared unless they share too few keys, all hot ones taken as shared. A class
  with so many cool keys that a linked one shares some is done; one without is busy.
  With ``exact``, and where the similarity is too low for a sample, all are busy.
* Busy classes post all their hashes. A class that has more cool ones than a linked
  class can lack is done in the same way, for certain; the others are the core.
* The core falls into regions, chained by hot shingles; a link never leaves one. The
  region's pivot is the set of the shingles that most of it have. By the triangle
  inequality two sets differ in no more than both differ from the pivot, so all that
  are close to it are linked without a comparison; their star is one link each.
* What lies further out is compared with the classes in its own ring around the
  pivot and the next ones, each as wide as the radius, since by the same inequality
  a link spans no more: the window replicates a class to its boundary rings. Blocks
  of at most about ``BLOCK`` classes meet in cells, each cell its own group of a task.

Near copies cost a distance to the pivot each, and a common passage costs nothing
between documents that share nothing else. All comparisons are exact. Distances to
documents as pivots hardly separate texts, whose distance is nearly always 1; hence
the keys, which find the regions, and pivots that are sets rather than documents.
Links are joined to groups by the alternating star method.

Defined cases: words are separated by ASCII white space and compared with A-Z
lower-cased; a text of fewer than ``n`` words is one shingle; a null, empty or blank
text has none and links with nothing. A null doc_id keeps its row and never gives a
group its name unless all ids of the group are null. Rows that repeat an id stay.
Columns besides id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import store
from termweave.llm.workers import memory, slices

KEYS = 48
#: The chance that a linked pair is missed for sharing too few of the keys.
MISS = 1e-12
#: Documents of a block, and bytes of their hashes, beyond which it is split.
BLOCK, BLOCK_BYTES = 512, 32_000_000
#: Rows of a table that is broadcast, at 16 bytes and the hash table each.
MOST_BROADCAST = 500_000


class Shingler:
    """Sorted 64-bit hashes of a text's distinct shingles of ``n`` words."""

    def __init__(self, n: int, keep: int = 400_000):
        self.n, self.keep = n, keep
        self.known: dict[bytes, int] = {}
        draw = np.random.RandomState(11)
        self.odd = [np.uint64(int(x) * 2 + 1) for x in draw.randint(1 << 40, 1 << 62, n)]

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def hashes(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []  # bytes: ASCII only
        if len(words) < self.n:
            return np.array([xxhash.xxh64_intdigest(b"\0".join(words), seed=len(words))] if words else [], np.uint64)
        known = self.known
        if len(known) > self.keep:
            known.clear()
        for w in set(filterfalse(known.__contains__, words)):
            known[w] = xxhash.xxh64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = len(words) - self.n + 1
        h = ids[:size] * self.odd[0]
        for k in range(1, self.n):
            h = self._mix(h) + ids[k : k + size] * self.odd[k] if k == 1 else h + self._mix(ids[k : k + size] * self.odd[k])
        return np.unique(self._mix(h))


def shingler(n: int) -> Shingler:
    """One for each Python worker; it lives on from task to task."""
    known = memory("jaccard_join")
    if n not in known:
        known[n] = Shingler(n)
    return known[n]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def class_of(hashes: np.ndarray) -> int:
    """A 64-bit name of a shingle set."""
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), seed=len(hashes)))


def shingled(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row_id, n_shingles, class and keys of every row; class is null for a text without words."""
    rows = docs.select("doc_id", "row_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = shingler(n)
        for batch in slices(batches):
            sizes, classes, keys, cuts = [], [], [], [0]
            for text in batch.column(2).to_pylist():
                h = make.hashes(text)
                sizes.append(len(h))
                classes.append(class_of(h) if len(h) else None)
                keys.append(h[:KEYS])
                cuts.append(cuts[-1] + len(keys[-1]))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))],
                names=["doc_id", "row_id", "n_shingles", "class", "keys"],
            )

    return rows.mapInArrow(run, "doc_id long, row_id long, n_shingles long, class long, keys array<long>")


def least_shared(percent: int) -> int:
    """So many of ``KEYS`` keys are shared at a similarity of ``percent`` or more, but for a chance of at most ``MISS``; 0 if none need be."""
    p, chance, k = percent / 100, 0.0, 0
    while k < KEYS:
        chance += math.comb(KEYS, k) * p**k * (1 - p) ** (KEYS - k)  # of sharing k or fewer
        if chance > MISS:
            break
        k += 1
    return k


def _sets(of: DataFrame, classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """A table of class and its sorted hashes, made again from one text of each class in ``of`` (class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = shingler(n)
        for batch in slices(batches):
            found = [make.hashes(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([class_of(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], names=["class", "hashes"])

    asked = store.materialize(of.select("class"), "asked")
    ids = store.materialize(classes.join(_small(asked), "class", "left_semi").select(F.col("rep").alias("row_id")), "representatives")
    texts = docs.where(F.col("text").isNotNull()).join(_small(ids), "row_id", "left_semi").select("text")
    made = store.materialize(texts.mapInArrow(run, "class long, hashes binary"), "sets")
    # Every class asked for has a row; more of them come from rows that repeat an id.
    return made if made.count() == ids.count() else store.materialize(made.dropDuplicates(["class"]), "sets")


def _hash_rows(sets: DataFrame) -> DataFrame:
    """class, n_shingles, posted and key for each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            some = [np.frombuffer(h.as_buffer(), np.int64) for h in batch.column(1)]
            sizes = np.array([len(h) for h in some], np.int64)
            cols = [np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(sizes, sizes), np.repeat(sizes, sizes), np.concatenate(some)]
            yield pa.record_batch([pa.array(c) for c in cols], names=["class", "n_shingles", "posted", "key"])

    return sets.mapInArrow(run, "class long, n_shingles long, posted long, key long")


def _intersections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        common, union = [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            same = int(np.count_nonzero(y[at] == x))
            common.append(same)
            union.append(len(x) + len(y) - same)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "common", "total"])


def _small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, read from a table, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """``pairs`` (a, b) of classes with the sizes of intersection (common) and union (total).

    The hashes of the classes in question are made again from one text each, which
    is cheaper than keeping the hashes of all.
    """
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    sets = _sets(needed, classes, docs, n)
    both = pairs.join(sets.withColumnsRenamed({"class": "a", "hashes": "x"}), "a").join(sets.withColumnsRenamed({"class": "b", "hashes": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_intersections, "a long, b long, common long, total long")


def _posted(postings: DataFrame, most: int) -> DataFrame:
    """``postings`` (class, n_shingles, posted, key) with the number of members of each key and its pivot; lone keys are left out."""
    stats = postings.groupBy("key").agg(F.count("*").alias("members"), F.min("class").alias("pivot")).where("members > 1")
    keys = store.materialize(stats, "keys")
    posted = store.materialize(postings.join(_small(keys), "key"), "posted")
    store.drop(keys)
    return posted


def _cool_pairs(posted: DataFrame, most: int, percent: int) -> DataFrame:
    """Pairs (x, y) of structs that share keys of at most ``most`` members, with the number of those, ``shared``."""
    row = F.struct("class", "n_shingles", "cool")
    groups = posted.where(F.col("members") <= most).groupBy("key").agg(F.collect_list(row).alias("g"))  # at most `most` each
    pairs = groups.select("g", F.explode("g").alias("x")).select("x", F.explode(F.filter("g", lambda y: (y["class"] > F.col("x.class")) & (F.least(y["n_shingles"], F.col("x.n_shingles")) * 100 >= percent * F.greatest(y["n_shingles"], F.col("x.n_shingles"))))).alias("y"))
    return pairs.groupBy("x", "y").agg(F.count("*").alias("shared"))


def _with_cool(posted: DataFrame, most: int) -> DataFrame:
    """``posted`` with the number of its class's keys that are cool."""
    hot = posted.where(F.col("members") > most).groupBy("class").agg(F.count("*").alias("hot"))
    joined = posted.join(_small(store.materialize(hot, "hot")), "class", "left")
    return joined.withColumn("cool", F.col("posted") - F.coalesce("hot", F.lit(0))).drop("hot")


def _written(pairs: DataFrame) -> DataFrame:
    """A table of the names (a, b) of ``pairs``."""
    return store.materialize(pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")), "pairs")


def _similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    return compared(pairs, classes, docs, n).where(F.col("common") * 100 >= F.col("total") * percent).select("a", "b")


def links(classes: DataFrame, docs: DataFrame, n: int, percent: int, most: int = 32, exact: bool = False) -> DataFrame:
    """Pairs (a, b) of classes that connect all classes whose similarity is at least ``percent``.

    ``classes`` has class, n_shingles, rep and keys; ``docs`` row_id and text. With
    ``exact`` all hashes are posted, so that no link is missed by chance.
    """
    with store.scope(classes.sparkSession) as s:
        return s.keep(_links(classes, docs, n, percent, most, exact))


def _links(classes: DataFrame, docs: DataFrame, n: int, percent: int, most: int, exact: bool) -> DataFrame:
    size = F.col("n_shingles")
    sure = F.floor(size * (100 - percent) / 100) + 1  # so many shingles of a class can't all be missing from a linked one
    found, busy = None, classes.select("class")
    spark = classes.sparkSession
    # Each step's postings are deleted before texts are read for the comparison, and the sets compared before the next step.
    if not exact and (least := least_shared(percent)):
        with store.scope(spark) as s:
            first = _with_cool(_posted(classes.select("class", "n_shingles", F.size("keys").alias("posted"), F.explode("keys").alias("key")), most), most)
            hot = lambda x: F.least(F.col(f"{x}.n_shingles"), F.lit(KEYS)) - F.col(f"{x}.cool")
            # The keys that a pair shares are cool ones, which are counted, or hot in both. Where both post all they have, the keys are the sets.
            whole = F.greatest("x.n_shingles", "y.n_shingles") <= KEYS
            need = F.when(whole, F.ceil((F.col("x.n_shingles") + F.col("y.n_shingles")) * percent / (100 + percent) - 1e-9)).otherwise(least)
            pairs = s.keep(_written(_cool_pairs(first, most, percent).where(F.col("shared") + F.least(hot("x"), hot("y")) >= need)))
            enough = F.when(size <= KEYS, sure).otherwise(KEYS - least + 1)
            busy = s.keep(store.materialize(first.where(F.col("cool") < enough).select("class").distinct(), "busy"))
        with store.scope(spark) as s:
            found = s.keep(store.materialize(_similar(pairs, classes, docs, n, percent), "links"))
        if not busy.count():
            return found

    with store.scope(spark) as s:
        everything = _hash_rows(_sets(busy, classes, docs, n))
        second = _with_cool(_posted(everything, most), most)
        slack = lambda x: F.col(f"{x}.cool") - F.floor(F.col(f"{x}.n_shingles") * (100 - percent) / 100)
        pairs = s.keep(_written(_cool_pairs(second, most, percent).where(F.col("shared") >= F.greatest(slack("x"), slack("y")))))
        core = s.keep(store.materialize(second.where(F.col("cool") < sure), "core"))
    with store.scope(spark) as s:
        more = s.keep(store.materialize(_similar(pairs, classes, docs, n, percent), "links"))
    found = more if found is None else found.union(more)
    if core.limit(1).count():
        found = found.union(_regions(core, classes, docs, n, percent, most))
    return store.materialize(found.distinct(), "links")


def _regions(core: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int, most: int) -> DataFrame:
    """Links among classes that consist of hot shingles but for what a linked class may lack.

    ``core`` has class, n_shingles, key, members and pivot of all their shared shingles.
    """
    radius = 1 - percent / 100
    # Linked classes share hot shingles, so a region holds whole links. It starts as the classes that hot shingles chain.
    rays = core.where(F.col("members") > most).select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct()
    chained = store.materialize(components(rays), "chained")
    chained = chained.union(chained.select("root", "root")).distinct().withColumnsRenamed({"node": "class"})
    core = store.materialize(core.join(_small(store.materialize(chained, "regions")), "class").select("class", "n_shingles", "key", "root"), "core")
    members = core.select("root", "class").distinct().groupBy("root").agg(F.count("*").alias("members"))
    # The pivot of a region is the set of the shingles that most of it have.
    pivot = core.groupBy("root", "key").agg(F.count("*").alias("have")).join(_small(store.materialize(members, "sizes")), "root").where("have * 2 > members").select("root", "key")
    pivot = store.materialize(pivot, "pivots")
    of = store.materialize(pivot.groupBy("root").agg(F.count("*").alias("pivot_size")), "pivot_sizes")
    near = core.join(_small(pivot.withColumn("both", F.lit(1))), ["root", "key"], "left").groupBy("root", "class", "n_shingles").agg(F.sum(F.coalesce("both", F.lit(0))).alias("common"))
    near = near.join(_small(of), "root", "left").fillna(0, ["pivot_size"])
    apart = F.col("n_shingles") + F.col("pivot_size") - 2 * F.col("common")
    # Two sets differ in no more than both differ from the pivot. If the excesses over what a link allows add up to at most 0, they are linked.
    near = near.withColumn("excess", apart * (100 + percent) - F.col("n_shingles") * (100 - percent))
    near = store.materialize(near.withColumn("distance", apart / (apart + F.col("common"))), "near")
    best = store.materialize(near.groupBy("root").agg(F.min(F.struct("excess", "class")).alias("best")), "best")
    near = near.join(_small(best), "root").withColumn("linked", F.col("excess") + F.col("best.excess") <= 0)
    near = store.materialize(near.withColumn("ring", F.floor(F.col("distance") / radius)).select("root", "class", "n_shingles", "linked", "ring", F.col("best.class").alias("hub")), "rings")
    stars = near.where("linked and class <> hub").select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b"))

    # The others are compared with what lies in their ring or a neighbouring one, in cells of bounded blocks.
    blocks = lambda those: F.ceil(F.greatest(F.count(F.when(those, 1)) / BLOCK, F.sum(F.when(those, F.col("n_shingles") * 8).otherwise(0)) / BLOCK_BYTES))
    counts = near.groupBy("root", "ring").agg(blocks(F.lit(True)).alias("blocks"), blocks(~F.col("linked")).alias("open_blocks"))
    counts = _small(store.materialize(counts, "blocks").withColumnRenamed("ring", "other"))
    near = near.withColumn("other", F.explode(F.sequence(F.col("ring") - 1, F.col("ring") + 1))).join(counts, ["root", "other"])
    sets = _sets(near.select("class").distinct(), classes, docs, n)
    own = lambda blocks: F.pmod(F.xxhash64("class"), blocks)
    mine = counts.select("root", F.col("other").alias("ring"), F.col("blocks").alias("own_blocks"), F.col("open_blocks").alias("own_open"))
    near = near.join(F.broadcast(mine) if counts.count() <= MOST_BROADCAST else mine, ["root", "ring"])
    asks = near.where("not linked").select("class", "root", F.col("ring").alias("r1"), own(F.col("own_open")).alias("b1"), F.col("other").alias("r2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b2"))
    told = near.where("open_blocks > 0").select("class", "root", F.col("other").alias("r1"), F.explode(F.sequence(F.lit(0), F.col("open_blocks") - 1)).alias("b1"), F.col("ring").alias("r2"), own(F.col("own_blocks")).alias("b2"))
    cell = ["root", "r1", "b1", "r2", "b2"]
    grid = [rows.join(sets, "class").select(*(F.col(c).alias(c) for c in [*cell, "class", "hashes"])).groupBy(*cell) for rows in (asks, told)]

    def compare(x, y):
        return _cell(x, y, percent)

    return stars.union(grid[0].cogroup(grid[1]).applyInPandas(compare, "a long, b long"))


def _cell(x, y, percent: int):
    """A forest of the links between the documents of two blocks."""
    import pandas as pd

    if not len(x) or not len(y):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    left, right = ([np.frombuffer(h, np.uint64) for h in side["hashes"]] for side in (x, y))
    sizes = [np.array([len(h) for h in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    common = np.zeros((len(left), len(right)), np.float32)
    at = [np.searchsorted(both, f) for f in flat]
    row = [np.repeat(np.arange(len(s)), s) for s in sizes]
    known = [(a < len(both)) & (both[np.minimum(a, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool) for a, f in zip(at, flat)]
    at, row = [a[k] for a, k in zip(at, known)], [r[k] for r, k in zip(row, known)]
    for low in range(0, len(both), 4096):
        m = []
        for a, r, s in zip(at, row, sizes):
            some = (a >= low) & (a < low + 4096)
            one = np.zeros((len(s), 4096), np.float32)
            one[r[some], a[some] - low] = 1
            m.append(one)
        common += m[0] @ m[1].T
    total = sizes[0][:, None] + sizes[1][None, :] - common
    a, b = x["class"].to_numpy(), y["class"].to_numpy()
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    out = []
    for i, j in zip(*np.nonzero(common * 100 >= total * percent)):
        u, v = int(a[i]), int(b[j])
        if (ru := root(u)) != (rv := root(v)):
            parent[ru] = rv
            out.append((min(u, v), max(u, v)))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of ``edges`` (a, b); root is the least node reached.

    Alternating large-star and small-star; each step's table is written, and the
    minima are joined from a table so that adaptive execution can split a hub.
    """

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r.n, r.s

    now = store.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    was = mark(now)
    while was[0]:
        both = now.union(now.select("v", "u"))
        lowest = store.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = now.join(lowest.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
        large = store.materialize(large.distinct(), "large")
        lowest = store.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = store.materialize(small.where("u <> v").distinct(), "stars")
        if (is_now := mark(now)) == was:
            break
        was = is_now
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _row(doc_id: str | Column, text: str | Column) -> Column:
    """A name of the rows of one id and text."""
    return F.xxhash64(doc_id, text)


def groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", most: int = 32, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least doc_id that links of ``percent`` (1 to 100) lead to."""
    return _grouped(docs, n, percent, id_col, text_col, most, exact).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _grouped(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text", most: int = 32, exact: bool = False) -> DataFrame:
    """doc_id, row_id, n_shingles and, for rows that are linked or repeated, the group (root) and its component_id."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be from 1 to 100, not {percent}")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("row_id", _row("doc_id", "text"))
    with store.scope(spark) as s:
        wide = store.materialize(shingled(docs, n), "shingled")
        # One text stands for each class.
        classes = wide.where("class is not null").groupBy("class").agg(F.min("row_id").alias("rep"), F.min("doc_id").alias("name"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
        classes = store.materialize(classes, "classes")
        all_rows = s.keep(store.materialize(wide.select("doc_id", "row_id", "n_shingles", "class"), "rows"))
        store.drop(wide)  # only the classes' keys are asked for again
        joined = components(links(classes, docs, n, percent, most, exact))
        root = classes.select("class", "name", "copies").join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        root = store.materialize(root.join(_small(store.materialize(joined.select("root").distinct(), "roots")).withColumn("many", F.lit(True)), "root", "left").where("many or copies > 1"), "grouped")
        names = store.materialize(root.groupBy("root").agg(F.min("name").alias("component_id")), "names")
        named = s.keep(store.materialize(root.select("class", "root").join(_small(names), "root").select("class", "root", "component_id"), "named"))
    return all_rows.join(_small(named), "class", "left").drop("class")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group: of the least id and, where texts of the group share that id, one text.

    Rows that repeat both id and text are one document and stay or go together; rows
    without an id stay. An id that stands for different texts is judged text by text.
    """
    with store.scope(docs.sparkSession) as s:
        rows = store.materialize(_grouped(docs, n, percent).where("root is not null and doc_id is not null").select("doc_id", "row_id", "root", "component_id"), "linked")
        first = store.materialize(rows.where("doc_id = component_id").groupBy("root").agg(F.min("row_id").alias("stays")), "first")
        drop = rows.join(_small(first), "root").where("row_id <> stays").select("doc_id", "row_id").distinct()
        drop = s.keep(store.materialize(drop.toDF("_dropped_id", "_dropped_row"), "copies"))
    fits = (F.col("doc_id").cast("long") == F.col("_dropped_id")) & (_row(F.col("doc_id").cast("long"), F.col("text").cast("string")) == F.col("_dropped_row"))
    return docs.join(_small(drop), fits, "left_anti")
