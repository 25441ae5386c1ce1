"""Mixing sources to target weights by systematic sampling.

A source's target is its weight's share of all words, but at most ``most`` times what
the source holds; what lies above goes to the others by weight until none is above.
Each document of a source is expected target / words times. From the largest document
down the expected copies are summed up, one random offset is added, and a document is
emitted once for each integer that the sum crosses at it. So a document is taken the
floor or the ceiling of its expected copies.

One large document can miss a small target by much. So the order is cut where the
documents so far hold a half and where they hold seven eighths of the words (``CUTS``, at powers of two of
the size), and those after a cut are expected to make up for what was taken before it:
(target - words taken) / words left, from 0 to ``most``. On average that is the same rate. As neighbours in
the order are of like size, the words taken differ from the target by about the size of
one of the smallest documents, unless larger ones alone pass it.

The sum at the i-th document of a source is i times a fraction of integers and is
reckoned in whole numbers: no rounding gathers over many documents. Numbers within a
source come from a sort by range, whose rows are counted for each (range, source): a
source of a third of all rows is dealt over as many ranges as any other.

Defined cases: a null text has size 0, a null source is one source of its own, the last;
a null id sorts first among equal sizes; repeated rows are documents of their own; rows of
equal size and id go by their text. A source without words has target 0 and its
documents are left out. Very long texts count by one pass that makes
no list of words. Columns of the input that clash give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm import store

#: Weights of the sources in their order, repeating; no source is taken more often than ``MOST`` times.
WEIGHTS, MOST = (5, 2, 1), 3
#: Eighths of a source's words after which the expected copies are reckoned again.
CUTS = (4, 7)
WHOLE = T.DecimalType(38, 0)
#: Steps of the random offset.
STEPS = 1 << 32


def size_of(text: Column) -> Column:
    """Runs of characters other than space and the five controls from tab on."""
    short = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(short, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def _times(a: Column, b: Column) -> Column:
    """The exact product of whole numbers of up to 19 and 18 digits."""
    return (a.cast(T.DecimalType(19, 0)) * b.cast(T.DecimalType(18, 0))).cast(WHOLE)


def _div(a: Column, b: Column) -> Column:
    """The quotient of whole numbers from 0 on, rounded down."""
    return F.call_function("div", a, b.cast(WHOLE))


def targets(sizes: DataFrame, weights: tuple[int, ...] | dict[str | None, int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, up, down of ``sizes`` (source, source_size, a row for each source); target is up / down.

    With d the words that each unit of weight gets, a source is full where
    most * size <= weight * d. In the order of size / weight the full ones come first,
    so d follows from sums over those before; the rows of this table, a row a source,
    are sorted in one task. Weights go by place in the order of names, or by name (0 for a source not named).
    """
    if isinstance(weights, dict):
        known = [F.lit(x) for k, v in weights.items() if k is not None for x in (k, v)]
        named = F.try_element_at(F.create_map(*known), F.col("source")) if known else F.lit(None).cast("int")
        weight = F.coalesce(F.when(F.col("source").isNull(), F.lit(weights.get(None, 0))).otherwise(named), F.lit(0))
    else:
        place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        weight = F.element_at(F.array(*map(F.lit, weights)), (place - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    ratio = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy(ratio.asc_nulls_last(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = F.sum("source_size").over(every)
    left = words - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("full", (F.col("weight") > 0) & (_times(left, F.col("weight")) >= _times(F.col("cap"), F.sum("weight").over(after))))
    shared = words - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    open_ = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    some = ~F.col("full") & (F.col("weight") > 0)
    rows = rows.withColumn("up", F.when(some, shared * F.col("weight")).when(F.col("full"), F.col("cap")).otherwise(0)).withColumn("down", F.when(some, open_).otherwise(1))
    return rows.select("source", "source_size", (F.col("up").cast("double") / F.col("down")).alias("target"), "up", "down")


def _cut(rows: DataFrame, weights: tuple[int, ...] | dict[str | None, int], most: int) -> DataFrame:
    """``targets`` of ``rows`` (of, size), with the documents and words of a source before each cut: n0, w0 (0), n1, w1, ..."""
    by_size = rows.groupBy(F.col("of").alias("source"), F.length(F.bin("size")).alias("bits")).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    down = Window.partitionBy("source").orderBy(F.desc("bits"))  # at most 63 rows a source
    upto = F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by_size = by_size.withColumn("upto", upto).withColumn("every", F.sum("words").over(Window.partitionBy("source")))
    before = [F.lit(0).cast("long").alias(c) for c in ("n0", "w0")]
    for t, eighths in enumerate(CUTS):
        inside = F.col("upto") * 8 <= F.col("every") * eighths
        before += [F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(f"{a}{t + 1}") for a, c in (("n", "n"), ("w", "words"))]
    sums = by_size.groupBy("source").agg(F.sum("words").alias("source_size"), *before[2:]).select("*", *before[:2])
    aims = targets(sums.select("source", "source_size"), weights, most).withColumnRenamed("source", "s").drop("source_size")
    return sums.join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _expected(aims: DataFrame, t: int, most: int, seed: int) -> DataFrame:
    """``aims`` with up, down and offset of the documents after cut ``t``: each is expected up / down, the sum before them ends with offset / down."""
    left, over = F.col("source_size") - F.col(f"w{t}"), F.col("up") - F.col("down") * F.col("taken")
    none, all_ = (left <= 0) | (over <= 0), over >= F.col("down") * left * most
    up, down = F.when(none, 0).when(all_, most).otherwise(over).cast("long"), F.when(none | all_, 1).otherwise(F.col("down") * left)
    aims = aims.withColumn(f"up{t}", up).withColumn(f"down{t}", down)
    if t == 0:
        drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long")
        return aims.withColumn("offset0", _div(_times(F.col("down0"), drawn), F.lit(STEPS)))
    last, n = t - 1, F.col(f"n{t}") - F.col(f"n{t - 1}")
    beyond = (_times(F.col(f"up{last}"), n) + F.col(f"offset{last}")) % F.col(f"down{last}").cast(WHOLE)  # what the sum has over an integer
    return aims.withColumn(f"offset{t}", _div(_times(beyond, F.col(f"down{t}")), F.col(f"down{last}")))


def _crossed(t: int) -> Column:
    """Integers that the sum crosses at document ``i``, which lies after cut ``t``."""
    j = F.col("i") - F.col(f"n{t}")
    at = lambda k: _div(_times(F.col(f"up{t}"), k) + F.col(f"offset{t}"), F.col(f"down{t}"))
    return (at(j + 1) - at(j)).cast("long")


def copies(docs: DataFrame, weights: tuple[int, ...] | dict[str | None, int] = WEIGHTS, most: int = MOST, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with size, source_size, target and copies: how often the mix takes each row.

    What is kept is shuffled with its row, once; a caller that wants numbers alone keeps the id.
    """
    spark = docs.sparkSession
    added = {"size", "source_size", "target", "copies"}
    names = [f"`{c}`" for c in docs.columns if c.lower() not in added and (keep is None or c in keep)]
    text = F.col(text_col).cast("string")
    key = F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))).alias("h"), F.xxhash64(text).alias("t"))
    rows = docs.select(F.struct(*names).alias("row"), F.col(source_col).cast("string").alias("of"), size_of(text).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("n"))
    rows = store.materialize(rows, "sizes")
    order = [F.col("of").asc_nulls_last(), F.col("size").desc(), F.col("key"), F.col("n")]  # n spreads what is repeated
    dealt = rows.repartitionByRange(store.partitions(spark), *order).sortWithinPartitions(*order)
    dealt = store.materialize(dealt.select("row", "of", "size", F.monotonically_increasing_id().alias("place")), "dealt")
    part = F.shiftright("place", 33)  # the range; the row's number in it is below
    counts = dealt.groupBy(part.alias("part"), F.col("of").alias("s")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a source enters
    counts = store.materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"), "counts")
    aims = store.materialize(_cut(rows, weights, most), "aims")

    def numbered(by: DataFrame) -> DataFrame:
        """``dealt`` with i, the number of the source's documents before the row, and what ``by`` has of the source.

        Ranges and sources together bound the rows joined to it; Spark knows what of them was written and broadcasts it if that is small.
        """
        some = store.materialize(counts.join(by, F.col("s").eqNullSafe(F.col("source"))).drop("s"), "starts")
        joined = dealt.withColumn("at", part).join(some, (F.col("at") == F.col("part")) & F.col("of").eqNullSafe(F.col("source")))
        return joined.withColumn("i", F.col("before") + F.col("place") - F.col("first"))

    tiers = range(len(CUTS) + 1)
    aims = aims.withColumn("taken", F.lit(0).cast("long"))
    for t in tiers:
        aims = _expected(aims, t, most, seed)
        if t < len(CUTS):
            done = numbered(aims).where((F.col("i") >= F.col(f"n{t}")) & (F.col("i") < F.col(f"n{t + 1}")))
            done = done.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("size") * _crossed(t)).alias("more"))
            aims = aims.join(done, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("taken", F.col("taken") + F.coalesce("more", F.lit(0))).drop("s", "more")
            aims = store.materialize(aims, "aims")
    taken = _crossed(len(CUTS))
    for t in reversed(tiers[:-1]):
        taken = F.when(F.col("i") < F.col(f"n{t + 1}"), _crossed(t)).otherwise(taken)
    return numbered(aims).select("row.*", "size", "source_size", "target", taken.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] | dict[str | None, int] = WEIGHTS, most: int = MOST, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix: each of ``docs`` as often as it is taken, with its number in ``copy``, from 1."""
    found = copies(docs, weights, most, seed, id_col, text_col, source_col).where("copies > 0")
    names = [f"`{c}`" for c in docs.columns if c.lower() not in ("copy", "size", "source_size", "target", "copies")]
    return found.select(*names, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
