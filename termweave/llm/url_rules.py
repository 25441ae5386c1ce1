"""Allow and block rules for URLs, by a sort-merge range join.

A host's canonical key is its labels reversed, each with a dot behind it, so the
hosts at and below a rule's host are exactly the keys of one interval. The rules'
interval starts and ends, and the URLs, are sorted together; a sweep in that order
keeps the stack of the rules whose intervals are open. Intervals of hosts nest or
are disjoint, so the stack after a start or an end is known from the rules alone
and rides on that event; the sweep is one window function. URLs and events are dealt
by range of (key, row), so a host with any share of all rows, or one row repeated,
spreads over many tasks; the stack that is open where a range begins is carried into
it in one row. Rules cost ``2 * rules + ranges`` rows.

Defined cases: a null url, or one without ``://``, has an empty host and path and
gets the default verdict; repeated rows and null ids are kept; an empty rule table
leaves every url at the default. Of equally long rules the one with the longer
host wins, then block. Only the id and the url column are read. A host's rules
travel as one array, which holds its paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"


def _key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def url_parts(url):
    """(host, path) columns; empty where the url has none."""
    empty = F.lit("")
    return (
        F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), empty),
        F.coalesce(F.regexp_extract(url, PARTS, 2), empty),
    )


def rule_events(rules: DataFrame) -> DataFrame:
    """Interval starts and ends: key, stack (the open rules from there on).

    ``rules`` has host, path and action (allow or block).
    """
    host = F.translate("host", UPPER, LOWER)
    one = rules.where("host is not null and path is not null and action is not null").select(host.alias("host"), "path", "action").distinct()
    one = one.select("host", F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.col("action"), F.concat("host", "path").alias("rule"), "path").alias("r"))
    by_host = one.groupBy("host").agg(F.collect_list("r").alias("own"))
    labels = F.split("host", r"\.")
    above = by_host.select("host", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("i"))
    above = above.select("host", F.array_join(F.slice(labels, F.col("i"), F.size(labels)), ".").alias("outer"))
    nested = above.join(by_host.withColumnRenamed("host", "outer"), "outer")
    chain = nested.groupBy("host").agg(
        F.flatten(F.collect_list("own")).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("outer") != F.col("host"), F.col("own")))).alias("outside"),
    )
    key = _key(F.col("host"))
    after = F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit("/"))  # the first key past all that start with k
    chain = chain.withColumn("k", key)
    return chain.select(F.col("k").alias("key"), F.col("inside").alias("stack")).unionByName(chain.select(after.alias("key"), F.col("outside").alias("stack")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", ranges: int | None = None) -> DataFrame:
    """id, host, path, rule and verdict of every row of ``pages``."""
    host, path = url_parts(F.col("_url"))
    points = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    points = points.select("_id", host.alias("host"), path.alias("path"))
    events = rule_events(rules)
    none = F.lit(None)
    both = points.select(_key(F.col("host")).alias("key"), F.lit(1).alias("is_url"), F.monotonically_increasing_id().alias("row"), "_id", "host", "path", none.cast(events.schema["stack"].dataType).alias("stack")).unionByName(
        events.select("key", F.lit(0).alias("is_url"), F.lit(0).cast("long").alias("row"), none.cast(points.schema["_id"].dataType).alias("_id"), none.cast("string").alias("host"), none.cast("string").alias("path"), "stack")
    )
    both = both.repartitionByRange(ranges or store.partitions(pages.sparkSession), "key", "is_url", "row").drop("row").withColumn("part", F.spark_partition_id())
    both = store.materialize(both, "urls")  # from here on the ranges are fixed

    last = both.groupBy("part").agg(F.max_by("stack", F.when(F.col("is_url") == 0, F.col("key"))).alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(last.select("part", F.last("last", ignorenulls=True).over(before).alias("carried")))  # a row for each range

    sweep = Window.partitionBy("part").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("near", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1").join(carried, "part")
    best = F.array_max(F.filter(F.coalesce("near", "carried"), lambda r: F.startswith(F.col("path"), r["path"])))  # by size, host_size, action
    return swept.withColumn("best", best).select(
        F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
