"""Resolution of WARC revisit records (not modified) against earlier responses.

Each revisit is joined, as of its time, to the latest earlier full response of the
same canonical URL. The join is resolved if the validators agree; then the
response's headers, updated by those headers that a 304 answer may update, are the
record's headers.

Records are dealt by range of (canonical URL, time, id), so a URL with any share of
all rows spreads over many tasks; what a URL's earlier ranges end with is carried
on in one row for each range that a URL enters.

Defined cases: earlier means a smaller (time, id); a revisit without an earlier
response is ``orphan``, one whose validators differ ``mismatch``, one without a
common validator ``unverified``. A null URL matches nothing. Null times sort first.
Entity tags compare weakly. Headers that differ only in case are one header, whose
values are joined by commas, ordered by name; null values are left out. Rows of other kinds are left out; repeated rows are
kept. Columns other than those named in ``COLUMNS`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm import store

COLUMNS = ("record_id", "url", "ts", "kind", "status", "etag", "last_modified", "digest", "headers")
#: Headers of a 304 answer that do not replace the stored ones. Fixed values.
NOT_UPDATED = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default ports, fragments, tracking parameters and a final slash fall away; hosts are lower-cased."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    host = F.when(F.lower(url).startswith("https://"), F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref)="))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def _by_lower_name(headers: Column) -> Column:
    """A map of lower-cased names, each with its values joined."""
    entries = F.array_sort(F.filter(F.map_entries(headers), lambda e: e["value"].isNotNull()))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    values = F.transform(names, lambda name: F.array_join(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == name), lambda e: e["value"]), ", "))
    return F.coalesce(F.map_from_arrays(names, values), F.create_map().cast("map<string,string>"))


def resolve(records: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each revisit: record_id, canonical_url, ts, base_record_id, outcome, status, headers."""
    spark = records.sparkSession
    names = ["record_id", "ts", "status", "etag", "last_modified", "digest", "headers"]
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = records.where(full | (F.col("kind") == "revisit")).select(canonical_url(F.col("url")).alias("curl"), *names, F.coalesce(full, F.lit(False)).alias("full"))
    rows = rows.repartitionByRange(parts or store.partitions(spark), "curl", "ts", "record_id").withColumn("part", F.spark_partition_id())
    rows = store.materialize(rows, "revisits")  # from here on the ranges are fixed
    response = F.when(F.col("full"), F.struct(*names))

    # The ranges follow each other, so only the URLs at their ends lie in several.
    ends = rows.groupBy("part").agg(F.min("curl").alias("a"), F.max("curl").alias("b"))
    ends = F.broadcast(ends.select(F.explode(F.array("a", "b")).alias("curl")).distinct())  # two rows for each range at most
    last = rows.join(ends, "curl", "left_semi").groupBy("curl", "part").agg(F.max_by(response, F.when(F.col("full"), F.struct("ts", "record_id"))).alias("last"))
    before = Window.partitionBy("curl").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("carried is not null").drop("last")

    here = Window.partitionBy("part", "curl").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("near", F.last(response, ignorenulls=True).over(here)).where("not full")
    seen = seen.join(F.broadcast(carried), ["curl", "part"], "left")  # as few rows as ends
    seen = seen.withColumn("base", F.when(F.col("curl").isNotNull(), F.coalesce("near", "carried")))

    base = F.col("base")
    agree = F.coalesce(_weak(F.col("etag")) == _weak(base["etag"]), F.col("last_modified") == base["last_modified"], F.col("digest") == base["digest"])
    outcome = F.when(base.isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    new = _by_lower_name(F.col("headers"))
    new = F.map_filter(new, lambda k, _: ~k.isin(*NOT_UPDATED))
    old = F.map_filter(_by_lower_name(base["headers"]), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    done = outcome == "resolved"
    return seen.select(
        "record_id", F.col("curl").alias("canonical_url"), "ts", F.when(done, base["record_id"]).alias("base_record_id"), outcome.alias("outcome"),
        F.when(done, base["status"]).alias("status"), F.when(done, F.map_concat(old, new)).alias("headers"),
    )


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """``resolved`` with the column ``payload`` of ``payloads`` (record_id, payload) by the response found."""
    known = payloads.select(F.col("record_id").alias("base_record_id"), "payload")
    return resolved.join(known, "base_record_id", "left")
