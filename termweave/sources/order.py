"""The place of rows in their files, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.text import strip
from termweave.sources.sinks import staged


def numbered(scan: DataFrame, name: str = "row_index", start: int = 0) -> DataFrame:
    """``scan``, read from files, with each row's place over all files in ``name``, from ``start``.

    Files follow by name, as part files do. A row lies in a block of a file, and rows
    of a block are read in their order; so its place is the number of rows in all
    blocks before, which one count for each block gives, and its place in the block. The rows are
    written once with their block, and a row for each block is joined.
    """
    names = [f"`{c}`" for c in scan.columns if c.lower() != name.lower()]
    place = F.monotonically_increasing_id()  # ascends within a task, which reads its blocks one after another
    rows = scan.select(F.struct(*names).alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), place.alias("place"))
    rows = staged(rows, "numbered")
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    # The counts of a file are added up among themselves, then those of files: a task holds a row for each block of a file, or for each file.
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    starts = blocks.withColumn("before", F.coalesce(F.sum("n").over(in_file), F.lit(0))).join(files, "file")
    starts = staged(starts.select("file", "block", (F.col("earlier") + F.col("before") - F.col("first") + start).alias("shift")), "blocks")
    return rows.join(starts, ["file", "block"]).select("row.*", (F.col("place") + F.col("shift")).alias(name))


def with_indexes(rows: DataFrame, index: str = "row_index", test_index: Column | None = None, row_id: Column | None = None) -> DataFrame:
    """``rows`` with test_index (given, else the place from 1) and row_id (given, else the place from 0, as text)."""
    made = rows.withColumn("test_index", F.coalesce(test_index.cast("string").try_cast("long") if test_index is not None else F.lit(None), F.col(index) + 1))
    return made.withColumn("row_id", F.coalesce(row_id.cast("string"), F.col(index).cast("string")) if row_id is not None else F.col(index).cast("string"))


def first_in_file(rows: DataFrame, keys: list[str], index: str = "row_index") -> DataFrame:
    """Of each key the row that comes first; only one a key and task is shuffled."""
    from termweave.operators.dedup import first_by

    return first_by(rows, keys, F.col(index).asc())


def by_entity(rows: DataFrame, entity: str, record: Column, index: str = "row_index") -> DataFrame:
    """entity (stripped), records: the records of an entity in the order of arrival.

    An entity's list is one value, as its runs are one record of a sheet: it grows with
    its runs, not with the table.
    """
    item = F.struct(F.col(index).alias("at"), record.alias("record"))
    return rows.groupBy(strip(F.col(entity)).alias("entity")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["record"]).alias("records"))
