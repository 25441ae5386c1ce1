"""Resumable ingest: a file stream that upserts into a keyed table.

Progress is the stream's checkpoint, saved after a batch is written; a batch that is
repeated after a failure writes the same keys again and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from termweave.sources.sinks import KeyedTable, _fs


def ingest(spark: SparkSession, source: str, schema: StructType, target: KeyedTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet", files_a_batch: int = 16, **options) -> StreamingQuery:
    """Load what is new in ``source`` and stop; ``files_a_batch`` bounds a batch."""
    rows = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_a_batch).options(**options).load(source)
    rows = prepare(rows) if prepare else rows

    def write(batch: DataFrame, _: int) -> None:
        target.upsert(batch)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clear(spark: SparkSession, checkpoint: str) -> None:
    """Forget the progress, after a load that is complete."""
    fs, p = _fs(spark, checkpoint)
    fs.delete(p, True)
