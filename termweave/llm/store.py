"""Scratch tables of this subpackage: those of the library."""

from __future__ import annotations

from pyspark.sql import SparkSession

from termweave.sources.scratch import Scope, drop, materialize, new_path, scope, shared_dir

__all__ = ["Scope", "drop", "materialize", "new_path", "partitions", "scope", "shared_dir"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
