"""Scratch tables in the folder that the driver and all executors share, and scopes that delete them."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a folder of its own; on a
    cluster a machine-local folder would lose rows, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="termweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scope:
    """Folders made in a ``scope``, and which of them outlive it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], set()

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, a result of ``materialize`` in this scope, whose folder goes over to the scope around, if there is one."""
        self.kept.add(df._scratch)
        return df


#: The open scopes of a thread, the innermost last.
_open = threading.local()


def _scopes() -> list[Scope]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Folders that this thread makes inside are deleted at the end, but for those kept. Other threads' and earlier ones stay."""
    now = Scope(spark)
    _scopes().append(now)
    try:
        yield now
    finally:
        _scopes().remove(now)
        for path in now.made:
            if path in now.kept:
                _own(path)
            else:
                _delete(spark, path)


def _own(path: str) -> None:
    if _scopes():
        _scopes()[-1].made.append(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete the folder of ``df``, a result of ``materialize``, once nothing reads it any more."""
    _delete(df.sparkSession, df._scratch)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _own(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts the lineage.

    The result is read from shared files, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out
