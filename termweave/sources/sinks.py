"""Writers. A table is replaced as a whole, or upserted by key, bucket by bucket."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.operators.dedup import first_by
from termweave.sources.files import exists
from termweave.sources.scratch import materialize, scope, shared_dir


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    return shared_dir(spark)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written in the shared folder and read again, so that later uses neither repeat the work nor depend on an executor.

    Inside a ``scratch.scope`` it is deleted at the scope's end.
    """
    return materialize(df, label)


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over at least as many partitions as there are cores; a table of many files stays as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs._jdf.queryExecution().toRdd().getNumPartitions() < cores else docs


class KeyedTable:
    """A Parquet table that holds one row for each key, that of the last ``seq``; among equals the one loaded later.

    Keys are dealt into ``buckets`` by their hash, a folder each. A load reads and writes
    only the buckets that its keys fall in. Which folder holds which bucket stands in a
    manifest, and ``CURRENT`` names the valid one: it is written beside and moved
    over the old one at the end, so a load that fails or is repeated changes nothing.
    Folders of the manifest before stay for its readers until the next load.

    Choose ``buckets`` so that one fits a task; a table keeps those it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, seq: str, buckets: int = 16):
        self.spark, self.path, self.key, self.seq, self.buckets = spark, path.rstrip("/"), key, seq, buckets

    def _text(self, name: str) -> str | None:
        if not exists(self.spark, f"{self.path}/{name}"):
            return None
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def _manifest(self, name: str | None = None) -> dict | None:
        """schema, buckets, before (the manifest that was valid then) and folders, by bucket, of the valid manifest."""
        name = name or self._text("CURRENT")
        text = self._text(name) if name else None
        return json.loads(text) if text else None

    def _write(self, name: str, text: str) -> None:
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _frame(self, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{f}" for b, f in sorted(manifest["folders"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def create(self, schema: T.StructType, replace: bool = False) -> bool:
        """An empty table; one that is there is kept, unless ``replace``. Whether it was made."""
        if not replace and self._manifest():
            return False
        self._publish({"schema": schema.jsonValue(), "buckets": self.buckets, "folders": {}})
        return True

    def read(self) -> DataFrame | None:
        manifest = self._manifest()
        return self._frame(manifest) if manifest else None

    def upsert(self, rows: DataFrame) -> None:
        old = self._manifest() or {"schema": rows.schema.jsonValue(), "buckets": self.buckets, "folders": {}}
        names = [f["name"] for f in old["schema"]["fields"]]
        with scope(self.spark):
            bucket = F.pmod(F.xxhash64(self.key), F.lit(old["buckets"])).alias("_bucket")
            new = staged(first_by(rows.select(*names, bucket), ["_bucket", self.key], F.col(self.seq).desc(), F.xxhash64(*names)), "load")
            touched = {str(r[0]) for r in new.select("_bucket").distinct().collect()}  # a number a bucket
            if touched:
                folder = f"v-{uuid.uuid4().hex}"
                both = new.withColumn("_age", F.lit(0))
                if touched & old["folders"].keys():
                    both = both.unionByName(self._frame(old, touched).select(*names, bucket, F.lit(1).alias("_age")))
                # Dealt by bucket, so that a key's rows meet and each bucket is written by one task, as one file.
                dealt = both.repartition(len(touched), "_bucket")
                last = first_by(dealt, ["_bucket", self.key], F.col(self.seq).desc(), F.col("_age").asc()).drop("_age")
                last.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
                old["folders"] |= {b: f"{folder}/_bucket={b}" for b in touched}
        self._publish(old)

    def _publish(self, manifest: dict) -> None:
        before = self._text("CURRENT")
        name = f"m-{uuid.uuid4().hex}"
        self._write(name, json.dumps({k: manifest[k] for k in ("schema", "buckets", "folders")} | {"before": before}))
        self._write("NEXT", name)
        self._switch("NEXT")
        last = (self._manifest(before) or {}) if before else {}
        held = {*manifest["folders"].values(), *last.get("folders", {}).values()}
        self._sweep({name, before}, held)

    def _switch(self, beside: str) -> None:
        """Move the file ``beside`` over ``CURRENT``, at once."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        hadoop = jvm.org.apache.hadoop.fs
        how = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        current = hadoop.Path(f"{self.path}/CURRENT")
        hadoop.FileContext.getFileContext(current.toUri(), self.spark._jsc.hadoopConfiguration()).rename(hadoop.Path(f"{self.path}/{beside}"), current, how)

    def _sweep(self, manifests: set[str | None], folders: set[str]) -> None:
        """Delete the manifests and bucket folders that neither the valid manifest nor the one before names."""
        fs, p = _fs(self.spark, self.path)
        used = {f.split("/")[0] for f in folders}
        for found in fs.listStatus(p):
            name = found.getPath().getName()
            if name.startswith("m-") and name not in manifests or name.startswith("v-") and name not in used:
                fs.delete(found.getPath(), True)
            elif name.startswith("v-"):
                for part in fs.listStatus(found.getPath()):
                    if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in folders:
                        fs.delete(part.getPath(), True)

    def drop(self) -> None:
        fs, p = _fs(self.spark, self.path)
        fs.delete(p, True)

    def stats(self) -> dict:
        """Rows and bytes of the current version."""
        manifest = self._manifest()
        if not manifest:
            return {"rows": 0, "bytes": 0}
        size = lambda path: (lambda fs, p: fs.getContentSummary(p).getLength())(*_fs(self.spark, path))
        return {"rows": self.read().count(), "bytes": sum(size(f"{self.path}/{f}") for f in manifest["folders"].values())}

    def verify(self, least: int) -> bool:
        """Whether there are at least ``least`` keys."""
        table = self.read()
        return table is not None and table.count() >= least


def write_delimited(df: DataFrame, path: str, delimiter: str = "\t") -> None:
    df.write.mode("overwrite").option("sep", delimiter).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nested columns included, nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


#: Headers of a result sheet. Fixed values.
DETAIL = (
    "Test Index",
    "ID",
    "Entity Name",
    "Input Domain",
    "Ground Truth Concept ID",
    "Ground Truth Concept Name",
    "Success",
    "Mapping Correct",
    "Best Result Domain",
    "Best Concept ID",
    "Best Concept Name",
    "Best Score",
    "Stage1 Candidates",
    "Stage2 Candidates",
    "Stage3 Candidates",
)


def detail_sheet(records: DataFrame) -> DataFrame:
    """The columns of a result sheet under their headers, in order, from columns named alike in lower case with ``_``; missing ones are null."""
    names = {h: h.lower().replace(" ", "_") for h in DETAIL}
    return records.select(*((F.col(n) if n in records.columns else F.lit(None).cast("string")).alias(h) for h, n in names.items()))
