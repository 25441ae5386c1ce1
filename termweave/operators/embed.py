"""Embedding of texts by a model that the caller gives, each text once.

Vectors are kept in a keyed table under a name of model and text, so a text that was
embedded before, in this table or an earlier run, is looked up and not embedded
again. The texts that are left are distinct, sorted by length within each task and given
to the model in batches of like length, on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import normalize_query
from termweave.sources.sinks import KeyedTable, staged

#: Texts given to the model at a time.
BATCH = 128
Model = Callable[[list[str]], "np.ndarray | list[list[float]]"]


def name_of(text: Column, model: str) -> Column:
    """The name of a vector: a hash of the model's name and the text."""
    return F.sha2(F.concat(F.lit(f"{model}\0"), text), 256)


def vectors_of(texts: DataFrame, model: Model, batch: int = BATCH) -> DataFrame:
    """name, text, vector of ``texts`` (name, text), as 32-bit floats. ``model`` runs on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, batch):
                part = whole.slice(low, batch)
                vectors = np.asarray(model(part.column(1).to_pylist()), np.float32)
                if vectors.shape[:1] != (part.num_rows,) or vectors.ndim != 2:
                    raise ValueError(f"the model gave {vectors.shape} for {part.num_rows} texts")
                yield pa.record_batch([*part.columns, pa.array(list(vectors), pa.list_(pa.float32()))], names=["name", "text", "vector"])

    dealt = texts.select("name", "text").repartition("name").sortWithinPartitions(F.length("text"), "name")
    return dealt.mapInArrow(run, "name string, text string, vector array<float>")


def embed(rows: DataFrame, text: str, model: Model, table: KeyedTable, model_name: str, batch: int = BATCH, normalize: bool = False) -> DataFrame:
    """``rows`` with vector, null for a null text; what ``table`` (keyed by name, seq) lacks is embedded and loaded first.

    ``normalize`` embeds the stripped text in lower case, as queries are. A load that
    fails leaves the table as it was; repeated, it embeds what is still missing. A run that only asks what is
    known doesn't call the model.
    """
    said = normalize_query(F.col(text)) if normalize else F.col(text)
    asked = rows.withColumn("_name", name_of(said, model_name))
    wanted = staged(asked.where(F.col("_name").isNotNull()).select(F.col("_name").alias("name"), said.alias("text")).dropDuplicates(["name"]), "texts")
    known = table.read()
    missing = wanted if known is None else wanted.join(known.select("name"), "name", "left_anti")
    made = staged(vectors_of(missing, model, batch), "vectors")
    if known is None or made.limit(1).count():
        table.upsert(made.select("name", "vector", F.lit(0).cast("long").alias("seq")))
    held = table.read().select(F.col("name").alias("_held"), "vector")
    return asked.drop("vector").join(held, F.col("_name") == F.col("_held"), "left").drop("_name", "_held")
