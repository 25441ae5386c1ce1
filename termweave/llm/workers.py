"""What runs in the executors' Python workers, which live on from task to task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose Python objects are in memory at a time.
ROWS = 512
_slot: dict[str, dict] = {}


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def memory(family: str) -> dict:
    """A dictionary that an operator finds again in the worker's next task. Another operator's is given up for it."""
    if family not in _slot:
        _slot.clear()
        _slot[family] = {}
    return _slot[family]


def with_text(df: DataFrame, kept: list[str], text_col: str, name: str) -> tuple[DataFrame, int]:
    """The columns ``kept`` and the text as a string, and the place of the text: a kept string is sent to Python once, anything else is cast into a column ``name`` behind them."""
    rows, names = df.select(*(F.col(f"`{k}`") for k in kept)), [k.lower() for k in kept]
    at = names.index(text_col.lower()) if text_col.lower() in names else len(names)
    if at < len(names) and rows.schema[at].dataType == T.StringType():
        return rows, at
    return df.select(*(F.col(f"`{k}`") for k in kept), F.col(text_col).cast("string").alias(fresh(name, kept))), len(kept)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with as many marks as make it differ from all of ``taken``; Spark's names ignore case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name
