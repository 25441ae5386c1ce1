"""Numeric and vector functions over columns."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence bands: least score and name, best first. Fixed values.
BANDS = ((0.95, "very_high"), (0.85, "high"), (0.70, "medium"), (0.50, "low"))


def sigmoid(score: Column, center: float = 3.0, scale: float = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-(score - F.lit(center)) / F.lit(scale)))


def or_else(first: Column, second: Column) -> Column:
    """``first``, or ``second`` where the first is null or zero."""
    return F.coalesce(F.nullif(first, F.lit(0.0)), second)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; null for a null, zero or differently long vector."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def unit_score(cos: Column) -> Column:
    """A cosine moved to 0..1."""
    return (1.0 + cos) / 2.0


def length_similarity(stored: Column, asked: Column) -> Column:
    """1 to 2: how near the stored name's length is to the query's."""
    return nearness(F.length(stored), F.length(asked))


def nearness(stored: Column, asked: Column) -> Column:
    """``length_similarity`` of two lengths."""
    off = (stored - asked) / F.greatest(F.lit(8.0), 0.8 * asked)
    return 1.0 + F.exp(-0.5 * off * off)


def confidence(score: Column) -> Column:
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("very_low")


def vector_of(c: Column) -> Column:
    """A vector given as JSON text."""
    return F.from_json(c, "array<float>")


@lru_cache(maxsize=8)
def projection_matrix(width: int, dims: int, seed: int = 42) -> np.ndarray:
    """Gaussian random projection, float32."""
    m = np.random.RandomState(seed).randn(width, dims).astype(np.float32)
    m /= np.float32(np.sqrt(dims))
    return m


def project(vector: Column, dims: int = 128, seed: int = 42) -> Column:
    """Vectors projected to ``dims`` components and scaled to length 1, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(vectors: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            p = np.asarray(v, np.float32) @ projection_matrix(len(v), dims, seed)
            return p / max(float(np.linalg.norm(p)), 1e-10)

        return vectors.map(one)

    return run(vector)
