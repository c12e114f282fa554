"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(v), lambda x: x * x)))


def _same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors must have the same length")).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector, an error for unequal lengths."""
    size = norm(a) * norm(b)
    return _same_size(a, b, F.when(size == 0, 0.0).otherwise(dot(a, b) / size))


def euclidean(a: Column, b: Column) -> Column:
    return _same_size(a, b, F.sqrt(_sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))))


def l2_normalize(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    size = norm(v)
    return F.when(size == 0, _doubles(v)).otherwise(F.transform(_doubles(v), lambda x: x / size))


def hash_embedding(dimensions: int = 1536):
    """A deterministic embedding that needs no model: hashed words on sine waves, weighted by frequency."""

    @pandas_udf("array<double>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        steps = np.arange(dimensions) * 997

        def one(text: str | None) -> np.ndarray:
            words = (text or "").lower().split()
            out = np.zeros(dimensions)
            for word, times in pd.Series(words, dtype=object).value_counts(sort=False).items():
                h = 0
                for ch in word:
                    h = (h * 31 + ord(ch)) & 0xFFFFFFFF
                signed = h - (1 << 32) if h & 0x80000000 else h
                out += np.sin((abs(signed) + steps) % 10_000) * times / len(words)
            size = np.linalg.norm(out)
            return out / size if size else out

        for series in texts:
            yield series.map(one)

    return embed
