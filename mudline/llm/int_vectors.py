"""Whole-number vectors that the two Lloyd operators share: how rows become them, and exact measures between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component is floor(SCALE * x).
SCALE = 256
#: Components stay under this size, so that squared distances of up to 128 components fit 64 bits.
LARGEST = 1 << 27
#: What a floating-point bound is widened by, far over the rounding of one square root and a few sums.
EPS = 1e-12


def sound(vector_col: str) -> Column:
    """Whether a vector is there and none of its components is null or non-finite."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    return F.col(f"`{vector_col}`").isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole(vector_col: str) -> Column:
    """Components as floor(SCALE * x), the product in doubles; an error where one is too large for exact 64-bit distances."""
    scaled = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x * float(SCALE))
    too_large = F.exists(scaled, lambda x: F.abs(x) >= float(LARGEST))
    return F.when(too_large, F.raise_error(F.lit(f"a vector component of {LARGEST // SCALE} or more: distances would not fit 64 bits"))).otherwise(F.transform(scaled, lambda x: F.floor(x).cast("int")))


def integer_rows(rows: DataFrame, keep: list[str], vector_col: str, dim: int) -> DataFrame:
    """``row`` (the columns ``keep``, under one name so that none can clash) and ``v`` of the sound vectors of ``dim`` components."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    return rows.filter(sound(vector_col) & (F.size(F.col(f"`{vector_col}`")) == dim)).select(kept, whole(vector_col).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to ``c`` (one vector, or one a row)."""
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def all_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` to every row of ``c``."""
    return np.stack([squared(x, one) for one in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)


def above(exact: np.ndarray) -> np.ndarray:
    """A distance that is no smaller than the root of ``exact``."""
    return np.sqrt(exact.astype(np.float64)) * (1 + EPS)


def below(exact: np.ndarray) -> np.ndarray:
    """A distance that is no larger than the root of ``exact``."""
    return np.sqrt(exact.astype(np.float64)) * (1 - EPS)


def means(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count); ``old`` where nothing was counted."""
    n = counts[..., None]
    return np.where(n > 0, sums // np.maximum(n, 1), old)
