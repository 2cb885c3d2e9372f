"""Scoring formulas as Column builders, and those of term weights over arrays."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, RRF_K = 1.2, 0.75, 60


def idf(n: Column, df: Column) -> Column:
    """ln((n - df + 0.5) / (df + 0.5) + 1); a term in no document has df 0."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def length_norms(length: np.ndarray, average: float, b: float = B) -> np.ndarray:
    return 1 - b + b * length / average if average > 0 else np.ones(len(length))


def term_weights(tf: np.ndarray, idf_: np.ndarray, norm: np.ndarray, use_idf: bool, saturation: bool, use_length: bool, k1: float = K1) -> np.ndarray:
    norm = norm if use_length else 1.0
    weight = tf * (k1 + 1) / (tf + k1 * norm) if saturation else tf / norm
    return idf_ * weight if use_idf else weight


def rrf(rank: Column, k: int = RRF_K) -> Column:
    return 1 / (k + rank)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def ratio0(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio0(2 * precision * recall, precision + recall)


def deficit(gain: Column, base: Column) -> Column:
    """(gain - base) / (1 - base); null at the ceiling."""
    return F.when(base < 1, (gain - base) / (1 - base))


def unit(v: Column) -> Column:
    """L2-normalised doubles; a zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
