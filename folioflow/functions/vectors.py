"""Vector functions over columns of array<float>; arithmetic is in doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for unequal lengths, empty vectors and zero norms."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (both == 0), 0.0).otherwise(dot(a, b) / both)


def strict_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; an error for unequal lengths, empty vectors and zero norms."""
    both = norm(a) * norm(b)
    wrong = (F.size(a) != F.size(b)) | (F.size(a) <= 0) | (both == 0)
    return F.when(wrong, F.raise_error(F.lit("vectors can't be compared")).cast("double")).otherwise(dot(a, b) / both)


def squared_distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def distance_score(d: Column) -> Column:
    return F.exp(-d)


@F.pandas_udf(ArrayType(FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a binary column."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
