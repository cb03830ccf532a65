"""Distances of vectors held as arrays, and the nearest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def nearest(df: DataFrame, column: str, key: str, query: Sequence[float], k: int, distance=euclidean) -> DataFrame:
    """The k rows nearest to ``query``, by distance and then key: one pass, a heap of k rows for each task."""
    return df.withColumn("distance", distance(F.col(column), literal(query))).filter("distance is not null").orderBy("distance", key).limit(k)
