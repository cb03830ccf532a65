"""Quantified comparisons with the values of a subquery, as aggregates of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bounds(values: DataFrame) -> DataFrame:
    value = F.col(values.columns[0])
    return values.agg(F.count("*").alias("all_n"), F.count(value).alias("all_known"), F.max(value).alias("all_max"), F.min(value).alias("all_min"))


def greater_than_all(df: DataFrame, column: Column, values: DataFrame) -> DataFrame:
    """Rows with column > ALL (values): all rows for no values, none if one is null."""
    met = df.crossJoin(F.broadcast(_bounds(values)))  # one row
    return met.filter((F.col("all_n") == 0) | ((F.col("all_n") == F.col("all_known")) & (column > F.col("all_max")))).select(*df.columns)


def greater_than_any(df: DataFrame, column: Column, values: DataFrame) -> DataFrame:
    """Rows with column > ANY (values): none for no values; nulls among them do not matter."""
    return df.crossJoin(F.broadcast(_bounds(values))).filter(column > F.col("all_min")).select(*df.columns)


def not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows with column NOT IN (values): one null among the values leaves nothing, and a null column only passes an
    empty list."""
    name = values.columns[0]
    bounds = values.agg(F.count("*").alias("all_n"), F.count(name).alias("all_known"))
    left = df.join(values.select(F.col(name).alias("not_in_")).distinct(), F.col(column) == F.col("not_in_"), "left_anti")
    return left.crossJoin(F.broadcast(bounds)).filter((F.col("all_n") == 0) | ((F.col("all_n") == F.col("all_known")) & F.col(column).isNotNull())).select(*df.columns)
