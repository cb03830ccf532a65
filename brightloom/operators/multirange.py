"""Reads of many keys or ranges at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_keys(df: DataFrame, on: dict[str, str], keys: DataFrame) -> DataFrame:
    """Rows whose columns equal those of some row of ``keys`` (column of df -> column of keys): a semi-join, whose
    physical form Catalyst picks by the list's size. Nulls equal nothing."""
    own = keys.select(*(F.col(k).alias(f"key_{k}_") for k in on.values()))
    condition = [F.col(c) == F.col(f"key_{k}_") for c, k in on.items()]
    return df.join(own, condition, "left_semi")


def merged(ranges: DataFrame, low: str = "lo", high: str = "hi", width: float = 1000) -> DataFrame:
    """Closed ranges as disjoint pieces within cells of ``width``: cell, lo, hi. Overlapping ones become one in each cell,
    so that a value lies in one piece at most; cells are merged apart, on the executors. Empty ranges and nulls go."""
    lo, hi = F.col(low), F.col(high)
    rows = ranges.select(lo.alias("lo"), hi.alias("hi")).filter("lo <= hi")
    rows = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width).cast("long"), F.floor(F.col("hi") / width).cast("long"))))
    rows = rows.groupBy("cell", "lo").agg(F.max("hi").alias("hi"))
    before = Window.partitionBy("cell").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("new", F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True)).cast("int"))
    rows = rows.withColumn("group", F.sum("new").over(Window.partitionBy("cell").orderBy("lo")))
    return rows.groupBy("cell", "group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("group")


def in_ranges(df: DataFrame, column: str, ranges: DataFrame, low: str = "lo", high: str = "hi", width: float = 1000) -> DataFrame:
    """Rows whose column lies in one of many closed ranges, each row once: an equi-join on cells of ``width`` (choose it
    about as large as a range), not a comparison of all rows with all ranges."""
    pieces = merged(ranges, low, high, width)
    cell = F.floor(F.col(column) / width).cast("long")
    inside: Column = (cell == F.col("cell")) & (F.col(column) >= F.col("lo_")) & (F.col(column) <= F.col("hi_"))
    return df.join(pieces.select("cell", F.col("lo").alias("lo_"), F.col("hi").alias("hi_")), inside, "left_semi")
