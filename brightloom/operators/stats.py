"""Statistics of tables, keys and performance samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rec_per_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row for each prefix of a key: columns, n_rows, n_distinct, rec_per_key (rows for one value, 1 at least)."""
    counts = df.agg(F.count("*").alias("n_rows"), *(F.countDistinct(F.struct(*key[: k + 1])).alias(f"d{k}") for k in range(len(key))))
    rows = F.array(*(F.struct(F.lit(",".join(key[: k + 1])).alias("columns"), F.col(f"d{k}").alias("n_distinct")) for k in range(len(key))))
    told = counts.select("n_rows", F.explode(rows).alias("r")).select("r.columns", "n_rows", "r.n_distinct")
    return told.withColumn("rec_per_key", F.greatest(F.floor(F.col("n_rows") / F.col("n_distinct")), F.lit(1)).cast("long"))


def interpolated(rows: int, k: int, n: int, unique: bool, last: int | None = None) -> int:
    """rec_per_key of a prefix of k of n columns without counting, 1 at least.

    Of a unique key the distinct values are taken to grow evenly with its columns, from 1 to ``rows``; of another from 1
    to rows / last, where ``last`` is the counted value of the whole key, or a tenth of the rows and one more."""
    if rows < 1:
        return 1
    if unique:
        return 1 if k == n else max(int(rows ** ((n - k) / n)), 1)
    last = last or rows // 10 + 1
    return max(last, 1) if k == n else max(min(int(rows / (rows / last) ** (k / n)), rows), 1)


def range_count(df: DataFrame, where: Column) -> DataFrame:
    """How many rows a range holds, exactly; never told as 0."""
    return df.filter(where).agg(F.greatest(F.count("*"), F.lit(1)).alias("n_rows"))


def histogram(samples: DataFrame, group: str, value: str) -> DataFrame:
    """calls, mean, exact interpolated percentiles, max and total of each group."""
    p = F.percentile(F.col(value), F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return (
        samples.groupBy(group).agg(F.count("*").alias("calls"), F.avg(value).alias("mean"), p.alias("p"), F.max(value).alias("max"), F.sum(value).alias("total"))
        .select(group, "calls", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "max", "total"))


def difference(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """Two histograms side by side: what a group lacks counts as 0, the greatest growth of the total first."""
    both = before.select(group, *(F.col(c).alias(f"a_{c}") for c in ("calls", "p50", "p99", "total"))).join(
        after.select(group, *(F.col(c).alias(f"b_{c}") for c in ("calls", "p50", "p99", "total"))), group, "full_outer").na.fill(0)
    return both.select(
        group, F.greatest("a_calls", "b_calls").alias("calls"), (F.col("b_p50") - F.col("a_p50")).alias("d_p50"),
        (F.col("b_p99") - F.col("a_p99")).alias("d_p99"), (F.col("b_total") - F.col("a_total")).alias("d_total")).orderBy(F.desc("d_total"), group)
