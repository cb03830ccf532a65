"""Streaming forms: sample files as a stream, running histograms, and windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.sources.versions import VersionedTable


def table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A folder of append-only Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_totals(stream: DataFrame, group: str, value: str) -> DataFrame:
    """calls, mean, max and total of each group over all that has come; for output mode complete or update."""
    return stream.groupBy(group).agg(F.count("*").alias("calls"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.sum(value).alias("total"))


def running_percentiles(stream: DataFrame, group: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """calls, mean, p50, p95, p99, max and total of each group over all that has come; the percentiles are those of
    mergeable summaries whose rank error is 1 / accuracy."""
    p = F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), accuracy)
    told = stream.groupBy(group).agg(F.count("*").alias("calls"), F.avg(value).alias("mean"), p.alias("p"), F.max(value).alias("max"), F.sum(value).alias("total"))
    return told.select(group, "calls", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "max", "total")


def keep_histogram(stream: DataFrame, group: str, value: str, table: VersionedTable, checkpoint: str):
    """Keep a table of exact totals by group up to date: every micro-batch is added up and merged into the next version.
    A batch that was merged before a failure is not merged twice. Returns the query, not yet awaited."""
    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(group).agg(F.count("*").alias("calls"), F.sum(value).alias("total"), F.max(value).alias("max")).withColumn("batch", F.lit(number).cast("long"))
        base = table.version()
        if base:
            old = table.read(base)
            if (old.agg(F.max("batch")).first()[0] or 0) >= number and number:
                return
            new = old.unionByName(new).groupBy(group).agg(F.sum("calls").alias("calls"), F.sum("total").alias("total"), F.max("max").alias("max"), F.max("batch").alias("batch"))
        table.commit(new, base)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def expiring(stream: DataFrame, key: str, time: str, lifetime: str, late: str) -> DataFrame:
    """Time to live in a stream: for each key a session that every row renews and that ends ``lifetime`` after the last one. Emits
    key, since, expired_at and writes once the watermark (``late`` behind the latest row) has passed the end."""
    if stream.isStreaming and dict(stream.dtypes)[time] == "timestamp_ntz":
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return (
        stream.withWatermark(time, late).groupBy(key, F.session_window(time, lifetime).alias("alive")).agg(F.count("*").alias("writes"))
        .select(key, F.col("alive.start").alias("since"), F.col("alive.end").alias("expired_at"), "writes"))


def windowed(stream: DataFrame, time: str, length: str, late: str, *keys: str, value: str | None = None) -> DataFrame:
    """Counts (and sums) in tumbling windows; rows later than the watermark are left out."""
    if stream.isStreaming and dict(stream.dtypes)[time] == "timestamp_ntz":  # watermarks need an instant
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    more = [F.sum(value).alias("total")] if value else []
    return (
        stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), *more)
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *(["total"] if value else [])))
