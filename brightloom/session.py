"""Session settings for a cluster or one machine."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "brightloom", **more: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``more`` overrides settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
