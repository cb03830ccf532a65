"""Reading and writing tables, with the options a table may carry."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_OPTION_BYTES = 64 * 1024
#: Options of a table: name -> default. Other keys are passed over.
OPTIONS = {"compression": "SNAPPY", "bloom_filter": False, "bloom_fpr": 0.01, "ttl": 0, "footer_key": "", "column_keys": ""}
CODECS = {"NONE": "none", "SNAPPY": "snappy", "LZ4": "lz4_raw", "LZ4_FAST": "lz4_raw", "ZSTD": "zstd"}


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def options(attribute: str | None) -> dict:
    """Options from a JSON attribute: malformed JSON gives the defaults, more than 64 KiB is refused."""
    if attribute is not None and len(attribute.encode()) > MOST_OPTION_BYTES:
        raise ValueError("table options are longer than 64 KiB")
    try:
        given = json.loads(attribute) if attribute else {}
    except ValueError:
        given = {}
    return OPTIONS | {k: v for k, v in (given.items() if isinstance(given, dict) else ()) if k in OPTIONS}


def write(df: DataFrame, path: str, key: list[str] | None = None, mode: str = "errorifexists", attribute: str | None = None) -> None:
    """Write Parquet clustered by the key, so that the files' statistics prune key ranges."""
    told = options(attribute)
    out = df.sortWithinPartitions(*key) if key else df
    writer = out.write.mode(mode).option("compression", CODECS[str(told["compression"]).upper()])
    if told["bloom_filter"] and key:
        for k in key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.fpp#{k}", str(told["bloom_fpr"]))
    for k in ("footer_key", "column_keys"):  # names of keys; the session's Hadoop settings name the crypto factory and the key service
        if told[k]:
            writer = writer.option(f"parquet.encryption.{k.replace('_', '.')}", told[k])
    writer.parquet(path)


def backup(df: DataFrame, path: str) -> None:
    """A copy that never overwrites."""
    df.write.mode("errorifexists").parquet(path)


def convert(spark: SparkSession, source: str, source_format: str, target: str, target_format: str) -> None:
    """Read one format and write another."""
    spark.read.format(source_format).load(source).write.mode("errorifexists").format(target_format).save(target)


def create_as(df: DataFrame, path: str, key: list[str] | None = None, attribute: str | None = None) -> DataFrame:
    """CREATE TABLE ... AS SELECT: write a query's rows as a new table, which must not exist, and read it."""
    write(df, path, key, attribute=attribute)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rename_table(spark: SparkSession, path: str, target: str) -> None:
    """Give a table another path, in one step of the store; FileExistsError if that is taken."""
    a, b = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (path, target))
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(b):
        raise FileExistsError(target)
    if not fs.exists(a) or not fs.rename(a, b):
        raise FileNotFoundError(path)


def drop_table(spark: SparkSession, path: str, if_exists: bool = False) -> None:
    """Delete a table's files; FileNotFoundError if there is none, unless ``if_exists``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.delete(where, True) and not if_exists:
        raise FileNotFoundError(path)


def _bytes(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and files of a table, by the store's listing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    told = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where)
    return told.getLength(), told.getFileCount()


def table_stats(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """One row: table_name, row_count, column_count, data_length (bytes of the files below ``path``, null without) and
    avg_row_length (bytes of files for a row). Only the rows are counted; none is read."""
    size = F.lit(_bytes(df.sparkSession, path)[0] if path else None).cast("long")
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"), size.alias("data_length"), F.floor(size / F.greatest("row_count", F.lit(1))).alias("avg_row_length"))


def status(spark: SparkSession, directory: str) -> DataFrame:
    """table_name, column_count, data_length, files of all Parquet tables of a directory, from listings and footers only."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    names = sorted(s.getPath().getName() for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where))
    rows = []
    for n in names:
        if n.endswith(".parquet"):
            rows.append((n.removesuffix(".parquet"), len(spark.read.parquet(f"{directory}/{n}").columns), *_bytes(spark, f"{directory}/{n}")))
    return spark.createDataFrame(rows, "table_name string, column_count int, data_length long, files long")


def check(df: DataFrame, key: list[str]) -> DataFrame:
    """CHECK TABLE: one row of row_count, null_keys, repeated_keys and ok, after reading every column of every row."""
    hashed = df.select(*key, F.xxhash64(*df.columns).alias("read_"))
    known = " and ".join(f"{k} is not null" for k in key)
    counts = hashed.groupBy(*key).agg(F.count("*").alias("n"), F.max("read_").alias("read_"))
    told = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.when(F.expr(f"not ({known})"), F.col("n"))), F.lit(0)).alias("null_keys"),
                      F.count(F.when(F.expr(f"n > 1 and {known}"), 1)).alias("repeated_keys"), F.max("read_").alias("read_"))
    return told.select("row_count", "null_keys", "repeated_keys", ((F.col("null_keys") == 0) & (F.col("repeated_keys") == 0)).alias("ok"))
