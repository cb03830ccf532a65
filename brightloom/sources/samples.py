"""Performance samples: fixed binary records with a JSON sidecar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one record: method u8, thread u8, reserved u16, 4 bytes of padding, enter u64, exit u64, little-endian.
RECORD = 24


def read_samples(spark: SparkSession, directory: str) -> DataFrame:
    """method_id, thread_id, cycles and ns of every record in the folder's .bin files; tsc_ghz is in its *-meta.json.

    Files are read by blocks of whole records, however large they are; bytes after a file's last whole record are left out. Calibration
    files are passed over."""
    ghz = spark.read.option("multiLine", True).json(f"{directory}/*-meta.json").select(F.col("tsc_ghz").cast("double")).first()[0]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-*-*.bin").load(directory).filter(~F.col("path").contains("calibration") & (F.col("length") >= RECORD))
    found = files.select("path", "length").collect()  # one row for each file
    whole = [f["path"] for f in found if f["length"] % RECORD == 0]
    kind = "method_id int, thread_id int, cycles long"
    out = spark.createDataFrame([], kind)
    if whole:
        out = out.unionByName(_told(spark.sparkContext.binaryRecords(",".join(whole), RECORD).map(lambda x: (bytearray(x),)).toDF("content binary")))
    cut = [f["path"] for f in found if f["length"] % RECORD]
    if cut:  # a file whose writer was stopped
        parts = spark.read.format("binaryFile").load(cut).select(F.expr(f"explode(sequence(0L, length div {RECORD} - 1)) as k"), "content")
        out = out.unionByName(_told(parts.select(F.expr(f"substring(content, cast(k * {RECORD} + 1 as int), {RECORD}) as content"))))
    return out.withColumn("ns", F.col("cycles") / F.lit(ghz))


def _told(records: DataFrame) -> DataFrame:
    def little(start: int, size: int):
        """A little-endian number of so many bytes."""
        own = [F.conv(F.hex(F.substring("content", start + k, 1)), 16, 10).cast("long") for k in range(size)]
        out = own[0]
        for k in range(1, size):
            out = out + F.shiftleft(own[k], 8 * k)
        return out

    return records.select(little(1, 1).cast("int").alias("method_id"), little(2, 1).cast("int").alias("thread_id"), (little(17, 8) - little(9, 8)).alias("cycles"))
