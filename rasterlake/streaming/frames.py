"""Live frames: crops read once however often they come, by keyed state on a hash that equality then confirms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def crop_hash(pixels: str = "pixels"):
    return F.xxhash64(pixels)


def read_distinct(crops: DataFrame, read: Callable[[DataFrame], DataFrame], key: str = "pixels") -> DataFrame:
    """Batch form: each distinct crop is read once, and its reading goes to every row with the same pixels.

    read() gets (hash, key) and returns them with what it reads. A hash only deals rows out; equality decides.
    """
    once = crops.select(F.xxhash64(key).alias("hash"), key).distinct()
    return crops.withColumn("hash", F.xxhash64(key)).join(read(once), ["hash", key]).drop("hash")


def new_crops(stream: DataFrame, key: str = "pixels", time: str = "ts", keep: str = "1 hour") -> DataFrame:
    """Stream form: the first of equal crops within the time that state is kept; state is bounded by the watermark."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def stream_table(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def changed_counts(stream: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Rows of a stream (ts, key) by key and time window; rows later than `late` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "key").agg(F.count(F.lit(1)).alias("n")).select("window.start", "key", "n")


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, as a table in memory of the driver: for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
