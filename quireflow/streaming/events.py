"""Windowed counts, last-wins logs and new rows of streams.

An extension. Each operator takes a streaming or a batch DataFrame of (event_id, ts,
user_id, event_type, value) alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.runtime import shared_dir


def read_events(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """Stream of the files of a table."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and sum of values by window and type; rows later than ``late`` are dropped from a stream."""
    return _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    return _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    """The first of the rows that repeat an id within ``late``."""
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and gives the last table it wrote."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
