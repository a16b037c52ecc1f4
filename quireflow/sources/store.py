"""Store of chunks with their vectors: one table, validated on the way in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators.retrieval import unit


def build(chunks: DataFrame, path: str, vector: str = "embedding") -> None:
    """Writes chunks with unit vectors, and a table of what was written; vectors of uneven length, or not finite, raise."""
    own = chunks.withColumn(vector, unit(vector))
    stats = own.agg(F.count("*").alias("count"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"), F.count_if(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad")).first()
    if not stats["count"]:
        raise ValueError("no chunks")
    if stats["low"] != stats["high"] or (stats["low"] or 0) <= 0 or stats["bad"]:
        raise ValueError("vectors must be finite and of one length")
    own.write.mode("overwrite").parquet(f"{path}/chunks")
    spark = chunks.sparkSession
    spark.createDataFrame([(stats["count"], stats["low"])], "count bigint, dimension int").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load(spark: SparkSession, path: str, vector: str = "embedding") -> DataFrame:
    """The chunks; raises where count or length disagree with the table of what was written."""
    own = spark.read.parquet(f"{path}/chunks")
    meta = spark.read.schema("count bigint, dimension int").json(f"{path}/metadata").first()
    found = own.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    if meta is None or (found["n"], found["d"]) != (meta["count"], meta["dimension"]):
        raise ValueError(f"chunks and metadata disagree: {found['n']} and {meta and meta['count']}")
    return own
