"""Last-wins logs, resume, recovery of complete parents, unions and version hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key; one pass with map-side combination instead of a sort of each key."""
    columns = df.columns
    latest = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return latest.select(*[F.col(f"_row.{c}").alias(c) for c in columns])


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are not done yet."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def complete_parents(parents: DataFrame, children: DataFrame, key: str, expected: str, ok: Column | None = None) -> DataFrame:
    """Parents whose children number as expected and are all in order."""
    good = ok if ok is not None else F.lit(True)
    counted = children.groupBy(key).agg(F.count("*").alias("_n"), F.count_if(good).alias("_good"))
    return parents.join(counted, key, "left").where((F.coalesce("_n", F.lit(0)) == F.col(expected)) & (F.coalesce("_good", F.lit(0)) == F.col(expected))).drop("_n", "_good")


def first_complete(parents: DataFrame, children: DataFrame, keys: list[str], expected: str, order: str) -> DataFrame:
    """The first of the rows of each key whose children number as expected."""
    counted = children.groupBy(*keys).agg(F.count("*").alias("_n"))
    good = parents.join(counted, keys, "left").where(F.coalesce("_n", F.lit(0)) == F.col(expected)).drop("_n")
    columns = [c for c in good.columns if c not in keys]
    return good.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])


def without_errors(df: DataFrame, error: str) -> DataFrame:
    """Rows without an error, null and empty alike."""
    return df.where(F.coalesce(F.col(error).cast("string"), F.lit("")) == "")


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, class_id, copies): class of rows of equal text, named by the smallest key. Copies are not paired off."""
    hashed = df.where(F.col(text).isNotNull()).select(key, F.sha2(text, 256).alias("_h"))
    classes = hashed.groupBy("_h").agg(F.min(key).alias("class_id"), F.count("*").alias("copies"))
    return hashed.join(classes.where("copies > 1"), "_h").select(key, "class_id", "copies")


def version_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows and a hash of the table that no order changes: row hashes added up in two parts, so nothing is brought together."""
    row = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    part = lambda a: F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n_rows"), part(1).alias("hash_a"), part(13).alias("hash_b"))
