"""Ranking, running numbers, runs, samples and other computations over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.runtime import materialize


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def running_offsets(df: DataFrame, order: list[str], count: str, name: str = "offset") -> DataFrame:
    """Sum of ``count`` over all rows before, in the total order of ``order``.

    Rows are range-partitioned and summed within partitions; only one sum a partition
    goes to the driver, so no task holds the whole table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "running-offsets")
    sums = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.sum(count).alias("n")).collect())
    before, base = [], 0
    for p, n in sums:
        before.append((p, base))
        base += n or 0
    offsets = df.sparkSession.createDataFrame(before, "_part int, _base bigint")
    run = F.sum(count).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_base") + F.coalesce(run, F.lit(0))).drop("_part", "_base")


def sequence(df: DataFrame, group: str, order: list[str], name: str = "seq") -> DataFrame:
    """Numbers from 1 within each group. Taken from the places in the whole order, so a group that holds much of the table fills no single task."""
    placed = materialize(running_offsets(df.withColumn("_one", F.lit(1)), [group, *order], "_one", "_at").drop("_one"), "sequence")
    first = placed.groupBy(F.col(group).alias("_g")).agg(F.min("_at").alias("_first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_g", "_at", "_first")


def _numbered(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` with ``_at``, its place in the order of groups and rows, written once."""
    return materialize(running_offsets(df.withColumn("_one", F.lit(1)), [*group, *order], "_one", "_at").drop("_one"), label)


def runs(df: DataFrame, group: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """Number of the run of equal values, counted from 1 in each group.

    Rows are compared with the row before by their place in the whole order, and the
    changes are added up over range partitions, so a group may hold any share of the table.
    ``order`` must tell all rows of a group apart.
    """
    placed = _numbered(df, group, order, "runs")
    before = placed.select((F.col("_at") + 1).alias("_at"), F.struct(*group, value).alias("_last"))
    same = F.col("_last").isNotNull() & F.struct(*group, value).eqNullSafe(F.col("_last"))
    changed = materialize(running_offsets(placed.join(before, "_at", "left").withColumn("_changed", (~same).cast("int")).drop("_last"), ["_at"], "_changed", "_before"), "runs-changed")
    changed = changed.withColumn("_run", F.col("_before") + F.col("_changed"))
    first = changed.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.min("_run").alias("_first"))
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = changed.join(first, on).withColumn(name, F.col("_run") - F.col("_first") + 1)
    return out.select(*df.columns, name)


def look_ahead(df: DataFrame, group: str, order: list[str], k: int, value: str) -> DataFrame:
    """Each row with the ``k`` values after it in its group, joined by places in the whole order."""
    placed = _numbered(df, [group], order, "look-ahead")
    own = placed.select("_at", F.col(group).alias("_g"), F.col(value).alias("_v"))
    # A row goes to the k places before it; of each place the values are told apart by distance.
    sent = own.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(k)))).select((F.col("_at") - F.col("_d")).alias("_to"), "_at", "_g", "_v").groupBy("_to", "_g").agg(*[F.max(F.when(F.col("_at") - F.col("_to") == i, F.col("_v"))).alias(f"next_{i}") for i in range(1, k + 1)])
    return placed.join(sent, (F.col("_at") == F.col("_to")) & F.col(group).eqNullSafe(F.col("_g")), "left").select(*df.columns, *[f"next_{i}" for i in range(1, k + 1)])


def islands(df: DataFrame, group: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Intervals merged where they overlap or lie within ``gap``: ``group``, start, end, n."""
    w = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = df.withColumn("_new", F.coalesce((F.col(start) > reach + gap).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(w))
    return own.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def stratified_first(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each stratum in scan order."""
    return top_k(df, [stratum], order, n, "place")


def even_sample(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """``k`` rows evenly spread over the order, first and last among them; all rows if there are fewer."""
    total = df.count()
    placed = running_offsets(df.withColumn("_one", F.lit(1)), order, "_one", "_at").drop("_one")
    if total <= k or k < 2:
        return placed.where(F.lit(total <= k) | (F.col("_at") < k)).drop("_at")
    wanted = sorted({round(j * (total - 1) / (k - 1)) for j in range(k)})
    return placed.where(F.col("_at").isin(wanted)).drop("_at")


def priority_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of the parts in which the first part that has a key wins; ``part`` tells which."""
    out = None
    for i, p in enumerate(parts):
        own = p.withColumn("part", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy("part"))).where("_place = 1").drop("_place")
