"""Statistics, totals, consensus and fused records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of each group (key columns without nulls)."""
    sums = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return sums.join(exact_percentiles(df, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), group, "left")


def modal(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equals the one that comes first."""
    counted = df.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counted.groupBy(*group).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "first_seen")).alias("b")).select(*group, F.col(f"b.{value}").alias("mode"), F.col("b.n").alias("n"))


def combinations(df: DataFrame, unit: str, member: str) -> DataFrame:
    """How many units each combination of members occurs in."""
    sets = df.groupBy(unit).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return sets.groupBy("members").agg(F.count("*").alias("n"))


def cut_points(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows with the bucket that two percentiles of all rows put them in."""
    ends = exact_percentiles(df, [], value, {"_lo": low, "_hi": high})
    bucket = F.when(F.col(value) <= F.col("_lo"), "low").when(F.col(value) >= F.col("_hi"), "high").otherwise("middle")
    return df.crossJoin(F.broadcast(ends)).withColumn("bucket", bucket).drop("_lo", "_hi")


def fused(df: DataFrame, group: list[str], member: str, precedence: Column, field: str) -> DataFrame:
    """One record a group: votes, the representative, the first field that is filled by precedence, and all values."""
    filled = F.when(F.col(field).isNotNull() & (F.col(field).cast("string") != ""), precedence)
    return df.groupBy(*group).agg(
        F.countDistinct(member).alias("votes"), F.min_by(member, F.struct(precedence, member)).alias("representative"),
        F.min_by(field, F.struct(filled.isNull(), filled, member)).alias("value"), F.array_sort(F.collect_set(field)).alias("alternates"),
    )


def missing_numbers(df: DataFrame, group: str, number: str, first: int = 1) -> DataFrame:
    """(``group``, number): numbers from ``first`` to the highest of the group that no row has; groups without numbers miss none."""
    tops = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.max(F.col(number).cast("bigint")).alias("_top")).where(F.col("_top") >= first)
    wanted = tops.select(group, F.explode(F.sequence(F.lit(first).cast("bigint"), "_top")).alias("number"))
    return wanted.join(df.select(group, F.col(number).cast("bigint").alias("number")).distinct(), [group, "number"], "left_anti")


def exact_percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(``group``, one column a share): exact percentiles with linear interpolation; null values are left out.

    Values are cut into ``BINS`` ranges a group by an approximate pass, the ranges counted,
    and only the ranges that hold a wanted place are looked at value by value, with equal values
    as one row and a count. No task holds the values of a group, however large it is.
    """
    own = df.where(F.col(value).isNotNull()).select(*[F.col(g).alias(g) for g in group], F.col(value).cast("double").alias("_v"))
    counted = own.groupBy(*group, "_v").agg(F.count("*").alias("_n"))
    cuts = [i / BINS for i in range(1, BINS)]
    bounds = own.groupBy(*group).agg(F.percentile_approx("_v", cuts, 10 * BINS).alias("_cuts"), F.count("*").alias("_rows"))

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(g).alias(f"_k_{g}") for g in group], *[c for c in b.columns if c not in group])
        on = F.lit(True)
        for g in group:
            on = on & F.col(g).eqNullSafe(F.col(f"_k_{g}"))
        return a.join(b, on).drop(*[f"_k_{g}" for g in group])

    placed = joined(counted, bounds).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    sums = placed.groupBy(*group, "_bin", "_rows").agg(F.sum("_n").alias("_in"))
    w = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(w), F.lit(0)))  # BINS rows a group
    places = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("_rows") - 1)).alias("at")) for name, p in shares.items()])
    wanted = sums.select(*group, "_bin", "_before", F.explode(F.filter(places, lambda x: (F.ceil(x["at"]) >= F.col("_before")) & (F.floor(x["at"]) < F.col("_before") + F.col("_in")))).alias("_p"))
    near = joined(placed.withColumnRenamed("_bin", "_own_bin"), wanted).where("_own_bin = _bin")
    run = F.sum("_n").over(Window.partitionBy(*group, "_bin", "_p.name").orderBy("_v"))
    near = near.withColumn("_high", F.col("_before") + run - 1).withColumn("_low", F.col("_high") - F.col("_n") + 1)
    low, high = F.floor("_p.at"), F.ceil("_p.at")
    at = lambda k: F.max(F.when((F.col("_low") <= k) & (F.col("_high") >= k), F.col("_v")))
    ends = near.groupBy(*group, F.col("_p.name").alias("_name"), F.col("_p.at").alias("_at")).agg(at(low).alias("_a"), at(high).alias("_b"))
    part = F.col("_at") - F.floor("_at")
    # To the last digit as DuckDB has it: low * (1 - part) + high * part with one rounding of product and sum. A value at the place itself is taken as it is.
    fused = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), F.col("_a"), 1 - part, F.col("_b") * part).cast("double")
    ends = ends.withColumn("_value", F.when(part == 0, F.col("_a")).otherwise(fused))
    return ends.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in shares])


#: Ranges that the values of a group are cut into.
BINS = 64


def subgroup_gap(df: DataFrame, group: str, value: str) -> DataFrame:
    """Largest less smallest mean of the groups (our design)."""
    return df.groupBy(group).agg(F.avg(value).alias("m")).agg((F.max("m") - F.min("m")).alias("gap"))


def repeated_units(df: DataFrame, unit: str, place: str) -> DataFrame:
    """Units that stand in more than one place."""
    return df.groupBy(unit).agg(F.countDistinct(place).alias("places")).where("places > 1")


def flag_counts(df: DataFrame, flags: str, sign: str = "|") -> DataFrame:
    """(flag, n) of flags joined by a sign in one column."""
    return df.select(F.explode(F.split(flags, "\\" + sign)).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
