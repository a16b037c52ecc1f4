"""Text, retrieval, abstention and calibration metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.text import words


def char_error(hypothesis: Column, reference: Column, empty: str = "scorer") -> Column:
    """Edits over reference length. Of an empty reference: over 1 (scorer), 0 or 1 (test), null (exclude)."""
    d, n = F.levenshtein(hypothesis, reference), F.length(reference)
    if empty == "scorer":
        return d / F.greatest(F.lit(1), n)
    return F.when(n > 0, d / n).otherwise(F.when(F.length(hypothesis) == 0, F.lit(0.0)).otherwise(F.lit(1.0)) if empty == "test" else F.lit(None).cast("double"))


def word_edits(hypothesis: Column | str, reference: Column | str) -> Column:
    """Edits between the words of two texts, in the JVM: each distinct word becomes one character, and characters are compared. Null where a text is null."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (hypothesis, reference))
    a, b = words(x), words(y)
    known = F.array_distinct(F.concat(a, b))
    # Planes beyond the first hold a million characters, and none of them is half of a pair.
    sign = lambda w: F.lpad(F.hex(F.array_position(known, w) + 0x10000), 8, "0")
    coded = lambda ws: F.decode(F.unhex(F.array_join(F.transform(ws, sign), "")), "UTF-32")
    return F.when(x.isNotNull() & y.isNotNull(), F.levenshtein(coded(a), coded(b)))


def word_f1(pairs: DataFrame, key: str, hypothesis: str, reference: str, multiset: bool = True, both_empty: float = 1.0) -> DataFrame:
    """(``key``, word_f1) by counts of words, or by sets of words."""
    count = lambda c, n: pairs.select(key, F.explode(words(F.col(c))).alias("w")).groupBy(key, "w").agg((F.count("*") if multiset else F.lit(1).cast("bigint")).alias(n))
    joined = count(hypothesis, "h").join(count(reference, "r"), [key, "w"], "full")
    sums = joined.groupBy(key).agg(F.sum(F.least(F.coalesce("h", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("both"), F.coalesce(F.sum("h"), F.lit(0)).alias("nh"), F.coalesce(F.sum("r"), F.lit(0)).alias("nr"))
    f1 = F.when(F.col("nh").isNull() | (F.col("nh") + F.col("nr") == 0), F.lit(both_empty)).when(F.col("both") == 0, F.lit(0.0)).otherwise(2.0 * F.col("both") / (F.col("nh") + F.col("nr")))
    return pairs.select(key).join(sums, key, "left").select(key, f1.alias("word_f1"))


def first_ranks(hits: DataFrame, unit: str, at: str | None = None) -> DataFrame:
    """Ranks over distinct units (pages) in the order of their best hit, and of their place ``at`` within it: (query_id, ``unit``, unit_rank)."""
    best = hits.groupBy("query_id", unit).agg(F.min(F.struct("rank", F.col(at) if at else F.lit(0))).alias("best"))
    return best.withColumn("unit_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best", unit))).drop("best")


def chunk_hits(hits: DataFrame, chunk_units: DataFrame, gold: DataFrame, unit: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """For each query with hits, whether one of the first k chunks holds a gold unit."""
    good = hits.join(chunk_units, "item_id").join(gold, ["query_id", unit], "left_semi").select("query_id", "item_id").distinct().withColumn("good", F.lit(1))
    own = hits.join(good, ["query_id", "item_id"], "left")
    return own.groupBy("query_id").agg(*[F.max(F.when((F.col("rank") <= k) & F.col("good").isNotNull(), 1).otherwise(0)).alias(f"hit_at_{k}") for k in ks])


def span_found(hits: DataFrame, texts: DataFrame, spans: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, found): whether the span stands in one of the first ``k`` texts, whatever its case."""
    own = hits.where(F.col("rank") <= k).join(spans, "query_id").join(texts, "item_id")
    return own.groupBy("query_id").agg(F.max(F.coalesce(F.contains(F.lower("text"), F.lower("span")), F.lit(False)).cast("int")).alias("found"))


def best_threshold(scores: DataFrame, points: int = 100, margin: float = 0.05) -> DataFrame:
    """(tau, objective): of evenly spaced thresholds over the scores and a margin, the lowest with the highest F1 and share of answered queries together."""
    ends = scores.agg((F.min("score") - margin).alias("low"), (F.max("score") + margin).alias("high"))
    grid = scores.sparkSession.range(points).crossJoin(F.broadcast(ends)).select((F.col("low") + F.col("id") * (F.col("high") - F.col("low")) / float(points - 1)).alias("tau"))
    swept = threshold_sweep(scores, grid)
    objective = F.round(F.col("f1") + F.coalesce(F.col("tn") / F.nullif(F.col("tn") + F.col("fp"), F.lit(0)), F.lit(0.0)), 9)
    best = swept.withColumn("objective", objective).agg(F.min_by(F.struct("tau", "objective"), F.struct(-F.col("objective"), "tau")).alias("b"))
    return best.select("b.tau", "b.objective")


def select_best(models: DataFrame, name: str) -> DataFrame:
    """The row with the highest r5, mrr, coverage and span, then the lowest latency, then the first name."""
    order = F.struct(-F.col("r5"), -F.col("mrr"), -F.col("coverage"), -F.col("span"), "latency", name)
    columns = models.columns
    return models.agg(F.min_by(F.struct(*columns), order).alias("b")).select("b.*")


def retrieval_metrics(gold: DataFrame, ranked: DataFrame, unit: str, ks: tuple[int, ...] = (1, 5, 10), depth: int = 10) -> DataFrame:
    """For each query of (query_id, ``unit``) gold rows: hits at k, reciprocal rank, coverage and whether all were found."""
    own = gold.join(ranked, ["query_id", unit], "left")
    rank = F.col("unit_rank")
    return own.groupBy("query_id").agg(
        *[F.max((F.coalesce(rank, F.lit(1 << 30)) <= k).cast("int")).alias(f"hit_at_{k}") for k in ks],
        F.coalesce(F.max(F.when(rank <= depth, 1.0 / rank)), F.lit(0.0)).alias("reciprocal_rank"),
        F.avg((F.coalesce(rank, F.lit(1 << 30)) <= depth).cast("double")).alias("coverage"),
        F.min((F.coalesce(rank, F.lit(1 << 30)) <= depth).cast("int")).alias("all_found"),
    )


def abstention(scores: DataFrame, threshold: Column) -> list[Column]:
    """Confusion counts and rates where abstaining is the positive class; rates without a base are null."""
    abstain, negative = F.col("score") < threshold, F.col("is_negative")
    tp, fp = F.count_if(abstain & negative), F.count_if(abstain & ~negative)
    fn, tn = F.count_if(~abstain & negative), F.count_if(~abstain & ~negative)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        (tp / F.nullif(tp + fp, F.lit(0))).alias("precision"), (tp / F.nullif(tp + fn, F.lit(0))).alias("recall"),
        (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"), ((tp + tn) / F.nullif(tp + fp + fn + tn, F.lit(0))).alias("accuracy"),
    ]


def threshold_sweep(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Confusion at each of a short list of thresholds (column tau): scores are counted once into the gaps between them."""
    grid = thresholds.select("tau").distinct()
    taus = sorted(r["tau"] for r in grid.collect())  # a grid of about a hundred
    gap = F.size(F.filter(F.array(*[F.lit(t) for t in taus]), lambda t: t <= F.col("score")))
    gaps = scores.select(gap.alias("gap"), "is_negative").groupBy("gap").agg(F.count_if("is_negative").alias("neg"), F.count_if(~F.col("is_negative")).alias("pos"))
    at = scores.sparkSession.createDataFrame(list(enumerate(taus)), "i int, tau double")
    # Abstains at tau i when the score lies below it: in gaps 0 .. i.
    own = F.broadcast(at).join(gaps, F.lit(True)).groupBy("tau").agg(
        F.sum(F.when(F.col("gap") <= F.col("i"), F.col("neg")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("gap") <= F.col("i"), F.col("pos")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("gap") > F.col("i"), F.col("neg")).otherwise(0)).alias("fn"), F.sum(F.when(F.col("gap") > F.col("i"), F.col("pos")).otherwise(0)).alias("tn"),
    )
    return own.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0)))


def bootstrap_interval(values: DataFrame, value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(mean, low, high): percentile interval of the mean by the Poisson bootstrap, in one pass: each row weighs in each resample by a hashed Poisson draw.

    Sums of all resamples are added up in the tasks, so the table is never multiplied.
    """

    # Chances of 0, 1, 2, ... in a Poisson draw of mean 1.
    chances = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))
    marks = np.uint64(seed) + np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(resamples), np.zeros(resamples)
        for pdf in frames:
            h, v = pdf["h"].to_numpy().astype(np.int64).view(np.uint64), pdf["v"].to_numpy(np.float64)
            for a in range(0, len(h), 500):
                x = h[a : a + 500, None] ^ marks  # a mixed hash of row and resample is its draw
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
                w = np.searchsorted(chances, u.ravel()).reshape(u.shape)
                total += v[a : a + 500] @ w
                weight += w.sum(0)
        yield pd.DataFrame({"b": range(resamples), "s": total, "w": weight})

    keyed = values.where(F.col(value).isNotNull()).select(F.xxhash64(*values.columns).alias("h"), F.col(value).cast("double").alias("v"))
    means = keyed.mapInPandas(sums, "b int, s double, w double").groupBy("b").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    ends = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return keyed.agg(F.avg("v").alias("mean")).crossJoin(ends)


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(ece): mean gap of confidence and accuracy over equal bins, weighted by rows (our design)."""
    bin_ = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    binned = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))
