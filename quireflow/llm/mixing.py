"""Mixing sources to target shares by Pareto order sampling.

The size of a source is the sum of the tokens of its documents. The size of the mixture
(by default that of the corpus) is shared out to the sources in proportion to their target
shares; what a source cannot fill even with every document ``max_repeats`` times goes to
the others in the same proportion. A source then takes every document as many whole times
as fit (certain copies) and fills the rest with a sample: inclusion probabilities rise with
the square root of the size, so that long documents are neither crowded out nor drawn by
length alone, documents are ranked by random odds over inclusion odds, and the first are
taken until the rest is filled. The size is fixed in tokens, not in documents, to within one
document. Documents whose probability would reach 1 are certain: they are taken first, and the
probabilities of the others are raised to fill what they leave, until no more reach 1.

The cut of the ranking is found without bringing a source together: ranks fall into
``BINS`` bins, whose sums show the bin of the cut; only documents of that bin are ordered.

Defined results: documents of size 0 (null and empty texts) are never taken; documents with
a null source or one without a target are left out; a target without documents gets
nothing and is reported with 0. A null or negative share counts as 0, a null ``max_repeats``
as 1. Draws depend on the id and the seed alone, and repeated ids count as documents each.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of the ranking: the documents of one of them are ordered in one task.
BINS = 4096
#: Power of the size in the inclusion probability.
POWER = 0.5
#: Rounds of taking out certain documents at most.
ROUNDS = 8


def allocate(sources: dict[str, tuple[float, int, int]], total: float) -> dict[str, float]:
    """Tokens for each source of (share, capacity, ...): capacity fills first, the rest goes on in proportion."""
    given = dict.fromkeys(sources, 0.0)
    open_ = {s for s, (share, capacity, _) in sources.items() if share > 0 and capacity > 0}
    left = total
    while open_ and left > 1e-9:
        weight = sum(sources[s][0] for s in open_)
        full = {s for s in open_ if given[s] + left * sources[s][0] / weight >= sources[s][1]}
        if not full:
            for s in open_:
                given[s] += left * sources[s][0] / weight
            break
        for s in full:
            left -= sources[s][1] - given[s]
            given[s] = float(sources[s][1])
        open_ -= full
        # Shares of the others are taken anew from nothing, so that they keep their proportion.
        left += sum(given[s] for s in open_)
        for s in open_:
            given[s] = 0.0
    return given


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents taken; ``documents`` has (doc_id, source, n_tokens)."""
    spark = documents.sparkSession
    usable = documents.where("source IS NOT NULL AND n_tokens > 0").select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    goal = targets.groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
    sized = usable.join(goal, "source").groupBy("source").agg(
        F.first("share").alias("share"), F.first("most").alias("most"), F.sum("n_tokens").alias("size"), F.sum(F.pow("n_tokens", F.lit(1.0 + POWER))).alias("moment"), F.max("n_tokens").alias("longest")
    )
    rows = sized.collect()  # a row for each source of the targets
    total = float(total_tokens if total_tokens is not None else sum(r["size"] for r in rows))
    given = allocate({r["source"]: (r["share"], r["size"] * max(r["most"], 0), r["size"]) for r in rows}, total)
    plan = {}
    for r in rows:
        whole = min(int(given[r["source"]] // r["size"]), max(r["most"], 0))
        rest = given[r["source"]] - whole * r["size"] if whole < r["most"] else 0.0
        # p = factor * tokens ** POWER adds up to about the rest.
        plan[r["source"]] = [r["source"], whole, float(rest), rest / r["moment"] if r["moment"] else 0.0]
    kinds = "source string, whole int, rest double, factor double"
    certain = dict.fromkeys(plan, 0)
    for _ in range(ROUNDS if plan else 0):
        sure = F.col("factor") * F.pow("n_tokens", F.lit(POWER)) >= 1
        now = usable.join(F.broadcast(spark.createDataFrame(list(map(tuple, plan.values())), kinds)), "source").groupBy("source").agg(
            F.count_if(sure).alias("n"), F.sum(F.when(sure, F.col("n_tokens")).otherwise(0)).alias("size"), F.sum(F.when(sure, 0.0).otherwise(F.pow("n_tokens", F.lit(1.0 + POWER)))).alias("moment")
        ).collect()  # a row for each source of the targets
        if all(r["n"] == certain[r["source"]] for r in now):
            break
        for r in now:
            certain[r["source"]] = r["n"]
            left = plan[r["source"]][2] - r["size"]
            if r["n"] and left > 0 and r["moment"] > 0:
                plan[r["source"]][3] = max(plan[r["source"]][3], left / r["moment"])
    plan = list(map(tuple, plan.values()))
    plans = spark.createDataFrame(plan, "source string, whole int, rest double, factor double") if plan else spark.createDataFrame([], "source string, whole int, rest double, factor double")
    u = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    p = F.greatest(F.col("factor") * F.pow("n_tokens", F.lit(POWER)), F.lit(1e-12))
    odds = F.when(p >= 1, F.lit(0.0)).otherwise((u / (1 - u)) * (1 - p) / p)
    ranked = usable.join(F.broadcast(plans), "source").withColumn("rank", odds / (1 + odds)).withColumn("bin", F.floor(F.col("rank") * BINS))
    # Sums of bins: sources times BINS rows at most.
    sums = ranked.where("rest > 0").groupBy("source", "bin").agg(F.sum("n_tokens").alias("in_bin"), F.first("rest").alias("rest"))
    before = F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    edge = sums.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_bin") >= F.col("rest")))
    edge = edge.select("source", F.col("bin").alias("edge_bin"), "before")
    placed = ranked.join(F.broadcast(edge), "source", "left")
    at_edge = placed.where(F.col("bin") == F.col("edge_bin"))
    run = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at_edge = at_edge.withColumn("extra", (F.col("before") + run - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    off_edge = placed.where(F.col("edge_bin").isNull() | (F.col("bin") != F.col("edge_bin"))).withColumn("extra", ((F.col("rest") > 0) & (F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin")))).cast("int"))
    columns = ["doc_id", "source", "n_tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies")]
    return off_edge.select(*columns).unionByName(at_edge.select(*columns)).where("copies > 0")


def shares(mixture: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: documents and tokens at hand and taken, the share wanted and the share reached."""
    have = documents.where("n_tokens > 0").groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    took = mixture.groupBy("source").agg(F.count("*").alias("n_taken"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_taken"))
    joined = targets.select("source", "target_share", "max_repeats").join(have, "source", "left").join(took, "source", "left").na.fill(0, ["n_documents", "n_tokens", "n_taken", "most_copies", "tokens_taken"])
    whole = joined.agg(F.sum("tokens_taken").alias("all_taken"))
    return joined.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.coalesce(F.col("tokens_taken") / F.nullif("all_taken", F.lit(0)), F.lit(0.0))).drop("all_taken")
