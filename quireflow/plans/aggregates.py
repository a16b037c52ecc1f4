"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.catalog import Catalog, table
from quireflow.operators import aggregates as A
from quireflow.operators import metrics as M

DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT)"


def register(c: Catalog) -> None:
    q = c.query
    ev = lambda s, d: table(s, d, "events")

    @q("a1_corpus_stats", """SELECT count(*) AS rows, count(*) FILTER (coalesce(trim(text), '') <> '') AS filled, count(*) FILTER (ocr_source IS NULL) AS unsourced, CAST(sum(word_count) AS BIGINT) AS words FROM canonical_pages""")
    def _(s, d):
        return table(s, d, "canonical_pages").agg(F.count("*").alias("rows"), F.count_if(F.btrim(F.coalesce("text", F.lit("")), F.lit(" ")) != "").alias("filled"), F.count_if(F.col("ocr_source").isNull()).alias("unsourced"), F.sum("word_count").alias("words"))

    @q("a2_query_audit", """SELECT lower(trim(split)) AS split, count(*) FILTER (type = 'single_page') AS single_page, count(*) FILTER (type = 'multi_page') AS multi_page, count(*) FILTER (type = 'out_of_corpus') AS out_of_corpus
        FROM retrieval_queries GROUP BY 1""")
    def _(s, d):
        own = table(s, d, "retrieval_queries").withColumn("split", F.lower(F.btrim("split")))
        return own.groupBy("split").pivot("type", ["single_page", "multi_page", "out_of_corpus"]).count().na.fill(0)

    @q("a7_source_status", """SELECT ocr_source, count(*) AS n, count(*) FILTER (text IS NOT NULL AND text <> '') AS ok, avg(word_count) AS mean_words FROM canonical_pages GROUP BY 1""")
    def _(s, d):
        return table(s, d, "canonical_pages").groupBy("ocr_source").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNotNull() & (F.col("text") != "")).alias("ok"), F.avg("word_count").alias("mean_words"))

    @q("a8_confidence_by_bucket", """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_cont(value, 0.1) AS p10, avg(CASE WHEN value < 0.7 THEN 1.0 ELSE 0.0 END)::DOUBLE AS below FROM events GROUP BY 1""")
    def _(s, d):
        return ev(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.avg((F.col("value") < 0.7).cast("double")).alias("below")).join(A.exact_percentiles(ev(s, d), ["event_type"], "value", {"p10": 0.1}), "event_type")

    @q("a9_missing_numbers", """SELECT doc_id, number FROM (SELECT doc_id, unnest(range(1, top + 1)) AS number FROM (SELECT doc_id, max(page_num) AS top FROM canonical_pages WHERE doc_id IS NOT NULL GROUP BY 1))
        EXCEPT SELECT doc_id, page_num FROM canonical_pages""")
    def _(s, d):
        return A.missing_numbers(table(s, d, "canonical_pages"), "doc_id", "page_num")

    @q("a9_union_over_sources", """SELECT doc_id, count(DISTINCT page_num) AS pages, min(page_num) AS first, max(page_num) AS last, count(DISTINCT page_num) FILTER (ocr_source IS NOT NULL) AS named, count(*) FILTER (page_num NOT BETWEEN 1 AND 289) AS implausible
        FROM canonical_pages WHERE doc_id IS NOT NULL GROUP BY 1""")
    def _(s, d):
        number = F.col("page_num")
        return table(s, d, "canonical_pages").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.countDistinct(number).alias("pages"), F.min(number).alias("first"), F.max(number).alias("last"), F.countDistinct(F.when(F.col("ocr_source").isNotNull(), number)).alias("named"), F.count_if(~number.between(1, 289)).alias("implausible"))

    @q("a13_flag_counts", "SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(l_returnflag || '|' || l_linestatus || '|' || l_returnflag, '|')) AS flag FROM lineitem) GROUP BY 1")
    def _(s, d):
        return A.flag_counts(table(s, d, "lineitem").select(F.concat_ws("|", "l_returnflag", "l_linestatus", "l_returnflag").alias("flags")), "flags")

    @q("a10_combinations", "SELECT members, count(*) AS n FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS members FROM events GROUP BY 1) GROUP BY 1")
    def _(s, d):
        return A.combinations(ev(s, d), "user_id", "event_type")

    @q("a11_rollup", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type)")
    def _(s, d):
        return ev(s, d).rollup("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))

    @q("a12_provenance", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang IS NULL) AS no_lang FROM documents GROUP BY 1")
    def _(s, d):
        return table(s, d, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "de").alias("de"), F.count_if(F.col("lang").isNull()).alias("no_lang"))

    @q("a13_page_counts", "SELECT page, count(*) AS n FROM (SELECT unnest(page_ids) AS page FROM chunks) GROUP BY 1")
    def _(s, d):
        return table(s, d, "chunks").select(F.explode("page_ids").alias("page")).groupBy("page").agg(F.count("*").alias("n"))

    @q("a14_describe", """SELECT strategy, count(word_count) AS n, avg(word_count) AS mean, stddev_samp(word_count) AS std, min(word_count) AS min, quantile_cont(word_count, 0.25) AS q1, quantile_cont(word_count, 0.5) AS median,
        quantile_cont(word_count, 0.75) AS q3, max(word_count) AS max FROM benchmark_chunks GROUP BY 1""")
    def _(s, d):
        return A.describe(table(s, d, "benchmark_chunks"), ["strategy"], "word_count")

    @q("a15_percentiles", "SELECT quantile_cont(value, [0, 0.05, 0.25, 0.5, 0.75, 0.95, 1]) AS ps FROM events")
    def _(s, d):
        shares = {f"p{i}": float(x) for i, x in enumerate((0, 0.05, 0.25, 0.5, 0.75, 0.95, 1))}
        return A.exact_percentiles(ev(s, d), [], "value", shares).select(F.when(F.col("p0").isNotNull(), F.array(*shares)).alias("ps"))

    @q("a16_cut_buckets", """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN value <= lo THEN 'low' WHEN value >= hi THEN 'high' ELSE 'middle' END AS bucket FROM events, (SELECT quantile_cont(value, 0.15) AS lo, quantile_cont(value, 0.85) AS hi FROM events)) GROUP BY 1""")
    def _(s, d):
        return A.cut_points(ev(s, d), "value", 0.15, 0.85).groupBy("bucket").agg(F.count("*").alias("n"))

    @q("a17_modal_offset", f"""SELECT user_id, arg_min(event_type, (-n, first_seen)) AS mode, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1, 2) GROUP BY 1""")
    def _(s, d):
        return A.modal(ev(s, d), ["user_id"], "event_type", "event_id")

    @q("a18_argmax", "SELECT doc_id, arg_max(ocr_source, (n, ocr_source)) AS best, max(n) AS words FROM (SELECT doc_id, ocr_source, CAST(sum(word_count) AS BIGINT) AS n FROM canonical_pages WHERE ocr_source IS NOT NULL AND word_count IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
    def _(s, d):
        own = table(s, d, "canonical_pages").where("ocr_source IS NOT NULL AND word_count IS NOT NULL").groupBy("doc_id", "ocr_source").agg(F.sum("word_count").alias("n"))
        return own.groupBy("doc_id").agg(F.max_by("ocr_source", F.struct("n", "ocr_source")).alias("best"), F.max("n").alias("words"))

    @q("a19_fused_record", """SELECT doc_id, page_id, count(DISTINCT row_id) AS votes, arg_min(row_id, (coalesce(loaded_at, TIMESTAMP '2999-01-01'), row_id)) AS representative,
        arg_min(ocr_source, (coalesce(loaded_at, TIMESTAMP '2999-01-01'), row_id)) FILTER (ocr_source IS NOT NULL AND ocr_source <> '') AS value,
        list_sort(coalesce(list(DISTINCT ocr_source) FILTER (ocr_source IS NOT NULL), [])) AS alternates FROM canonical_pages GROUP BY 1, 2""")
    def _(s, d):
        return A.fused(table(s, d, "canonical_pages"), ["doc_id", "page_id"], "row_id", F.coalesce("loaded_at", F.lit("2999-01-01 00:00:00").cast("timestamp_ntz")), "ocr_source")

    @q("a20_repeated", "SELECT question, count(DISTINCT query_id) AS places FROM retrieval_queries GROUP BY 1 HAVING count(DISTINCT query_id) > 1")
    def _(s, d):
        return A.repeated_units(table(s, d, "retrieval_queries"), "question", "query_id")

    @q("a21_bootstrap")
    def _(s, d):
        return M.bootstrap_interval(ev(s, d).select("event_id", "value"), "value")

    @q("a22_usage", f"SELECT {DAY} AS day, round(sum(value), 4) AS used FROM events GROUP BY 1")
    def _(s, d):
        return ev(s, d).groupBy(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("day")).agg(F.round(F.sum("value"), 4).alias("used"))

    @q("a23_latency", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1")
    def _(s, d):
        return A.exact_percentiles(ev(s, d), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})

    @q("a25_calibration_error", """SELECT round(sum(n * abs(c - a)) / sum(n), 9) AS ece FROM (SELECT count(*) AS n, avg(score) AS c, avg(CASE WHEN size > 1 THEN 1.0 ELSE 0.0 END) AS a
        FROM (SELECT score, len(page_ids) AS size FROM chunks WHERE score IS NOT NULL AND page_ids IS NOT NULL) GROUP BY least(floor(score * 10), 9))""")
    def _(s, d):
        own = table(s, d, "chunks").where("score IS NOT NULL AND page_ids IS NOT NULL").withColumn("many", F.size("page_ids") > 1)
        return M.calibration_error(own, "score", "many").select(F.round("ece", 9).alias("ece"))

    @q("a25_subgroup_gap", "SELECT round(max(m) - min(m), 6) AS gap FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY 1)")
    def _(s, d):
        return A.subgroup_gap(ev(s, d), "event_type", "value").select(F.round("gap", 6).alias("gap"))

    @q("a26_aggregate", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
    def _(s, d):
        return ev(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
