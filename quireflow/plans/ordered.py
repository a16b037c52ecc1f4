"""Windows, sorts, samples and limits that are the feature."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.catalog import Catalog, table
from quireflow.operators import windows as W


def register(c: Catalog) -> None:
    q = c.query
    ev = lambda s, d: table(s, d, "events")

    @q("w1_rank_in_group", "SELECT * FROM (SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS rank FROM events) WHERE rank <= 3")
    def _(s, d):
        return W.top_k(ev(s, d).select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 3)

    @q("w2_order_keeping_distinct", "SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_at) AS INT) AS place FROM (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY 1, 2)")
    def _(s, d):
        own = ev(s, d).groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_at"))
        return own.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("first_at")).alias("place"))

    @q("w3_sequence", "SELECT row_id, doc_id || ':r' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_num, row_id) AS VARCHAR), 4, '0') AS seq FROM canonical_pages")
    def _(s, d):
        own = table(s, d, "canonical_pages").select("row_id", "doc_id", "page_num")
        return W.sequence(own, "doc_id", ["page_num", "row_id"]).select("row_id", F.format_string("%s:r%04d", "doc_id", "seq").alias("seq"))

    @q("w5_look_ahead", "SELECT event_id, lead(event_type, 1) OVER w AS next_1, lead(event_type, 2) OVER w AS next_2, lead(event_type, 3) OVER w AS next_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
    def _(s, d):
        return W.look_ahead(ev(s, d), "user_id", ["ts", "event_id"], 3, "event_type").select("event_id", "next_1", "next_2", "next_3")

    @q("w6_runs", """SELECT event_id, CAST(sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS changed FROM events)""")
    def _(s, d):
        return W.runs(ev(s, d), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "run")

    @q("w7_islands", """SELECT l_orderkey, min(a) AS a, max(b) AS b, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY a, b, k) AS island FROM (SELECT *, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh
        FROM (SELECT l_orderkey, l_linenumber AS k, l_partkey AS a, l_partkey + CAST(l_quantity AS BIGINT) * 5 AS b FROM lineitem))) GROUP BY l_orderkey, island""")
    def _(s, d):
        own = table(s, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint") * 5).alias("b"))
        return W.islands(own, ["l_orderkey"], "a", "b")

    @q("w8_lowest_scores", "SELECT row_id, score FROM chunks WHERE score IS NOT NULL ORDER BY score, row_id LIMIT 30")
    def _(s, d):
        return table(s, d, "chunks").where("score IS NOT NULL").select("row_id", "score").orderBy("score", "row_id").limit(30)

    @q("w9_even_sample", "SELECT row_id, doc_id FROM (SELECT row_id, doc_id, row_number() OVER (ORDER BY row_id) - 1 AS n, count(*) OVER () AS total FROM canonical_pages) WHERE total <= 25 OR n IN (SELECT round_even(range * ((SELECT count(*) FROM canonical_pages) - 1) / 24.0::DOUBLE, 0) FROM range(25))")
    def _(s, d):
        return W.even_sample(table(s, d, "canonical_pages").select("row_id", "doc_id"), ["row_id"], 25)

    @q("w10_first_of_stratum", "SELECT row_id, doc_id FROM (SELECT row_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, row_id) AS p FROM canonical_pages) WHERE p <= 5")
    def _(s, d):
        return W.stratified_first(table(s, d, "canonical_pages"), "doc_id", [F.col("page_num"), F.col("row_id")], 5).select("row_id", "doc_id")

    @q("w11_priority_union", """SELECT doc_id, CAST(min(part) AS INT) AS part FROM (SELECT doc_id, 0 AS part FROM doc_labels UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 2 FROM documents) GROUP BY 1""")
    def _(s, d):
        docs = table(s, d, "documents").select("doc_id", "lang")
        return W.priority_union([table(s, d, "doc_labels").select("doc_id"), docs.where("lang = 'de'").select("doc_id"), docs.select("doc_id")], "doc_id")

    @q("w12_reading_order", "SELECT row_id, row_number() OVER (ORDER BY doc_id, page_num, row_id) - 1 AS place FROM canonical_pages")
    def _(s, d):
        own = table(s, d, "canonical_pages").select("row_id", "doc_id", "page_num").withColumn("one", F.lit(1))
        return W.running_offsets(own, ["doc_id", "page_num", "row_id"], "one", "place").select("row_id", "place")

    @q("w13_worst", "SELECT doc_id, arg_max(row_id, (char_count, row_id)) AS worst FROM canonical_pages WHERE char_count IS NOT NULL GROUP BY 1")
    def _(s, d):
        return table(s, d, "canonical_pages").where("char_count IS NOT NULL").groupBy("doc_id").agg(F.max_by("row_id", F.struct("char_count", "row_id")).alias("worst"))

    @q("w14_first_examples", "SELECT user_id, min(event_id) FILTER (value >= 50) AS first_success, min(event_id) FILTER (value < 50) AS first_failure FROM events GROUP BY 1")
    def _(s, d):
        return ev(s, d).groupBy("user_id").agg(F.min(F.when(F.col("value") >= 50, F.col("event_id"))).alias("first_success"), F.min(F.when(F.col("value") < 50, F.col("event_id"))).alias("first_failure"))
