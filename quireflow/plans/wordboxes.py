"""Words and detections by page, over words and boxes derived from lineitem: an order is a page, a line a word."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.catalog import Catalog, table
from quireflow.operators import wordboxes as B
from quireflow.plans.boxes import BOXES, boxes
from quireflow.sources import jsonl

# Lines that repeat a number of their order are one word: the least part and supplier.
LINES = "(SELECT l_orderkey AS page, l_linenumber AS idx, min(l_partkey * 1000000 + l_suppkey) // 1000000 AS p, min(l_partkey * 1000000 + l_suppkey) % 1000000 AS s FROM lineitem GROUP BY 1, 2)"
WORDS = f"""(SELECT page, idx, CASE p % 4 WHEN 0 THEN 'Fig.' WHEN 1 THEN CAST(s % 320 AS VARCHAR) || ',' WHEN 2 THEN '-' ELSE 'F1g. ' || CAST(s % 320 AS VARCHAR) END AS text,
    CAST(p % 80 AS BIGINT) * 10 AS x0, CAST(s % 9 AS BIGINT) * 4 AS y0, CAST(p % 80 AS BIGINT) * 10 + 9 AS x1, CAST(s % 9 AS BIGINT) * 4 + 3 AS y1 FROM {LINES})"""
ORDERED = f"""(WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, idx) AS n FROM {WORDS}),
    r AS (SELECT page, idx, x0, n, y0 AS anchor, 0 AS line FROM w WHERE n = 1 UNION ALL
    SELECT w.page, w.idx, w.x0, w.n, CASE WHEN w.y0 - r.anchor > 5 THEN w.y0 ELSE r.anchor END, r.line + CASE WHEN w.y0 - r.anchor > 5 THEN 1 ELSE 0 END FROM r JOIN w ON w.page = r.page AND w.n = r.n + 1)
    SELECT page, idx, line, CAST(row_number() OVER (PARTITION BY page, line ORDER BY x0, idx) - 1 AS INT) AS place FROM r)"""


def words(s, d):
    least = F.min(F.col("l_partkey") * 1_000_000 + F.col("l_suppkey"))
    own = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx")).agg(least.alias("k"))
    p, n = F.floor(F.col("k") / 1_000_000), F.col("k") % 1_000_000
    number = (n % 320).cast("string")
    text = F.when(p % 4 == 0, "Fig.").when(p % 4 == 1, F.concat(number, F.lit(","))).when(p % 4 == 2, "-").otherwise(F.concat(F.lit("F1g. "), number))
    x0, y0 = p % 80 * 10, n % 9 * 4
    return own.select("page", "idx", text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 9).alias("x1"), (y0 + 3).alias("y1"))


def register(c: Catalog) -> None:
    q = c.query

    @q("t17_reading_order", f"SELECT page, idx, CAST(line AS INT) AS line, place FROM {ORDERED}")
    def _(s, d):
        return B.reading_order(words(s, d), 5)

    @q("t16_figure_labels", f"""WITH o AS (SELECT w.*, row_number() OVER (PARTITION BY w.page ORDER BY r.line, r.place) AS n FROM {ORDERED} r JOIN {WORDS} w ON r.page = w.page AND r.idx = w.idx),
        f AS (SELECT a.*, (SELECT min(b.n) FROM o b WHERE b.page = a.page AND b.n BETWEEN a.n + 1 AND a.n + 3 AND b.text <> '-') AS m FROM o a WHERE a.text LIKE 'F%')
        SELECT page, number, x0, y0, x1, y1 FROM (SELECT a.page, try_cast(replace(regexp_extract(CASE WHEN a.text = 'Fig.' THEN b.text ELSE a.text END, CASE WHEN a.text = 'Fig.' THEN '^([0-9]+),$' ELSE '([0-9]+)$' END, 1), ',', '') AS INT) AS number,
        CASE WHEN a.text = 'Fig.' THEN least(a.x0, b.x0) ELSE a.x0 END AS x0, CASE WHEN a.text = 'Fig.' THEN least(a.y0, b.y0) ELSE a.y0 END AS y0,
        CASE WHEN a.text = 'Fig.' THEN greatest(a.x1, b.x1) ELSE a.x1 END AS x1, CASE WHEN a.text = 'Fig.' THEN greatest(a.y1, b.y1) ELSE a.y1 END AS y1 FROM f a LEFT JOIN o b ON b.page = a.page AND b.n = a.m) WHERE number BETWEEN 1 AND 289""")
    def _(s, d):
        return B.figure_labels(words(s, d), 5)

    @q("t18_furniture", f"""SELECT page, coalesce(nullif(p, ''), (SELECT '')) AS printed_page, head AS running_head FROM (SELECT page, CASE WHEN len(tops) > 0 THEN list_aggregate(list_filter(tops, lambda x: len(x) = list_aggregate(list_transform(tops, lambda y: len(y)), 'max')), 'first') ELSE
        CASE WHEN len(bottoms) > 0 THEN list_aggregate(list_filter(bottoms, lambda x: len(x) = list_aggregate(list_transform(bottoms, lambda y: len(y)), 'max')), 'first') ELSE '' END END AS p,
        trim(regexp_replace(regexp_replace(top, '\\b[0-9]{{1,4}}\\b', ' ', 'g'), '[ ]+', ' ', 'g')) AS head FROM
        (SELECT page, top, regexp_extract_all(top, '\\b([0-9]{{1,4}})\\b', 1) AS tops, regexp_extract_all(bottom, '\\b([0-9]{{1,4}})\\b', 1) AS bottoms FROM
        (SELECT page, coalesce(string_agg(text, ' ' ORDER BY idx) FILTER (y0 < 4), '') AS top, coalesce(string_agg(text, ' ' ORDER BY idx) FILTER (y0 >= 4 AND y1 > 32), '') AS bottom FROM {WORDS} GROUP BY 1)))""")
    def _(s, d):
        return B.furniture(words(s, d), 36.0)

    @q("g10_region_texts", f"""SELECT r.page, r.idx AS r_idx, coalesce(string_agg(w.text, ' ' ORDER BY w.idx), '') AS text FROM (SELECT * FROM {WORDS} WHERE text = 'Fig.') r
        LEFT JOIN {WORDS} w ON w.page = r.page AND (w.x0 + w.x1) / 2.0::DOUBLE BETWEEN r.x0 - 200 AND r.x1 + 200 AND (w.y0 + w.y1) / 2.0::DOUBLE BETWEEN r.y0 - 8 AND r.y1 + 8 GROUP BY 1, 2""")
    def _(s, d):
        own = words(s, d)
        regions = own.where("text = 'Fig.'").withColumns({"x0": F.col("x0") - 200, "x1": F.col("x1") + 200, "y0": F.col("y0") - 8, "y1": F.col("y1") + 8})
        return B.region_texts(own, regions)

    @q("g8_exclusive_captions")
    def _(s, d):
        own = boxes(s, d)
        return B.bind_captions(own.where("flag = 'R'"), own.where("flag <> 'R'"), 200)

    @q("g6_without_figures")
    def _(s, d):
        own = boxes(s, d)
        return B.without_figures(own.where("flag <> 'R'"), own.where("flag = 'R'"))

    @q("a6_detection_scores")
    def _(s, d):
        own = boxes(s, d)
        return B.detection_scores(own.where("flag = 'N'"), own.where("flag <> 'N'"), 0.2)

    @q("a6_page_presence", """SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (t AND NOT f) AS fn
        FROM (SELECT l_orderkey, bool_or(l_returnflag = 'N') AS f, bool_or(l_returnflag = 'R') AS t FROM lineitem GROUP BY 1))""")
    def _(s, d):
        own = boxes(s, d)
        return B.page_presence(own.where("flag = 'N'"), own.where("flag = 'R'"))

    @q("s10_reference_words", "SELECT 'p' || l_orderkey AS page_id, CAST(l_linenumber AS VARCHAR) AS text, l_discount * 9 AS x0, l_tax AS y0, l_tax * 12 + 0.1 AS x1, l_discount * 8 + 0.2 AS y1 FROM lineitem WHERE l_discount * 9 < l_tax * 12 + 0.1 AND l_tax * 12 + 0.1 <= 1 AND l_tax < l_discount * 8 + 0.2")
    def _(s, d):
        box = F.array(F.col("l_discount") * 9, F.col("l_tax"), F.col("l_tax") * 12 + 0.1, F.col("l_discount") * 8 + 0.2)
        row = F.struct(F.concat(F.lit("p"), "l_orderkey").alias("page_id"), F.col("l_linenumber").cast("string").alias("text"), box.alias("bbox_norm"))
        return jsonl.reference_words(table(s, d, "lineitem").select(F.to_json(row).alias("value")))

    @q("s15_reference_figures", """SELECT 'p' || lpad(CAST(l_orderkey + 1 AS VARCHAR), CAST(greatest(4, length(CAST(l_orderkey + 1 AS VARCHAR))) AS INT), '0') AS page_id, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 0) AS figures FROM lineitem GROUP BY 1""")
    def _(s, d):
        box = F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.lit(50.0))
        label = F.when(F.col("l_returnflag") == "R", "Figure").otherwise("text")
        row = F.struct((F.col("l_orderkey") + 1).cast("string").alias("book_page"), box.alias("bbox"), F.array(*[F.lit(v) for v in (0.0, 0.0, 100.0, 100.0)]).alias("page_box"), label.alias("label"))
        figures, pages = jsonl.reference_figures(jsonl.blocks(table(s, d, "lineitem").select(F.to_json(row).alias("value"))))
        return pages.join(figures.groupBy("page_id").agg(F.count("*").alias("n")), "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("figures"))

    @q("s16_detector_runs", "SELECT l_returnflag AS detector, l_orderkey AS page, l_quantity AS score FROM lineitem WHERE l_linestatus = 'F'")
    def _(s, d):
        own = table(s, d, "lineitem")
        row = F.when(F.col("l_linestatus") == "F", F.to_json(F.struct(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("score")))).otherwise("")
        return jsonl.detector_runs(own.select(F.concat(F.lit("file:///runs/"), "l_returnflag", F.lit(".jsonl")).alias("path"), row.alias("value")), "page bigint, score double")

    @q("s17_region_places", """SELECT page, idx, x0, y0, place FROM (SELECT page, idx, least(x0 / 700.0::DOUBLE, 1.0) AS x0, least(y0 / 800.0::DOUBLE, 1.0) AS y0, CAST(row_number() OVER (PARTITION BY page ORDER BY least(y0 / 800.0::DOUBLE, 1.0), least(x0 / 700.0::DOUBLE, 1.0), least(y1 / 800.0::DOUBLE, 1.0), least(x1 / 700.0::DOUBLE, 1.0), idx) AS INT) AS place
        FROM """ + BOXES + """ SEMI JOIN orders ON page = o_orderkey AND o_orderstatus = 'F' WHERE flag <> 'R')""")
    def _(s, d):
        own = boxes(s, d).withColumns({c: F.col(c) / (700.0 if c[0] == "x" else 800.0) for c in ("x0", "y0", "x1", "y1")}).withColumn("is_figure", F.col("flag") == "R")
        pages = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page"))
        return jsonl.ordered_regions(own, pages).select("page", "idx", "x0", "y0", "place")
