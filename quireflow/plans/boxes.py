"""Geometry, over boxes derived from lineitem: an order is a page, a line a box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.catalog import Catalog, table
from quireflow.operators import geometry as G

BOXES = """(SELECT l_orderkey AS page, l_linenumber AS idx, l_returnflag AS flag, CAST(l_partkey % 80 AS BIGINT) * 10 AS x0, CAST(l_suppkey % 90 AS BIGINT) * 10 AS y0,
    CAST(l_partkey % 80 AS BIGINT) * 10 + CAST(l_quantity AS BIGINT) * 8 AS x1, CAST(l_suppkey % 90 AS BIGINT) * 10 + CAST(l_quantity AS BIGINT) * 5 AS y1 FROM lineitem)"""
INTER = "(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
AREA = "((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0))"


def boxes(s: SparkSession, d: str) -> DataFrame:
    x0, y0, n = F.col("l_partkey") % 80 * 10, F.col("l_suppkey") % 90 * 10, F.col("l_quantity").cast("bigint")
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("flag"), x0.alias("x0"), y0.alias("y0"), (x0 + n * 8).alias("x1"), (y0 + n * 5).alias("y1"))


def register(c: Catalog) -> None:
    q = c.query

    @q("g1_iou_pairs", f"""SELECT a.page, a.idx AS a_idx, b.idx AS b_idx, {INTER} / ({AREA} - {INTER}) AS iou FROM {BOXES} a JOIN {BOXES} b ON a.page = b.page AND a.idx < b.idx WHERE {INTER} / ({AREA} - {INTER}) >= 0.1""")
    def _(s, d):
        return G.overlapping_pairs(boxes(s, d), 0.1).select("page", "a_idx", "b_idx", "iou")

    @q("g2_clamp_normalize", f"""SELECT page, idx, least(x0, 800) / 800.0::DOUBLE AS x0, least(y0, 900) / 900.0::DOUBLE AS y0, least(x1, 800) / 800.0::DOUBLE AS x1, least(y1, 900) / 900.0::DOUBLE AS y1 FROM {BOXES}""")
    def _(s, d):
        held = boxes(s, d).select("page", "idx", *G.clamp(F.lit(800), F.lit(900)))
        return held.select("page", "idx", *G.normalize(F.lit(800.0), F.lit(900.0)))

    @q("g3_pixels", f"""SELECT page, idx, greatest(0, least(CAST(floor(x0 / 1600.0::DOUBLE * 600) AS BIGINT), 599)) AS x0, greatest(0, least(CAST(floor(y0 / 1600.0::DOUBLE * 700) AS BIGINT), 699)) AS y0,
        greatest(greatest(0, least(CAST(floor(x0 / 1600.0::DOUBLE * 600) AS BIGINT), 599)) + 1, least(CAST(ceil(x1 / 1600.0::DOUBLE * 600) AS BIGINT), 600)) AS x1,
        greatest(greatest(0, least(CAST(floor(y0 / 1600.0::DOUBLE * 700) AS BIGINT), 699)) + 1, least(CAST(ceil(y1 / 1600.0::DOUBLE * 700) AS BIGINT), 700)) AS y1 FROM {BOXES}""")
    def _(s, d):
        shares = boxes(s, d).select("page", "idx", *G.normalize(F.lit(1600.0), F.lit(1600.0)))
        return shares.select("page", "idx", *G.to_pixels(F.lit(600), F.lit(700)))

    @q("g5_merge_boxes")
    def _(s, d):
        return G.merge_boxes(boxes(s, d), 5)

    @q("g6_subtract", f"""SELECT a.page, a.idx AS a_idx, b.idx AS b_idx, CASE WHEN {INTER} > 0 THEN (a.x1 - a.x0) * (a.y1 - a.y0) - {INTER} ELSE (a.x1 - a.x0) * (a.y1 - a.y0) END AS area_left
        FROM {BOXES} a JOIN {BOXES} b ON a.page = b.page AND a.flag <> 'R' AND b.flag = 'R'""")
    def _(s, d):
        own = boxes(s, d)
        pairs = G.prefixed(own.where("flag <> 'R'"), "a_").join(G.prefixed(own.where("flag = 'R'"), "b_"), "page").withColumn("rest", G.subtract())
        left = F.aggregate("rest", F.lit(0).cast("bigint"), lambda a, r: a + (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]))
        return pairs.select("page", "a_idx", "b_idx", left.alias("area_left"))

    @q("g7_nearest_band", f"""SELECT page, f_idx, c_idx, gap FROM (SELECT *, row_number() OVER (PARTITION BY page, f_idx ORDER BY gap, c_idx) AS p FROM
        (SELECT f.page, f.idx AS f_idx, c.idx AS c_idx, CASE WHEN c.y0 >= f.y1 THEN c.y0 - f.y1 ELSE f.y0 - c.y1 END AS gap FROM {BOXES} f JOIN {BOXES} c ON f.page = c.page AND f.flag = 'R' AND c.flag <> 'R'
        AND least(f.x1, c.x1) - greatest(f.x0, c.x0) > 0) WHERE gap >= 0 AND gap < 200) WHERE p = 1""")
    def _(s, d):
        own = boxes(s, d)
        return G.nearest_band(own.where("flag = 'R'"), own.where("flag <> 'R'"), 200)

    @q("g9_smallest_region", f"""SELECT page, p_idx, r_idx FROM (SELECT p.page, p.idx AS p_idx, r.idx AS r_idx, row_number() OVER (PARTITION BY p.page, p.idx ORDER BY (r.x1 - r.x0) * (r.y1 - r.y0), r.idx) AS k
        FROM (SELECT page, idx, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy FROM {BOXES} WHERE flag <> 'R') p JOIN {BOXES} r ON p.page = r.page AND r.flag = 'R' AND cx BETWEEN r.x0 AND r.x1 AND cy BETWEEN r.y0 AND r.y1) WHERE k = 1""")
    def _(s, d):
        own = boxes(s, d)
        points = own.where("flag <> 'R'").select("page", "idx", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
        return G.smallest_containing(points, own.where("flag = 'R'"))

    @q("g11_clusters")
    def _(s, d):
        return G.clusters(boxes(s, d), 0.2)

    @q("g12_greedy_match")
    def _(s, d):
        own = boxes(s, d)
        return G.match_boxes(own.where("flag = 'N'"), own.where("flag <> 'N'"), 0.2)

    @q("g13_first_fit_match")
    def _(s, d):
        own = boxes(s, d)
        return G.match_boxes(own.where("flag = 'N'"), own.where("flag <> 'N'"), 0.2, first_fit=True)
