"""Chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.catalog import Catalog, table
from quireflow.functions.text import WS
from quireflow.operators import chunking as C
from quireflow.operators import windows as W

WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{WS}'), lambda x: x <> '')"


def _sql(size: int, overlap: int, early: bool = True) -> str:
    step = size - overlap
    last = f"greatest(0, CAST(ceil((len(w) - {size}) / {step}) AS BIGINT))" if early else f"CAST(ceil(len(w) / {step}) AS BIGINT) - 1"
    return f"""SELECT row_id, ordinal, array_to_string(w[ordinal * {step} + 1 : ordinal * {step} + {size}], ' ') AS text, CAST(len(w[ordinal * {step} + 1 : ordinal * {step} + {size}]) AS INT) AS word_count
    FROM (SELECT row_id, w, unnest(range(0, {last} + 1)) AS ordinal FROM (SELECT row_id, {WORDS} AS w FROM canonical_pages) WHERE len(w) > 0)"""


def register(c: Catalog) -> None:
    q = c.query
    pages = lambda s, d: table(s, d, "canonical_pages")

    @q("c1_split", f"SELECT *, row_id || '-c' || lpad(CAST(ordinal AS VARCHAR), 4, '0') AS chunk_id FROM ({_sql(128, 16)})")
    def _(s, d):
        return C.fixed_windows(pages(s, d), ["row_id"], "text").withColumn("chunk_id", F.format_string("%d-c%04d", "row_id", "ordinal"))

    @q("c2_fixed_256", _sql(256, 32))
    def _(s, d):
        return C.fixed_windows(pages(s, d), ["row_id"], "text", 256, 32)

    @q("c2_full_tail", _sql(256, 32, False))
    def _(s, d):
        return C.fixed_windows(pages(s, d), ["row_id"], "text", 256, 32, early_stop=False)

    @q("c2_global_ids", f"""SELECT row_id, ordinal, row_number() OVER (ORDER BY row_id, ordinal) - 1 AS global_no FROM ({_sql(256, 32)})""")
    def _(s, d):
        chunks = C.fixed_windows(pages(s, d), ["row_id"], "text", 256, 32)
        counts = W.running_offsets(chunks.groupBy("row_id").agg(F.count("*").alias("n")), ["row_id"], "n")
        return chunks.join(counts, "row_id").select("row_id", "ordinal", (F.col("offset") + F.col("ordinal")).alias("global_no"))

    @q("c3_parent_child", f"""SELECT row_id, parent_no, ordinal AS child_no, array_to_string(w[ordinal * 112 + 1 : ordinal * 112 + 128], ' ') AS text, CAST(len(w[ordinal * 112 + 1 : ordinal * 112 + 128]) AS INT) AS word_count
        FROM (SELECT row_id, parent_no, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - 128) / 112) AS BIGINT)) + 1)) AS ordinal FROM
        (SELECT row_id, p AS parent_no, all_w[p * 512 + 1 : p * 512 + 512] AS w FROM (SELECT row_id, all_w, unnest(range(0, greatest(0, CAST(ceil((len(all_w) - 512) / 512) AS BIGINT)) + 1)) AS p
        FROM (SELECT row_id, {WORDS} AS all_w FROM canonical_pages) WHERE len(all_w) > 0)))""")
    def _(s, d):
        return C.parent_child(pages(s, d), ["row_id"], "text").drop("parent_text")

    @q("c3_overlapping_parents", f"""SELECT row_id, parent_no, ordinal AS child_no, array_to_string(w[ordinal * 112 + 1 : ordinal * 112 + 128], ' ') AS text, CAST(len(w[ordinal * 112 + 1 : ordinal * 112 + 128]) AS INT) AS word_count
        FROM (SELECT row_id, parent_no, w, unnest(range(0, CAST(ceil(len(w) / 112) AS BIGINT))) AS ordinal FROM
        (SELECT row_id, p AS parent_no, all_w[p * 448 + 1 : p * 448 + 512] AS w FROM (SELECT row_id, all_w, unnest(range(0, CAST(ceil(len(all_w) / 448) AS BIGINT))) AS p
        FROM (SELECT row_id, {WORDS} AS all_w FROM canonical_pages) WHERE len(all_w) > 0)))""")
    def _(s, d):
        return C.parent_child(pages(s, d), ["row_id"], "text", parent_overlap=64, early_stop=False).drop("parent_text")

    @q("c4_paragraph_pack")
    def _(s, d):
        return C.pack_paragraphs(pages(s, d), ["row_id", "page_id"], "text", 300, F.concat(F.lit("Page "), "page_id"))

    @q("c4_headers_kept")
    def _(s, d):
        return C.pack_paragraphs(pages(s, d), ["row_id"], "text", 300, header_flushes=False, joint="\n\n", header=C.WIDE_HEADER)

    @q("c6_paragraphs", """SELECT row_id, unnest(list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(12) || chr(13))), lambda p: p <> '')) AS paragraph FROM canonical_pages""")
    def _(s, d):
        return pages(s, d).select("row_id", F.explode(C.paragraphs(F.col("text"))).alias("paragraph"))

    @q("c7_suites")
    def _(s, d):
        return C.suites(pages(s, d), ["row_id"], "text").groupBy("strategy").agg(F.count("*").alias("chunks"), F.sum("word_count").alias("words"))
