"""Transcripts, block files and chunks of books."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.catalog import Catalog, table
from quireflow.functions.text import WS, squeeze
from quireflow.operators import recovery as V
from quireflow.operators import transcripts as X
from quireflow.sources import jsonl

LATEST = "(SELECT * FROM canonical_pages WHERE doc_id IS NOT NULL AND page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) = 1)"
TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(12) || chr(13))"


def latest(s, d):
    own = table(s, d, "canonical_pages").where("doc_id IS NOT NULL AND page_id IS NOT NULL")
    return V.last_wins(own, ["doc_id", "page_id"], [F.col("loaded_at"), F.col("row_id")])


def register(c: Catalog) -> None:
    q = c.query

    @q("s13_stream_pieces", f"SELECT row_id, 'p' || lpad(CAST(row_id % 10000 AS VARCHAR), 4, '0') AS page_id, 3 AS piece_no, 'text' AS modality, {TRIM.format('text')} AS content FROM chunks WHERE {TRIM.format('coalesce(text, chr(32))')} <> ''")
    def _(s, d):
        head = F.format_string("[pcma_p%04d_c3] (text) made for reading\n", F.col("row_id") % 10000)
        own = table(s, d, "chunks").where("text IS NOT NULL").select("row_id", F.concat(head, "text", F.lit("\n"), F.regexp_replace(head, r"\(text\)", "(figure)"), F.lit("a picture")).alias("stream"))
        return own.select("row_id", F.explode(X.stream_pieces(F.col("stream"))).alias("p")).select("row_id", "p.*").where("modality = 'text'")

    @q("t12_merged_pieces", f"SELECT row_id, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS text FROM documents WHERE false UNION ALL SELECT doc_id, trim(regexp_replace(text, '{WS}', ' ', 'g')) FROM documents WHERE text IS NOT NULL AND trim(regexp_replace(text, '{WS}', ' ', 'g')) <> ''".replace("SELECT row_id", "SELECT doc_id", 1))
    def _(s, d):
        # Each text in pieces of 800 characters that share 400 with the piece before.
        own = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", squeeze("text").alias("t")).where("t <> ''")
        steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length("t") - 800) / 400).cast("int")))
        pieces = own.select("doc_id", "t", F.explode(steps).alias("k")).select("doc_id", "k", F.expr("substring(t, k * 400 + 1, 800)").alias("piece"))
        return X.merge_overlapping(pieces, "doc_id", "k", "piece")

    @q("c5_book_chunks")
    def _(s, d):
        kind = F.when(F.col("ocr_source").isNull(), "index").otherwise("prose")
        section = F.concat(F.lit("part "), F.floor(F.col("page_num") / 25))
        return X.book_chunks(latest(s, d).withColumns({"kind": kind, "section": section}), "doc_id", "page_num", "section", "kind", "text")

    @q("c6_long_paragraphs")
    def _(s, d):
        split = F.udf(lambda t: [p for x in X.paragraph_list(t) for p in ([x] if len(x) <= X.MOST else X.split_long(x))], "array<string>", useArrow=True)
        return table(s, d, "canonical_pages").select("row_id", F.posexplode(split("text")).alias("k", "piece"))

    @q("s12_block_texts", f"SELECT page_id, string_agg({TRIM.format('text')}, chr(10) ORDER BY row_id) AS text FROM canonical_pages WHERE {TRIM.format('coalesce(text, chr(32))')} <> '' AND coalesce(page_id, '') <> '' AND coalesce(ocr_source, '') <> 'qwen' GROUP BY 1")
    def _(s, d):
        label = F.when(F.col("ocr_source") == "qwen", "Image").otherwise("text")
        block = F.to_json(F.struct("page_id", F.col("text").alias("content"), label.alias("label")))
        page = F.to_json(F.struct("page_id", "text"))
        own = table(s, d, "canonical_pages")
        return jsonl.page_texts(own.select(F.col("row_id").alias("line_no"), F.when((F.col("row_id") % 2 == 0) & (F.coalesce("ocr_source", F.lit("")) != "qwen"), page).otherwise(block).alias("value")))

    @q("s4_cleaned_pages", f"SELECT 'book' AS doc_id, page_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '{WS}', ' ', 'g')) AS text, CASE WHEN page_id < 'p0050' THEN page_id || '.webp' END AS image FROM canonical_pages WHERE coalesce(page_id, '') <> '' AND trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '{WS}', ' ', 'g')) <> ''")
    def _(s, d):
        own = table(s, d, "canonical_pages")
        images = own.where("page_id < 'p0050'").select("page_id").distinct().withColumn("image", F.concat("page_id", F.lit(".webp")))
        return jsonl.cleaned_pages(own.select(F.to_json(F.struct("page_id", "text")).alias("value")), "book", images)

    @q("s20_cloud_blocks", "SELECT o_orderkey, depth, path, type, text FROM (SELECT o_orderkey, 0 AS depth, [0] AS path, 'page' AS type, o_orderstatus AS text FROM orders UNION ALL SELECT l_orderkey, 1, [0, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1 AS INT)], 'line', l_returnflag FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey)")
    def _(s, d):
        line = F.struct(F.lit("line").alias("type"), F.col("l_returnflag").alias("text"))
        lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("b")))), lambda x: x["b"]).alias("blocks"))
        page = F.struct(F.lit("page").alias("type"), F.col("o_orderstatus").alias("text"), "blocks")
        return jsonl.cloud_blocks(table(s, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.to_json(F.struct(F.array(page).alias("blocks"))).alias("value")), "o_orderkey")

    @q("s18_sniffed", "SELECT * FROM (VALUES ('a.jsonl', 'pages', (SELECT count(*) FROM canonical_pages)), ('b.jsonl', 'queries', (SELECT count(*) FROM retrieval_queries))) t(path, kind, n)")
    def _(s, d):
        pages = table(s, d, "canonical_pages").select(F.lit("a.jsonl").alias("path"), F.to_json(F.struct("page_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("n")), {"ignoreNullFields": "false"}).alias("value"))
        queries = table(s, d, "retrieval_queries").select(F.lit("b.jsonl").alias("path"), F.to_json(F.struct("query_id", "question"), {"ignoreNullFields": "false"}).alias("value"))
        return jsonl.sniffed(pages.unionByName(queries))

    @q("s25_export", "SELECT modality, count(*) AS n, count(text) AS texts, count(page_num) AS numbers FROM (SELECT 'text' AS modality, text, NULL AS page_num FROM chunks UNION ALL SELECT 'figure', NULL, page_num FROM canonical_pages) GROUP BY 1")
    def _(s, d):
        made = X.export_rows(table(s, d, "chunks").select("id", "text"), table(s, d, "canonical_pages").select("page_id", "page_num"))
        return made.groupBy("modality").agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.count("page_num").alias("numbers"))

    @q("d2_without_errors", "SELECT row_id FROM canonical_pages WHERE coalesce(trim(text), '') <> ''")
    def _(s, d):
        return V.without_errors(table(s, d, "canonical_pages").withColumn("error", F.when(F.coalesce(F.btrim("text"), F.lit("")) == "", "empty")), "error").select("row_id")

    @q("r3_first_complete", "SELECT doc_id, page_id, min(row_id) AS row_id FROM (SELECT p.*, n FROM canonical_pages p LEFT JOIN (SELECT doc_id, page_id, count(*) AS n FROM canonical_pages WHERE text IS NOT NULL GROUP BY 1, 2) c ON p.doc_id = c.doc_id AND p.page_id = c.page_id) WHERE coalesce(n, 0) = 1 + row_id % 2 GROUP BY 1, 2")
    def _(s, d):
        own = table(s, d, "canonical_pages")
        return V.first_complete(own.select("doc_id", "page_id", "row_id", (1 + F.col("row_id") % 2).alias("expected")), own.where("text IS NOT NULL"), ["doc_id", "page_id"], "expected", "row_id").select("doc_id", "page_id", "row_id")

    @q("j3_figures_with_pages", f"SELECT c.row_id, x.page_id, p.page_num, p.ocr_source FROM chunks c, unnest(c.page_ids) x(page_id) LEFT JOIN {LATEST} p ON c.doc_id = p.doc_id AND x.page_id = p.page_id")
    def _(s, d):
        own = table(s, d, "chunks").select("row_id", "doc_id", F.explode("page_ids").alias("page_id"))
        return own.join(latest(s, d).select("doc_id", "page_id", "page_num", "ocr_source"), ["doc_id", "page_id"], "left").select("row_id", "page_id", "page_num", "ocr_source")

    @q("j6_chunk_images", "SELECT chunk_id, loaded_at, b.page_id, i.image FROM benchmark_chunks b LEFT JOIN (SELECT page_id, min(page_num) || '.webp' AS image FROM canonical_pages WHERE page_id IS NOT NULL GROUP BY 1) i ON b.page_id = i.page_id")
    def _(s, d):
        images = table(s, d, "canonical_pages").where("page_id IS NOT NULL").groupBy("page_id").agg(F.concat(F.min("page_num").cast("string"), F.lit(".webp")).alias("image"))
        return table(s, d, "benchmark_chunks").select("chunk_id", "loaded_at", "page_id").join(images, "page_id", "left").select("chunk_id", "loaded_at", "page_id", "image")

    @q("j4_page_range", """WITH t AS (SELECT doc_id, page_id, min(text) AS t FROM canonical_pages WHERE doc_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT doc_id, 'p' || lpad(CAST(n AS VARCHAR), 4, '0') AS page_id FROM (SELECT doc_id, unnest(range(1, top + 1)) AS n FROM (SELECT doc_id, max(page_num) AS top FROM canonical_pages WHERE doc_id IS NOT NULL GROUP BY 1)))
        SELECT r.doc_id, r.page_id, CASE WHEN t IS NULL THEN 'missing' WHEN trim(t) = '' THEN 'empty' ELSE 'blocks' END AS ocr_source, coalesce(t, '') AS text FROM r LEFT JOIN t ON r.doc_id = t.doc_id AND r.page_id = t.page_id""")
    def _(s, d):
        own = table(s, d, "canonical_pages").where("doc_id IS NOT NULL")
        tops = own.groupBy("doc_id").agg(F.max("page_num").alias("top"))
        return jsonl.with_page_ranges(own.groupBy("doc_id", "page_id").agg(F.min("text").alias("text")), tops, "doc_id", "top")
