"""Sources, joins, recovery, unions and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.catalog import Catalog, table
from quireflow.operators import recovery as V
from quireflow.sources import jsonl, markdown
from quireflow.streaming import events as E

LABELLED = "canonical_pages p {} JOIN page_labels l ON p.doc_id = l.doc_id AND p.page_id = l.page_id"


def register(c: Catalog) -> None:
    q = c.query

    def lines(s, d, name, *columns):
        return table(s, d, name).select(F.to_json(F.struct(*columns)).alias("value"))

    @q("s3_markdown_pages")
    def _(s, d):
        own = table(s, d, "canonical_pages").where("text IS NOT NULL")
        marked = F.concat(F.format_string("<!-- book p%d -->", "page_num"), F.col("text"))
        return markdown.page_chunks(own.select(F.concat_ws("-", "doc_id", F.col("row_id").cast("string")).alias("doc_id"), marked.alias("text")))

    @q("s5_canonical_jsonl", "SELECT doc_id, page_id, page_num, text, word_count, char_count, ocr_source FROM canonical_pages WHERE coalesce(page_id, '') <> '' AND trim(coalesce(text, '')) <> ''")
    def _(s, d):
        own = lines(s, d, "canonical_pages", "doc_id", "page_id", "page_num", "text", "word_count", "char_count", "ocr_source")
        extra = s.createDataFrame([("# a comment",), ("",), ("{broken",)], "value string")
        return jsonl.canonical_pages(own.unionByName(extra))

    @q("s7_query_fallbacks", """SELECT query_id, page_ids AS pages, CASE WHEN page_ids IS NULL THEN 'out_of_corpus' WHEN len(page_ids) = 1 THEN 'single_page' ELSE 'multi_page' END AS type
        FROM (SELECT query_id, CASE WHEN len(page_ids) > 0 THEN page_ids END AS page_ids FROM retrieval_queries)""")
    def _(s, d):
        own = table(s, d, "retrieval_queries").select(F.to_json(F.struct("query_id", F.col("page_ids").alias("gold_pages"), F.array().cast("array<string>").alias("page_ids"))).alias("value"))
        return jsonl.retrieval_queries(own).select("query_id", F.col("page_ids").alias("pages"), "type")

    @q("s8_blocks", """SELECT 'p' || lpad(CAST(l_orderkey + 1 AS VARCHAR), CAST(greatest(4, length(CAST(l_orderkey + 1 AS VARCHAR))) AS INT), '0') AS page_id, l_linenumber AS n, least(l_partkey % 80, 90) / 100.0::DOUBLE AS x0, least(l_partkey % 80 + CAST(l_quantity AS BIGINT), 100) / 100.0::DOUBLE AS x1 FROM lineitem""")
    def _(s, d):
        x, w = F.col("l_partkey") % 80, F.col("l_quantity").cast("bigint")
        box = F.array(x.cast("double"), F.lit(0.0), (x + w).cast("double"), F.lit(50.0))
        row = F.struct((F.col("l_orderkey") + 1).cast("string").alias("book_page"), box.alias("bbox"), F.array(*[F.lit(v) for v in (0.0, 0.0, 100.0, 100.0)]).alias("page_box"), F.col("l_linenumber").cast("string").alias("content"))
        return jsonl.blocks(table(s, d, "lineitem").select(F.to_json(row).alias("value"))).select("page_id", F.col("content").cast("int").alias("n"), "x0", "x1")

    @q("s12_page_texts", "SELECT doc_id, page_id, string_agg(text, chr(10) ORDER BY page_num, row_id) AS text FROM canonical_pages WHERE coalesce(text, '') <> '' GROUP BY 1, 2")
    def _(s, d):
        own = table(s, d, "canonical_pages").where("coalesce(text, '') <> ''")
        listed = F.sort_array(F.collect_list(F.struct("page_num", "row_id", "text")))
        return own.groupBy("doc_id", "page_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"))

    @q("s14_unique_labels", "SELECT doc_id, text FROM doc_labels")
    def _(s, d):
        return jsonl.unique_or_raise(table(s, d, "doc_labels").select("doc_id", "text"), "doc_id")

    @q("s17_ordered_regions", "SELECT o_orderkey, l_linenumber FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F' JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'")
    def _(s, d):
        kept = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
        return table(s, d, "lineitem").where("l_returnflag <> 'R'").join(kept, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")

    @q("j1_completeness", "SELECT l.doc_id, l.page_id FROM page_labels l ANTI JOIN canonical_pages p ON p.doc_id = l.doc_id AND p.page_id = l.page_id")
    def _(s, d):
        return V.pending(table(s, d, "page_labels").select("doc_id", "page_id"), table(s, d, "canonical_pages"), ["doc_id", "page_id"])

    @q("j2_missing_as_empty", f"SELECT p.row_id, coalesce(l.text, '') AS gold FROM {LABELLED.format('LEFT')}")
    def _(s, d):
        labels = table(s, d, "page_labels").select("doc_id", "page_id", F.col("text").alias("gold"))
        return table(s, d, "canonical_pages").join(labels, ["doc_id", "page_id"], "left").select("row_id", F.coalesce("gold", F.lit("")).alias("gold"))

    @q("j13_modes_side_by_side", "SELECT doc_id, page_id, max(CASE WHEN ocr_source = 'chandra' THEN word_count END) AS chandra, max(CASE WHEN ocr_source = 'qwen' THEN word_count END) AS qwen FROM canonical_pages GROUP BY 1, 2")
    def _(s, d):
        return table(s, d, "canonical_pages").groupBy("doc_id", "page_id").pivot("ocr_source", ["chandra", "qwen"]).agg(F.max("word_count"))

    @q("j14_route", "SELECT row_id FROM chunks WHERE coalesce(score, 0.0) <= 0.5")
    def _(s, d):
        return table(s, d, "chunks").where(F.coalesce("score", F.lit(0.0)) <= 0.5).select("row_id")

    @q("d1_last_wins", "SELECT doc_id, page_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY loaded_at DESC, row_id DESC) AS p FROM canonical_pages) WHERE p = 1")
    def _(s, d):
        return V.last_wins(table(s, d, "canonical_pages"), ["doc_id", "page_id"], [F.col("loaded_at"), F.col("row_id")]).select("doc_id", "page_id", "row_id")

    @q("r1_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_labels)")
    def _(s, d):
        return V.pending(table(s, d, "documents").select("doc_id"), table(s, d, "doc_labels"), ["doc_id"])

    @q("r2_complete_parents", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity > 0) AS ok FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) = 1 + o_orderkey % 7 AND coalesce(ok, 0) = 1 + o_orderkey % 7")
    def _(s, d):
        parents = table(s, d, "orders").select("o_orderkey").withColumn("expected", 1 + F.col("o_orderkey") % 7)
        children = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
        return V.complete_parents(parents, children, "o_orderkey", "expected", F.col("l_quantity") > 0).select("o_orderkey")

    @q("u1_union", "SELECT 'page' AS kind, row_id, page_id, NULL::DOUBLE AS score FROM canonical_pages UNION ALL SELECT 'chunk', row_id, NULL, score FROM chunks")
    def _(s, d):
        pages = table(s, d, "canonical_pages").select(F.lit("page").alias("kind"), "row_id", "page_id")
        return pages.unionByName(table(s, d, "chunks").select(F.lit("chunk").alias("kind"), "row_id", "score"), allowMissingColumns=True)

    @q("u2_set_operations", "SELECT 'both' AS side, count(*) AS n FROM (SELECT doc_id FROM canonical_pages INTERSECT SELECT doc_id FROM chunks) UNION ALL SELECT 'pages', count(*) FROM (SELECT doc_id FROM canonical_pages EXCEPT SELECT doc_id FROM chunks)")
    def _(s, d):
        a, b = table(s, d, "canonical_pages").select("doc_id"), table(s, d, "chunks").select("doc_id")
        return a.intersect(b).agg(F.lit("both").alias("side"), F.count("*").alias("n")).unionByName(a.subtract(b).agg(F.lit("pages").alias("side"), F.count("*").alias("n")))

    @q("u3_exact_duplicates", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY text) > 1")
    def _(s, d):
        return V.exact_duplicates(table(s, d, "documents"), "doc_id", "text")

    @q("u4_version_hash")
    def _(s, d):
        return V.version_hash(table(s, d, "documents"), ["doc_id", "text", "lang", "source"])

    @q("x1_stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
    def _(s, d):
        return E.run_to_end(E.windowed_counts(E.read_events(s, d))).withColumn("total", F.round("total", 4))

    @q("x2_sessions", """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM
        (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""")
    def _(s, d):
        return E.run_to_end(E.sessions(E.read_events(s, d)))

    @q("x3_deduplicated", "SELECT event_id FROM events GROUP BY 1")
    def _(s, d):
        return E.run_to_end(E.deduplicated(E.read_events(s, d)).select("event_id"), "append")
