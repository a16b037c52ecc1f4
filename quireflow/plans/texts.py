"""Projections and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.catalog import Catalog, table
from quireflow.functions import text as T

WS = T.WS


def _numeral(n: int) -> str:
    out = ""
    for sign, v in (("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1)):
        while n >= v:
            out, n = out + sign, n - v
    return out


#: SQL map of the numerals up to 200.
ROMANS = "MAP {" + ", ".join(f"'{_numeral(n)}': {n}" for n in range(1, 201)) + "}"


def register(c: Catalog) -> None:
    q = c.query

    @q("t1_markup_strip", f"""SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '{T.IMAGE}', '\\1', 'g'), '{T.TAG}', ' ', 'g'), '{WS}', ' ', 'g')) AS clean
        FROM canonical_pages""")
    def _(s, d):
        return table(s, d, "canonical_pages").select("row_id", T.strip_markup("text").alias("clean"))

    @q("t1_clean_markdown")
    def _(s, d):
        return table(s, d, "canonical_pages").select("row_id", T.clean_markdown("text").alias("clean"))

    @q("t2_images", f"""SELECT row_id, len(regexp_extract_all(text, '{T.IMAGE}')) AS n_images, regexp_extract_all(text, '{T.IMAGE}', 1) AS captions, regexp_extract_all(text, '{T.IMAGE}', 2) AS files
        FROM canonical_pages WHERE regexp_matches(text, '{T.IMAGE}')""")
    def _(s, d):
        own = table(s, d, "canonical_pages").where(F.col("text").rlike(T.IMAGE)).withColumn("i", T.images("text"))
        return own.select("row_id", F.size("i").cast("bigint").alias("n_images"), F.regexp_extract_all("text", F.lit(T.IMAGE), 1).alias("captions"), F.transform("i", lambda x: x["webp"]).alias("files"))

    @q("t3_score_form")
    def _(s, d):
        return table(s, d, "canonical_pages").select("row_id", T.score_form("text").alias("form"))

    @q("t5_ligatures", f"""SELECT doc_id, replace(replace(replace(replace(trim(regexp_replace(text, '{WS}', ' ', 'g')), 'æ', 'ae'), 'œ', 'oe'), 'ﬁ', 'fi'), 'ﬂ', 'fl') AS form FROM documents""")
    def _(s, d):
        return table(s, d, "documents").select("doc_id", T.ligatures("text").alias("form"))

    @q("t6_drop_grounding", """SELECT doc_id, regexp_replace(regexp_replace('<|det|>1 2<|/det|><|ref|>' || text || '<|/ref|>', '(?s)<\\|det\\|>.*?<\\|/det\\|>', '', 'g'), '<\\|/?ref\\|>', '', 'g') AS form FROM documents""")
    def _(s, d):
        marked = F.concat(F.lit("<|det|>1 2<|/det|><|ref|>"), F.col("text"), F.lit("<|/ref|>"))
        return table(s, d, "documents").select("doc_id", T.drop_grounding(marked).alias("form"))

    @q("t7_whitespace", f"SELECT doc_id, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS form FROM documents")
    def _(s, d):
        return table(s, d, "documents").select("doc_id", T.squeeze("text").alias("form"))

    @q("t8_historical")
    def _(s, d):
        return table(s, d, "canonical_pages").select("row_id", T.historical("text").alias("form"))

    @q("t9_string_list", f"SELECT row_id, list_filter(list_transform(page_ids, lambda x: trim(regexp_replace(x, '{WS}', ' ', 'g'))), lambda x: x <> '') AS pages FROM chunks")
    def _(s, d):
        return table(s, d, "chunks").select("row_id", T.string_list("page_ids").alias("pages"))

    @q("t4_category_form")
    def _(s, d):
        return table(s, d, "documents").select("doc_id", T.category_form("text").alias("form"))

    @q("t14_label_number", "SELECT p_partkey, try_cast(list_last(string_split(p_name || ' ' || p_size, ' ')) AS INT) AS number FROM part")
    def _(s, d):
        return table(s, d, "part").select("p_partkey", T.label_number(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("number"))

    @q("t23_is_figure", "SELECT row_id, coalesce(regexp_matches(lower(text), '" + "|".join(T.FIGURE_HINTS) + "'), false) AS is_figure FROM canonical_pages")
    def _(s, d):
        return table(s, d, "canonical_pages").select("row_id", T.is_figure("text").alias("is_figure"))

    @q("u5_size_and_digest", "SELECT doc_id, strlen(text) AS n_bytes, sha256(text) AS digest FROM documents")
    def _(s, d):
        return table(s, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("digest"))

    @q("t10_join_tokens", f"""SELECT row_id, regexp_replace(array_to_string(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}} \\t\\r\\n]'), '  '), '  ([.,;:!?)\\]}}%…])', '\\1', 'g') AS joined
        FROM chunks WHERE text IS NOT NULL""".replace("'  '", "' '").replace("'  (", "' ("))
    def _(s, d):
        tokens = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\r\n]"), 0)
        return table(s, d, "chunks").where("text IS NOT NULL").select("row_id", T.join_tokens(tokens).alias("joined"))

    @q("t11_json_object", """SELECT row_id, '{"row_id":' || row_id || CASE WHEN doc_id IS NOT NULL THEN ',"doc_id":"' || doc_id || '"' ELSE '' END || '}' AS found FROM chunks""")
    def _(s, d):
        made = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct("row_id", "doc_id")), F.lit("\n```"))
        return table(s, d, "chunks").select("row_id", T.json_object(made).alias("found"))

    @q("t13_latin_share", """SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) / greatest(1, len(regexp_extract_all(text, '\\p{L}'))) AS share,
        len(regexp_extract_all(text, '[A-Za-z]')) / greatest(1, len(regexp_extract_all(text, '\\p{L}'))) < 0.8 AS suspicious FROM documents WHERE text IS NOT NULL""")
    def _(s, d):
        return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", T.latin_share("text").alias("share"), (T.latin_share("text") < 0.8).alias("suspicious"))

    @q("t14_figure_number", r"""SELECT row_id, n AS figure, n BETWEEN 1 AND 289 AS plausible FROM (SELECT row_id, try_cast(nullif(regexp_extract(text, '(?i)\bF[i1l]g[.,]?\s*(\d{1,4})', 1), '') AS INT) AS n FROM canonical_pages) WHERE n IS NOT NULL""")
    def _(s, d):
        return table(s, d, "canonical_pages").select("row_id", T.figure_number("text").alias("figure")).where("figure IS NOT NULL").withColumn("plausible", F.col("figure").between(1, 289))

    @q("t15_caption", r"""SELECT row_id, 'Fig. ' || regexp_extract(line, '(?i)F[i1l]g[.,]?\s*(\d{1,4})', 1) AS label, trim(regexp_replace(line, '(?i)^F[i1l]g[.,]?\s*\d{1,4}[.,]?', '')) AS caption
        FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM canonical_pages) WHERE regexp_matches(line, '(?i)^F[i1l]g[.,]?\s*\d{1,4}\b')""")
    def _(s, d):
        lines = table(s, d, "canonical_pages").select("row_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"(?i)^F[i1l]g[.,]?\s*\d{1,4}\b"))
        label = F.concat(F.lit("Fig. "), F.regexp_extract("line", r"(?i)F[i1l]g[.,]?\s*(\d{1,4})", 1))
        return lines.select("row_id", label.alias("label"), F.btrim(F.regexp_replace("line", r"(?i)^F[i1l]g[.,]?\s*\d{1,4}[.,]?", "")).alias("caption"))

    @q("t19_guess_numbers", f"""SELECT row_id, list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(list_concat(lines[1:3], lines[-3:]), lambda x: string_split(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '))),
        lambda w: CASE WHEN regexp_full_match(w, '[0-9]{{1,4}}') THEN try_cast(w AS INT) ELSE {ROMANS}[lower(w)] END), lambda n: n IS NOT NULL))) AS numbers
        FROM (SELECT row_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM canonical_pages WHERE text IS NOT NULL)""")
    def _(s, d):
        return table(s, d, "canonical_pages").where("text IS NOT NULL").select("row_id", T.guess_numbers("text").alias("numbers"))

    @q("t19_roman_numbers", f"""SELECT row_id, "at", numeral, {ROMANS}[lower(numeral)] AS value FROM (SELECT row_id, CAST(unnest(range(len(l))) AS INT) AS "at", trim(unnest(l)) AS numeral FROM (SELECT row_id, string_split(text, chr(10)) AS l FROM canonical_pages WHERE text IS NOT NULL))
        WHERE {ROMANS}[lower(numeral)] IS NOT NULL""")
    def _(s, d):
        lines = table(s, d, "canonical_pages").select("row_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        own = lines.withColumn("numeral", F.btrim("line")).where(F.col("numeral").rlike("^(?i)[ivxlc]{1,8}$"))
        return own.select("row_id", "at", "numeral", T.roman("numeral").alias("value")).where("value <= 200")

    @q("t20_prefix", "SELECT query_id, 'query: ' || question AS prompt FROM retrieval_queries")
    def _(s, d):
        return table(s, d, "retrieval_queries").select("query_id", F.concat(F.lit("query: "), "question").alias("prompt"))

    @q("t21_retrieval_text", "SELECT query_id, concat_ws(chr(10), nullif(region, ''), nullif(category, ''), question) AS body FROM retrieval_queries")
    def _(s, d):
        return table(s, d, "retrieval_queries").select("query_id", F.concat_ws("\n", F.nullif("region", F.lit("")), F.nullif("category", F.lit("")), "question").alias("body"))

    labels = [*T.REGION_KINDS, "Unknown", "TITLE"]
    named = "[" + ", ".join(f"'{x}'" for x in labels) + "]"
    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.REGION_KINDS.items())

    @q("t22_region_kind", f"SELECT label, kind, count(*) AS n FROM (SELECT label, CASE lower(label) {kinds} ELSE 'text' END AS kind FROM (SELECT {named}[CAST(l_partkey % {len(labels)} AS INT) + 1] AS label FROM lineitem)) GROUP BY 1, 2")
    def _(s, d):
        label = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("l_partkey") % len(labels)).cast("int") + 1)
        own = table(s, d, "lineitem").select(label.alias("label"))
        return own.groupBy("label", T.region_kind("label").alias("kind")).agg(F.count("*").alias("n"))

    @q("t24_bucket", """SELECT row_id, CASE WHEN coalesce(char_count, 0) = 0 THEN 'blank' WHEN word_count < 100 THEN 'sparse' WHEN word_count > 400 THEN 'dense' ELSE 'plain' END AS bucket FROM canonical_pages""")
    def _(s, d):
        bucket = F.when(F.coalesce("char_count", F.lit(0)) == 0, "blank").when(F.col("word_count") < 100, "sparse").when(F.col("word_count") > 400, "dense").otherwise("plain")
        return table(s, d, "canonical_pages").select("row_id", bucket.alias("bucket"))

    @q("t25_redact", "SELECT doc_id, " + "regexp_replace(" * 2 + "text, '" + T.PERSONAL["EMAIL"] + "', '[EMAIL]', 'g'), '" + T.PERSONAL["PHONE"] + "', '[PHONE]', 'g') AS redacted FROM documents")
    def _(s, d):
        return table(s, d, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))

    @q("t25_spans", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value, true AS stands_there FROM documents WHERE text IS NOT NULL" for k, p in T.PERSONAL.items()))
    def _(s, d):
        own = table(s, d, "documents").where("text IS NOT NULL")
        parts = [own.select("doc_id", "text", F.lit(k).alias("kind"), F.explode(T.personal_spans("text", k)).alias("s")) for k in T.PERSONAL]
        there = F.expr("substring(text, s.start + 1, s.end - s.start) = s.value")
        return parts[0].unionByName(parts[1]).select("doc_id", "kind", "s.value", there.alias("stands_there"))
