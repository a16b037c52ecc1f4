"""Evaluation metrics. Transcripts are compared with page_labels; retrieval takes the label of a vector as relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.catalog import Catalog, table
from quireflow.functions.text import WS
from quireflow.operators import metrics as M
from quireflow.operators import retrieval as R
from quireflow.plans.search import LEXICAL, LEXICAL_ALL, QUERY_NO, SCORED

FOLD = lambda c: f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"
PAIRS = f"(SELECT p.row_id, {FOLD('p.text')} AS hyp, {FOLD('l.text')} AS ref FROM canonical_pages p JOIN page_labels l ON p.doc_id = l.doc_id AND p.page_id = l.page_id WHERE p.text IS NOT NULL AND l.text IS NOT NULL)"
#: The distance of the SQL engine counts bytes, so each sign of old print beyond ASCII is put as one byte on either side.
SIGNS = "¬\xad°·ſ‐—–’‘“”…æœÆŒéèêﬁﬂﬀﬃﬄﬅﬆ"
BYTES = "||".join(f"chr({i})" for i in [*range(1, 9), 11, 12, *range(14, 31)][: len(SIGNS)])
ONE = lambda c: f"translate({c}, '{SIGNS}', {BYTES})"
WORDS = lambda c: f"list_filter(string_split({c}, ' '), lambda x: x <> '')"
HITS = f"(SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, score FROM {SCORED} WHERE query_id <> item_id)"
NEG = "(SELECT vec_id, embedding[1]::DOUBLE AS score, label >= 7 AS is_negative FROM embeddings)"


def register(c: Catalog) -> None:
    q = c.query

    def fold(name):
        return F.btrim(F.regexp_replace(name, WS, " "))

    def pairs(s, d):
        pages = table(s, d, "canonical_pages").where("text IS NOT NULL").select("row_id", "doc_id", "page_id", fold("text").alias("hyp"))
        labels = table(s, d, "page_labels").where("text IS NOT NULL").select("doc_id", "page_id", fold("text").alias("ref"))
        return pages.join(labels, ["doc_id", "page_id"]).select("row_id", "hyp", "ref")

    @q("e3_char_error", f"SELECT row_id, levenshtein({ONE('hyp')}, {ONE('ref')}) / greatest(1, length(ref)) AS cer FROM {PAIRS}")
    def _(s, d):
        return pairs(s, d).select("row_id", M.char_error(F.col("hyp"), F.col("ref")).alias("cer"))

    @q("e2_word_error")
    def _(s, d):
        return pairs(s, d).withColumn("edits", M.word_edits("hyp", "ref")).select("row_id", "edits", (F.col("edits") / F.greatest(F.lit(1), F.size(F.split("ref", " ")))).alias("wer"))

    @q("a4_micro_macro", f"SELECT avg(e / greatest(1, n)) AS macro, sum(e) / greatest(1, sum(n)) AS micro FROM (SELECT levenshtein({ONE('hyp')}, {ONE('ref')}) AS e, length(ref) AS n FROM {PAIRS})")
    def _(s, d):
        own = pairs(s, d).select(F.levenshtein("hyp", "ref").alias("e"), F.length("ref").alias("n"))
        return own.agg(F.avg(F.col("e") / F.greatest(F.lit(1), F.col("n"))).alias("macro"), (F.sum("e") / F.greatest(F.lit(1), F.sum("n"))).alias("micro"))

    F1 = f"""SELECT p.row_id, CASE WHEN coalesce(nh, 0) + coalesce(nr, 0) = 0 THEN 1.0 WHEN coalesce("both", 0) = 0 THEN 0.0 ELSE 2.0 * "both" / (nh + nr) END::DOUBLE AS word_f1 FROM {PAIRS} p LEFT JOIN
        (SELECT row_id, sum(least(coalesce(h, 0), coalesce(r, 0))) AS "both", sum(coalesce(h, 0)) AS nh, sum(coalesce(r, 0)) AS nr FROM
        (SELECT row_id, w, %s AS h FROM (SELECT row_id, unnest({WORDS('hyp')}) AS w FROM {PAIRS}) GROUP BY 1, 2) FULL JOIN (SELECT row_id, w, %s AS r FROM (SELECT row_id, unnest({WORDS('ref')}) AS w FROM {PAIRS}) GROUP BY 1, 2) USING (row_id, w) GROUP BY 1) x ON p.row_id = x.row_id"""

    @q("e4_word_f1", F1 % ("count(*)", "count(*)"))
    def _(s, d):
        return M.word_f1(pairs(s, d), "row_id", "hyp", "ref")

    @q("e4_word_f1_set", F1 % ("1", "1"))
    def _(s, d):
        return M.word_f1(pairs(s, d), "row_id", "hyp", "ref", multiset=False)

    def hits(s, d):
        own = table(s, d, "embeddings")
        found = R.exact_top_k(own, own.where("vec_id % 50 = 0"), "vec_id", "embedding", skip_self=True)
        return found.join(own.select(F.col("vec_id").alias("item_id"), F.col("label").alias("unit")), "item_id")

    METRICS = f"""WITH hits AS (SELECT h.query_id, e.label AS unit, min(rank) AS best FROM {HITS} h JOIN embeddings e ON e.vec_id = h.item_id WHERE rank <= 10 GROUP BY 1, 2),
        ranked AS (SELECT query_id, unit, row_number() OVER (PARTITION BY query_id ORDER BY best) AS unit_rank FROM hits),
        gold AS (SELECT vec_id AS query_id, label AS unit FROM embeddings WHERE vec_id % 50 = 0),
        own AS (SELECT g.query_id, r.unit_rank FROM gold g LEFT JOIN ranked r ON g.query_id = r.query_id AND g.unit = r.unit)
        SELECT query_id, CAST(coalesce(unit_rank, 99) <= 1 AS INT) AS hit_at_1, CAST(coalesce(unit_rank, 99) <= 5 AS INT) AS hit_at_5, CAST(coalesce(unit_rank, 99) <= 10 AS INT) AS hit_at_10,
        coalesce(CASE WHEN unit_rank <= 10 THEN 1.0 / unit_rank END, 0.0)::DOUBLE AS reciprocal_rank, CASE WHEN coalesce(unit_rank, 99) <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS coverage, CAST(coalesce(unit_rank, 99) <= 10 AS INT) AS all_found FROM own"""

    def metrics(s, d):
        gold = table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("unit"))
        return M.retrieval_metrics(gold, M.first_ranks(hits(s, d), "unit"), "unit")

    @q("e5_retrieval_metrics", METRICS)
    def _(s, d):
        return metrics(s, d)

    @q("a5_metric_means", f"SELECT avg(hit_at_1) AS r1, avg(hit_at_5) AS r5, avg(reciprocal_rank) AS mrr, avg(coverage) AS coverage FROM ({METRICS})")
    def _(s, d):
        return metrics(s, d).agg(F.avg("hit_at_1").alias("r1"), F.avg("hit_at_5").alias("r5"), F.avg("reciprocal_rank").alias("mrr"), F.avg("coverage").alias("coverage"))

    @q("e7_chunk_mrr", f"SELECT h.query_id, coalesce(max(CASE WHEN e.label = g.label THEN 1.0 / rank END), 0.0)::DOUBLE AS reciprocal_rank FROM {HITS} h JOIN embeddings e ON e.vec_id = h.item_id JOIN embeddings g ON g.vec_id = h.query_id WHERE rank <= 10 GROUP BY 1")
    def _(s, d):
        gold = table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold"))
        return hits(s, d).join(gold, "query_id").groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("unit") == F.col("gold"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"))

    GOLD = f"""(SELECT DISTINCT query_id, doc_id || '/' || page_id AS unit FROM (SELECT query_id, doc_id, unnest(page_ids) AS page_id FROM retrieval_queries WHERE {QUERY_NO} % 50 = 0) WHERE doc_id IS NOT NULL)"""
    #: Of all questions.
    ALL_GOLD = GOLD.replace(f" WHERE {QUERY_NO} % 50 = 0", "")
    PAGES = f"""(SELECT query_id, unit, row_number() OVER (PARTITION BY query_id ORDER BY best, spot, unit) AS unit_rank FROM (SELECT query_id, unit, min(rank) AS best, arg_min(spot, (rank, spot)) AS spot FROM
        (SELECT h.query_id, h.rank, c.doc_id || '/' || x.p AS unit, x.i AS spot FROM {LEXICAL_ALL} h JOIN chunks c ON c.row_id = h.item_id AND h.rank <= 10, LATERAL (SELECT unnest(c.page_ids) AS p, unnest(range(len(c.page_ids))) AS i) x WHERE c.doc_id IS NOT NULL) GROUP BY 1, 2))"""

    def numbered(s, d):
        return table(s, d, "retrieval_queries").where(F.regexp_extract("query_id", "([0-9]+)$", 1).cast("bigint") % 50 == 0)

    def page_gold(own):
        return own.where("doc_id IS NOT NULL").select("query_id", F.explode("page_ids").alias("p"), "doc_id").select("query_id", F.concat_ws("/", "doc_id", "p").alias("unit")).distinct()

    def lexical_hits(s, d, asked):
        return R.bm25(table(s, d, "chunks"), asked, "row_id", "text", "query_id", "question")

    def hit_pages(s, d, asked):
        chunks = table(s, d, "chunks").where("doc_id IS NOT NULL").select(F.col("row_id").alias("item_id"), "doc_id", F.posexplode("page_ids").alias("at", "p"))
        return M.first_ranks(lexical_hits(s, d, asked).join(chunks, "item_id").select("query_id", "rank", "at", F.concat_ws("/", "doc_id", "p").alias("unit")), "unit", "at")

    PAGE_METRICS = f"""SELECT g.query_id, CAST(max(coalesce(unit_rank, 99) <= 1) AS INT) AS hit_at_1, CAST(max(coalesce(unit_rank, 99) <= 5) AS INT) AS hit_at_5, CAST(max(coalesce(unit_rank, 99) <= 10) AS INT) AS hit_at_10,
        coalesce(max(CASE WHEN unit_rank <= 10 THEN 1.0 / unit_rank END), 0.0)::DOUBLE AS reciprocal_rank, avg(CASE WHEN coalesce(unit_rank, 99) <= 10 THEN 1.0 ELSE 0.0 END)::DOUBLE AS coverage, CAST(min(coalesce(unit_rank, 99) <= 10) AS INT) AS all_found
        FROM {ALL_GOLD} g LEFT JOIN {PAGES} r ON g.query_id = r.query_id AND g.unit = r.unit GROUP BY 1"""

    @q("e9_page_metrics", PAGE_METRICS)
    def _(s, d):
        asked = table(s, d, "retrieval_queries")
        return M.retrieval_metrics(page_gold(asked), hit_pages(s, d, asked), "unit")

    @q("e6_chunk_hits", f"""SELECT query_id, CAST(max(CASE WHEN rank <= 1 THEN good ELSE 0 END) AS INT) AS hit_at_1, CAST(max(CASE WHEN rank <= 5 THEN good ELSE 0 END) AS INT) AS hit_at_5, CAST(max(good) AS INT) AS hit_at_10 FROM
        (SELECT h.query_id, h.rank, CASE WHEN EXISTS (SELECT 1 FROM {GOLD} g, chunks c WHERE g.query_id = h.query_id AND c.row_id = h.item_id AND list_contains(list_transform(c.page_ids, lambda p: c.doc_id || '/' || p), g.unit)) THEN 1 ELSE 0 END AS good FROM {LEXICAL} h WHERE rank <= 10) GROUP BY 1""")
    def _(s, d):
        chunks = table(s, d, "chunks").where("doc_id IS NOT NULL").select(F.col("row_id").alias("item_id"), F.explode("page_ids").alias("p"), "doc_id").select("item_id", F.concat_ws("/", "doc_id", "p").alias("unit"))
        return M.chunk_hits(lexical_hits(s, d, numbered(s, d)), chunks, page_gold(numbered(s, d)), "unit")

    @q("e8_span_in_top_five", f"""SELECT q.query_id, max(CASE WHEN contains(lower(c.text), lower(q.span)) THEN 1 ELSE 0 END) AS found FROM (SELECT DISTINCT query_id, exact_answer_span AS span FROM retrieval_queries WHERE exact_answer_span IS NOT NULL AND {QUERY_NO} % 50 = 0) q
        JOIN {LEXICAL} h ON h.query_id = q.query_id AND h.rank <= 5 JOIN chunks c ON c.row_id = h.item_id GROUP BY 1""")
    def _(s, d):
        spans = table(s, d, "retrieval_queries").where("exact_answer_span IS NOT NULL").select("query_id", F.col("exact_answer_span").alias("span")).distinct()
        return M.span_found(lexical_hits(s, d, numbered(s, d)), table(s, d, "chunks").select(F.col("row_id").alias("item_id"), "text"), spans, 5)

    @q("e8_span_found", """SELECT q.query_id, q.loaded_at, max(CASE WHEN contains(lower(p.text), lower(q.exact_answer_span)) THEN 1 ELSE 0 END) AS found FROM (SELECT DISTINCT query_id, loaded_at, doc_id, exact_answer_span, unnest(page_ids) AS page_id
        FROM retrieval_queries WHERE exact_answer_span IS NOT NULL) q JOIN canonical_pages p ON p.doc_id = q.doc_id AND p.page_id = q.page_id WHERE p.text IS NOT NULL GROUP BY 1, 2""")
    def _(s, d):
        own = table(s, d, "retrieval_queries").where("exact_answer_span IS NOT NULL").select("query_id", "loaded_at", "doc_id", "exact_answer_span", F.explode("page_ids").alias("page_id")).distinct()
        pages = table(s, d, "canonical_pages").where("text IS NOT NULL").select("doc_id", "page_id", "text")
        return own.join(pages, ["doc_id", "page_id"]).groupBy("query_id", "loaded_at").agg(F.max(F.contains(F.lower("text"), F.lower("exact_answer_span")).cast("int")).alias("found"))

    CONF = """CAST(count(*) FILTER (score < %s AND is_negative) AS BIGINT) AS tp, count(*) FILTER (score < %s AND NOT is_negative) AS fp, count(*) FILTER (score >= %s AND is_negative) AS fn, count(*) FILTER (score >= %s AND NOT is_negative) AS tn"""

    def scored(s, d):
        return table(s, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("score"), (F.col("label") >= 7).alias("is_negative"))

    @q("e10_abstention", f"SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy FROM (SELECT {CONF % (('0.0',) * 4)} FROM {NEG})")
    def _(s, d):
        return scored(s, d).agg(*M.abstention(scored(s, d), F.lit(0.0)))

    @q("e11_threshold_sweep", f"SELECT tau, CAST(tp AS BIGINT) AS tp, fp, fn, tn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 9) AS f1 FROM (SELECT tau, {CONF % (('tau',) * 4)} FROM {NEG}, (SELECT range / 100.0::DOUBLE AS tau FROM range(-40, 41)) GROUP BY 1)")
    def _(s, d):
        grid = s.range(-40, 41).select((F.col("id") / 100.0).alias("tau"))
        return M.threshold_sweep(scored(s, d), grid).withColumn("f1", F.round("f1", 9))

    GRID = f"(SELECT low + range * (high - low) / 99.0::DOUBLE AS tau FROM range(100), (SELECT min(score) - 0.05 AS low, max(score) + 0.05 AS high FROM {NEG}))"

    @q("e11_best_threshold", f"""SELECT round(arg_min(tau, (-objective, tau)), 9) AS tau, round(max(objective), 9) AS objective FROM (SELECT tau, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) + coalesce(tn / nullif(tn + fp, 0), 0.0), 9) AS objective
        FROM (SELECT tau, {CONF % (('tau',) * 4)} FROM {NEG}, {GRID} GROUP BY 1))""")
    def _(s, d):
        return M.best_threshold(scored(s, d), 100).select(F.round("tau", 9).alias("tau"), F.round("objective", 9).alias("objective"))

    @q("e12_select_best", f"""SELECT model, round(r5, 9) AS r5, round(mrr, 9) AS mrr FROM (SELECT coalesce(q.type, 'none') AS model, avg(hit_at_5) AS r5, avg(reciprocal_rank) AS mrr, avg(coverage) AS coverage, avg(all_found) AS span, avg(len) AS latency FROM ({PAGE_METRICS}) m
        JOIN (SELECT query_id, min(type) AS type, min(length(question)) AS len FROM retrieval_queries GROUP BY 1) q ON q.query_id = m.query_id GROUP BY 1) ORDER BY round(r5, 9) DESC, round(mrr, 9) DESC, round(coverage, 9) DESC, round(span, 9) DESC, round(latency, 9), model LIMIT 1""")
    def _(s, d):
        asked = table(s, d, "retrieval_queries")
        own = M.retrieval_metrics(page_gold(asked), hit_pages(s, d, asked), "unit")
        kinds = table(s, d, "retrieval_queries").groupBy("query_id").agg(F.coalesce(F.min("type"), F.lit("none")).alias("model"), F.min(F.length("question")).alias("len"))
        sums = own.join(kinds, "query_id").groupBy("model").agg(*[F.round(F.avg(a), 9).alias(b) for a, b in (("hit_at_5", "r5"), ("reciprocal_rank", "mrr"), ("coverage", "coverage"), ("all_found", "span"), ("len", "latency"))])
        return M.select_best(sums, "model").select("model", "r5", "mrr")

    @q("e13_split_leakage", """SELECT doc_id, page_id FROM (SELECT DISTINCT doc_id, unnest(page_ids) AS page_id FROM retrieval_queries WHERE lower(trim(split)) = 'dev') INTERSECT SELECT doc_id, page_id FROM (SELECT DISTINCT doc_id, unnest(page_ids) AS page_id FROM retrieval_queries WHERE lower(trim(split)) = 'test')""")
    def _(s, d):
        own = table(s, d, "retrieval_queries").select("doc_id", F.lower(F.btrim("split")).alias("split"), F.explode("page_ids").alias("page_id"))
        return own.where("split = 'dev'").select("doc_id", "page_id").intersect(own.where("split = 'test'").select("doc_id", "page_id"))

    @q("e14_validate", "SELECT count(*) AS pages, CAST(sum(word_count) AS BIGINT) AS words, count(*) >= 300 AND sum(word_count) >= 60000 AS enough FROM canonical_pages")
    def _(s, d):
        return table(s, d, "canonical_pages").agg(F.count("*").alias("pages"), F.sum("word_count").alias("words"), ((F.count("*") >= 300) & (F.sum("word_count") >= 60000)).alias("enough"))

    @q("e15_exact_reward", "SELECT row_id, CAST(p.text IS NOT DISTINCT FROM l.text AS INT) AS reward FROM canonical_pages p JOIN page_labels l ON p.doc_id = l.doc_id AND p.page_id = l.page_id")
    def _(s, d):
        labels = table(s, d, "page_labels").withColumnRenamed("text", "gold")
        return table(s, d, "canonical_pages").join(labels, ["doc_id", "page_id"]).select("row_id", F.col("text").eqNullSafe(F.col("gold")).cast("int").alias("reward"))

    @q("e17_corroboration", """SELECT c.row_id, CASE WHEN c.page_ids IS NULL OR len(c.page_ids) = 0 THEN 'no signal' WHEN list_has_any(c.page_ids, coalesce(p.pages, [])) THEN 'agree' ELSE 'disagree' END AS verdict
        FROM chunks c LEFT JOIN (SELECT doc_id, list(DISTINCT page_id) AS pages FROM canonical_pages GROUP BY 1) p ON c.doc_id = p.doc_id""")
    def _(s, d):
        # Pages are joined one by one: a set of all pages of a book would grow with the book.
        pages = table(s, d, "canonical_pages").select("doc_id", "page_id").distinct().withColumn("there", F.lit(1))
        chunks = table(s, d, "chunks").select("row_id", "doc_id", "page_ids")
        seen = chunks.select("row_id", "doc_id", F.explode("page_ids").alias("page_id")).join(pages, ["doc_id", "page_id"]).groupBy("row_id").agg(F.max("there").alias("there"))
        verdict = F.when(F.coalesce(F.size("page_ids"), F.lit(0)) <= 0, "no signal").when(F.col("there").isNotNull(), "agree").otherwise("disagree")
        return chunks.join(seen, "row_id", "left").select("row_id", verdict.alias("verdict"))
