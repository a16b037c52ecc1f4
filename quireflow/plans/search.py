"""Vector and lexical search. Queries are the rows whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.catalog import Catalog, table
from quireflow.operators import retrieval as R

SCORED = """(SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_inner_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings i WHERE q.vec_id % 50 = 0)"""
TOP = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {SCORED})"
QUERY_NO = "CAST(regexp_extract(query_id, '([0-9]+)$', 1) AS BIGINT)"
SPLIT = "list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
BM25 = f"""(WITH asked AS (SELECT DISTINCT query_id, unnest({SPLIT.format('question')}) AS term FROM retrieval_queries WHERE {QUERY_NO} % 50 = 0),
    counted AS (SELECT row_id AS item_id, unnest({SPLIT.format('text')}) AS term FROM chunks),
    lens AS (SELECT item_id, count(*) AS len FROM counted GROUP BY 1), sizes AS (SELECT (SELECT count(*) FROM chunks) AS docs, (SELECT count(*) FROM counted) / (SELECT count(*) FROM chunks) AS mean),
    tf AS (SELECT item_id, term, count(*) AS tf FROM counted WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
    SELECT query_id, item_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score
    FROM tf JOIN df USING (term) JOIN lens USING (item_id) JOIN asked USING (term) CROSS JOIN sizes GROUP BY 1, 2)"""
LEXICAL = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {BM25})"
#: Of all questions.
LEXICAL_ALL = LEXICAL.replace(f" WHERE {QUERY_NO} % 50 = 0", "")
#: Training-free vectors of texts: terms fall into places by the first eight hexadecimal digits of their digest, with a sign by the ninth.
HASHED = "(SELECT {key}, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS place, sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END) AS v FROM (SELECT {key}, unnest(" + SPLIT + ") AS term FROM {source}) GROUP BY 1, 2)"
DENSE = f"""(WITH i AS {HASHED.format('text', key='row_id', source='chunks')}, a AS {HASHED.format('question', key='query_id', source=f"(SELECT DISTINCT query_id, question FROM retrieval_queries WHERE {QUERY_NO} % 50 = 0)")},
    li AS (SELECT row_id, sqrt(sum(v * v)) AS n FROM i GROUP BY 1 HAVING sum(v * v) > 0), la AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM a GROUP BY 1 HAVING sum(v * v) > 0)
    SELECT query_id, row_id AS item_id, round(coalesce(s, 0) / (la.n * li.n), 9) AS score FROM la CROSS JOIN li LEFT JOIN (SELECT query_id, row_id, sum(a.v * i.v) AS s FROM a JOIN i USING (place) GROUP BY 1, 2) USING (query_id, row_id))"""


def register(c: Catalog) -> None:
    q = c.query
    items = lambda s, d: table(s, d, "embeddings")
    asked = lambda s, d: items(s, d).where("vec_id % 50 = 0")

    def questions(s, d):
        return table(s, d, "retrieval_queries").where(F.regexp_extract("query_id", "([0-9]+)$", 1).cast("bigint") % 50 == 0)

    def lexical(s, d):
        return R.bm25(table(s, d, "chunks"), questions(s, d), "row_id", "text", "query_id", "question")

    def dense(s, d):
        vectors = R.hashed_vectors(table(s, d, "chunks"), "row_id", "text")
        # Ids of queries are text: their number stands for them in the search.
        own = R.hashed_vectors(questions(s, d).select(F.regexp_extract("query_id", "([0-9]+)$", 1).cast("bigint").alias("row_id"), "question").distinct(), "row_id", "question")
        names = questions(s, d).select("query_id", F.regexp_extract("query_id", "([0-9]+)$", 1).cast("bigint").alias("n")).distinct()
        found = R.exact_top_k(vectors, own, "row_id", "vector")
        return found.withColumnRenamed("query_id", "n").join(names, "n").select("query_id", "item_id", "score", "rank")

    @q("v2_unit_vectors", "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS unit FROM embeddings")
    def _(s, d):
        return items(s, d).select("vec_id", R.unit("embedding").alias("unit"))

    @q("v3_exact_topk", f"SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM {TOP} WHERE rank <= 10")
    def _(s, d):
        return R.exact_top_k(items(s, d), asked(s, d), "vec_id", "embedding")

    @q("v4_ivf_topk")
    def _(s, d):
        return R.ivf_top_k(items(s, d), asked(s, d), "vec_id", "embedding")

    @q("v4_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
    def _(s, d):
        near = R.agreement(R.exact_top_k(items(s, d), asked(s, d), "vec_id", "embedding"), R.ivf_top_k(items(s, d), asked(s, d), "vec_id", "embedding"))
        return near.agg(F.count("*").alias("queries"), (F.avg("agreement") >= 0.9).alias("enough"))

    @q("a24_agreement", f"""SELECT query_id, count(*) FILTER (h.item_id IS NOT NULL) / 10.0::DOUBLE AS agreement FROM (SELECT * FROM {TOP} WHERE rank <= 10) t LEFT JOIN
        (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_inner_product(q.embedding[1:32]::DOUBLE[], i.embedding[1:32]::DOUBLE[]), 9) AS score
        FROM embeddings q, embeddings i WHERE q.vec_id % 50 = 0)) WHERE rank <= 10) h USING (query_id, item_id) GROUP BY 1""")
    def _(s, d):
        half = items(s, d).select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
        return R.agreement(R.exact_top_k(items(s, d), asked(s, d), "vec_id", "embedding"), R.exact_top_k(half, half.where("vec_id % 50 = 0"), "vec_id", "embedding"))

    @q("v7_bm25", f"SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM {LEXICAL} WHERE rank <= 10")
    def _(s, d):
        return lexical(s, d)

    @q("v1_hashed_vectors", f"SELECT row_id, place, v FROM {HASHED.format('text', key='row_id', source='chunks')} WHERE v <> 0")
    def _(s, d):
        own = R.hashed_vectors(table(s, d, "chunks"), "row_id", "text", unit_length=False)
        return own.select("row_id", F.posexplode("vector").alias("place", "v")).select("row_id", F.col("place").cast("bigint").alias("place"), F.col("v").cast("bigint").alias("v")).where("v <> 0")

    @q("v7_hybrid", f"""SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM
        (SELECT query_id, item_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, item_id, rank FROM {LEXICAL} WHERE rank <= 10 UNION ALL
        SELECT query_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {DENSE}) WHERE rank <= 10) GROUP BY 1, 2)) WHERE rank <= 10""")
    def _(s, d):
        return R.reciprocal_rank_fusion([lexical(s, d), dense(s, d)])

    @q("v9_evidence_gate", f"""SELECT query_id, coalesce(max(score), 0.0) AS top_score, coalesce(max(score), 0.0) < 0.55 AS is_weak, CASE WHEN coalesce(max(score), 0.0) < 0.55 THEN 20 END AS next_k
        FROM (SELECT * FROM {SCORED} WHERE query_id <> item_id) GROUP BY 1""")
    def _(s, d):
        hits = R.exact_top_k(items(s, d), asked(s, d), "vec_id", "embedding", skip_self=True)
        return R.evidence_gate(asked(s, d).select(F.col("vec_id").alias("query_id")), hits)

    @q("v10_widen_k", f"""SELECT query_id, k, CASE WHEN top < 0.55 AND k + 10 <= 40 THEN k + 10 END AS next_k FROM (SELECT query_id, coalesce(max(score), 0.0) AS top FROM (SELECT * FROM {SCORED} WHERE query_id <> item_id) GROUP BY 1), (VALUES (10), (20), (30), (40)) t(k)""")
    def _(s, d):
        hits = R.exact_top_k(items(s, d), asked(s, d), "vec_id", "embedding", skip_self=True)
        gate = R.evidence_gate(asked(s, d).select(F.col("vec_id").alias("query_id")), hits)
        own = gate.select("query_id", "is_weak", F.explode(F.array(*[F.lit(k) for k in (10, 20, 30, 40)])).alias("k"))
        return own.select("query_id", "k", F.when(F.col("is_weak"), R.wider(F.col("k"))).alias("next_k"))

    @q("v11_gated_search", f"""SELECT q.query_id, CASE WHEN r IS NULL THEN 40 ELSE least(40, greatest(10, CAST(10 + ceil((r - 10) / 10) * 10 AS INT))) END AS k_used, r IS NULL AS abstains FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0) q LEFT JOIN
        (SELECT query_id, min(rank) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {SCORED} WHERE query_id <> item_id) WHERE rank <= 40 AND score >= 0.55 GROUP BY 1) h ON q.query_id = h.query_id""")
    def _(s, d):
        hits = R.exact_top_k(items(s, d), asked(s, d), "vec_id", "embedding", k=40, skip_self=True)
        return R.gated_search(asked(s, d).select(F.col("vec_id").alias("query_id")), hits)
