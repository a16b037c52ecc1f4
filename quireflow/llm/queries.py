"""Queries of the training-data problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.catalog import Catalog, table
from quireflow.llm import encodings, markup, mixing, neighbours, overlap, quality, scan, splitting, tokenize
from quireflow.runtime import materialize

CATALOG = Catalog()
query = CATALOG.query


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "benchmark_chunks"), table(spark, d, "chunk_limits"), "chunk_id", "text")


@query(
    "p5_found",
    """SELECT DISTINCT b.chunk_id FROM benchmark_chunks b JOIN chunk_limits l ON l.strategy = b.strategy
    WHERE len(regexp_extract_all(b.text, '[^ \\t\\r\\n]+')) > l.max_words""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Items above the limit of their strategy."""
    return _pieces(spark, d).select(F.col("item_key").alias("chunk_id")).distinct()


@query("p5_pieces")
def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every item above its limit."""
    return _pieces(spark, d).withColumnRenamed("item_key", "chunk_id")


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cosine 0.8 or more of which one is among the five nearest of the other."""
    near = neighbours.nearest(table(spark, d, "chunk_vectors"), "vec_id", "embedding", k=5, min_cos=0.8)
    return near.where("cos >= 0.8").select(F.least("vec_id", "near_id").alias("vec_a"), F.greatest("vec_id", "near_id").alias("vec_b")).distinct()


@query("p6_neighbours")
def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of each usable vector."""
    return neighbours.nearest(table(spark, d, "chunk_vectors"), "vec_id", "embedding", k=5)


@query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of each document by byte_bpe_50k."""
    return tokenize.encode_ids(table(spark, d, "documents"), "doc_id", "text")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Pages and chunks as (rec, row_id, doc_id, text)."""
    pages = table(spark, d, "canonical_pages").select(F.lit("page").alias("rec"), "row_id", "doc_id", "text")
    return pages.unionByName(table(spark, d, "chunks").select(F.lit("chunk").alias("rec"), "row_id", "doc_id", "text"))


def _page_quality(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and prose distance of every page row."""
    stats = materialize(quality.text_statistics(table(spark, d, "canonical_pages"), ["row_id"], "text"), "page-statistics")
    return quality.prose_distance(stats, quality.fit_prose(stats))


def _no_prose(spark: SparkSession, d: str) -> DataFrame:
    return _page_quality(spark, d).where("NOT is_prose").select(F.lit("page").alias("rec"), "row_id")


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of prose that hold markup."""
    marked = markup.clean_markup(_records(spark, d), ["rec", "row_id"], "text", only_marked=True)
    return marked.select("rec", "row_id").join(_no_prose(spark, d), ["rec", "row_id"], "left_anti").distinct()


@query("p1_clean")
def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every page and chunk."""
    return markup.clean_markup(_records(spark, d), ["rec", "row_id"], "text")


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages with content that are no natural prose."""
    return _page_quality(spark, d).where("NOT is_prose").select("row_id").distinct()


@query("p3_statistics")
def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every page beside the recorded counts, with the distance from prose and what adds to it."""
    recorded = table(spark, d, "canonical_pages").select("row_id", "word_count", "char_count")
    return recorded.join(_page_quality(spark, d), "row_id")


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of prose that hold noise of scanning."""
    noisy = scan.find_noise(_records(spark, d), ["rec", "row_id"])
    return noisy.join(_no_prose(spark, d), ["rec", "row_id"], "left_anti")


@query("p2_repaired")
def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Continuous text of every page and chunk."""
    return scan.repair(_records(spark, d), ["rec", "row_id"])


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were decoded with a wrong encoding, wholly or in part."""
    return encodings.find_garbled(table(spark, d, "documents"), "doc_id", "text")


@query("p9_restored")
def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """Original text of the documents with garbled words, where it can be had."""
    return encodings.restore(table(spark, d, "documents"), "doc_id", "text")


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a train record and a dev or test record that ask the same."""
    pairs = overlap.find_overlaps(table(spark, d, "retrieval_queries"))
    return pairs.select(F.least("train_id", "held_id").alias("query_a"), F.greatest("train_id", "held_id").alias("query_b")).distinct()


@query("p4_counts")
def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and evaluation records that overlap with train, for each split and source."""
    queries = table(spark, d, "retrieval_queries")
    held = queries.select(F.col("query_id").alias("held_id"), F.lower(F.regexp_replace("split", r"^\s+|\s+$", "")).alias("split"), "source").distinct()
    pairs = overlap.find_overlaps(queries).groupBy("held_id").agg(F.count("*").alias("n"))
    return held.join(pairs, "held_id").groupBy("split", "source").agg(F.sum("n").alias("n_pairs"), F.countDistinct("held_id").alias("n_records"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their length in tokens of byte_bpe_50k, encoded once."""
    documents = table(spark, d, "documents")
    counts = tokenize.token_counts(documents, "doc_id", "text", carry=["source"])
    return materialize(counts, "mix-sizes")


@query("p8_mix")
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mixture and how often each is taken."""
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))


@query("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(sized, targets), sized, targets)
