"""Chunking: text rows to rows of windows, parents and children, or packed paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions.text import HEADER, squeeze, words


def window_starts(n: Column, size: int, overlap: int, early_stop: bool = True) -> Column:
    """Ordinals of the windows over ``n`` words; with ``early_stop`` none lies wholly in the one before."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap within [0, size)")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)) if early_stop else F.ceil(n / step) - 1
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def fixed_windows(df: DataFrame, keys: list[str], text: str, size: int = 128, overlap: int = 16, early_stop: bool = True) -> DataFrame:
    """``keys``, ordinal, text and word_count of each window; rows without words give none."""
    own = df.select(*keys, words(F.col(text)).alias("_w"))
    own = own.select(*keys, "_w", F.explode(window_starts(F.size("_w"), size, overlap, early_stop)).alias("ordinal"))
    part = F.slice("_w", (F.col("ordinal") * (size - overlap) + 1).cast("int"), size)
    return own.select(*keys, F.col("ordinal"), F.array_join(part, " ").alias("text"), F.size(part).alias("word_count"))


def parent_child(df: DataFrame, keys: list[str], text: str, parent: int = 512, child: int = 128, overlap: int = 16, parent_overlap: int = 0, early_stop: bool = True) -> DataFrame:
    """Windows of children within windows of parents: ``keys``, parent_no, child_no, text, parent_text, word_count."""
    outer = fixed_windows(df, keys, text, parent, parent_overlap, early_stop).select(*keys, F.col("ordinal").alias("parent_no"), F.col("text").alias("parent_text"))
    inner = fixed_windows(outer, [*keys, "parent_no", "parent_text"], "parent_text", child, overlap, early_stop)
    return inner.withColumnRenamed("ordinal", "child_no")


def paragraphs(c: Column | str) -> Column:
    """Paragraphs between blank lines, without blank ends, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n\n"), lambda p: F.btrim(p, F.lit(" \t\r\n\f"))), lambda p: p != "")


#: Fixed value: the form of a header in the variant that joins paragraphs by blank lines.
WIDE_HEADER = r"^[A-Z0-9\s,.\-—:;()]{4,60}$"


def pack_paragraphs(df: DataFrame, keys: list[str], text: str, target: int = 300, section: Column | None = None, header_flushes: bool = True, joint: str = " ", header: str = HEADER) -> DataFrame:
    """Paragraphs packed greedily up to ``target`` words: ``keys``, ordinal, section_title, text, word_count.

    A paragraph of one line in capitals is a header: it names the section and, with
    ``header_flushes``, closes the chunk. A paragraph longer than the target stays whole.
    Paragraphs are joined by ``joint``; by blanks, their own white space is collapsed too.
    The fold keeps numbers of paragraphs; text is cut out at the end.
    """
    first = section if section is not None else F.lit(None).cast("string")
    own = df.select(*keys, F.transform(paragraphs(F.col(text)), lambda p: F.struct(p.alias("p"), F.size(words(p)).alias("n"), (~p.contains("\n") & p.rlike(header)).alias("h"))).alias("_p"), first.cast("string").alias("_first"))
    empty = F.array().cast("array<struct<section:string,text:string,n:int>>")
    chunk = lambda a: F.struct(a["section"].alias("section"), a["text"].alias("text"), a["n"].alias("n"))
    state = lambda done, sec, text, n: F.struct(done.alias("done"), sec.alias("section"), text.alias("text"), n.alias("n"))

    def add(a: Column, p: Column) -> Column:
        closed = F.concat(a["done"], F.array(chunk(a)))
        body = squeeze(p["p"]) if joint == " " else p["p"]
        flush = a["n"] > 0
        on_header = state(F.when(flush & F.lit(header_flushes), closed).otherwise(a["done"]), p["p"], F.when(F.lit(header_flushes), F.lit("")).otherwise(a["text"]), F.when(F.lit(header_flushes), F.lit(0)).otherwise(a["n"]))
        full = flush & (a["n"] + p["n"] > target)
        on_full = state(closed, a["section"], body, p["n"])
        on_more = state(a["done"], a["section"], F.when(flush, F.concat_ws(joint, a["text"], body)).otherwise(body), a["n"] + p["n"])
        return F.when(p["h"], on_header).when(full, on_full).otherwise(on_more)

    folded = F.aggregate("_p", state(empty, F.col("_first"), F.lit(""), F.lit(0)), add, lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(chunk(a)))).otherwise(a["done"]))
    out = own.select(*keys, F.posexplode(folded).alias("ordinal", "_c"))
    return out.select(*keys, F.col("ordinal").cast("bigint").alias("ordinal"), F.col("_c.section").alias("section_title"), F.col("_c.text").alias("text"), F.col("_c.n").alias("word_count"))


def suites(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The five named strategies in one table, ``strategy`` first."""
    parts = {
        "fixed_128_16": fixed_windows(df, keys, text, 128, 16),
        "fixed_256_32": fixed_windows(df, keys, text, 256, 32),
        "fixed_512_64": fixed_windows(df, keys, text, 512, 64),
        "paragraph_header_aware": pack_paragraphs(df, keys, text, 300),
        "parent_child_128_512": parent_child(df, keys, text).withColumn("ordinal", F.col("parent_no") * 1000 + F.col("child_no")),
    }
    out = None
    for name, part in parts.items():
        own = part.select(F.lit(name).alias("strategy"), *keys, "ordinal", "text", "word_count")
        out = own if out is None else out.unionByName(own)
    return out
