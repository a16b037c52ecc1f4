"""Books as one Markdown text with page marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.functions.text import clean_markdown, images, page_id

#: Fixed value: the mark before each page.
MARK = r"<!--\s*book\s+p(\d+)\s*-->"


def raw_pages(books: DataFrame) -> DataFrame:
    """(doc_id, page_id, raw) of books (doc_id, text): what follows each mark; text before the first belongs to no page."""
    numbers = F.regexp_extract_all("text", F.lit(MARK), 1)
    parts = F.slice(F.split("text", MARK), 2, F.greatest(F.size(numbers), F.lit(1)))
    own = books.where(F.size(numbers) > 0).select("doc_id", F.explode(F.arrays_zip(numbers.alias("n"), parts.alias("raw"))).alias("p"))
    return own.select("doc_id", page_id(F.col("p.n").cast("int")).alias("page_id"), F.col("p.raw").alias("raw"))


def page_chunks(books: DataFrame) -> DataFrame:
    """(id, doc_id, page_id, text): one clean chunk a page, empty pages dropped."""
    own = raw_pages(books).withColumn("text", clean_markdown(F.col("raw"))).where("text != ''")
    return own.select(F.concat_ws("-", F.nullif("doc_id", F.lit("")), "page_id").alias("id"), "doc_id", "page_id", "text")


def image_index(books: DataFrame) -> DataFrame:
    """(doc_id, page_id, ord, caption, webp) of all image references."""
    return raw_pages(books).select("doc_id", "page_id", F.posexplode(images(F.col("raw"))).alias("ord", "i")).select("doc_id", "page_id", "ord", "i.caption", "i.webp")
