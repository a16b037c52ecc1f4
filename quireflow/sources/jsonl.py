"""Line-delimited JSON of pages, queries, blocks, words and detections.

Readers take a DataFrame of lines (value, and optionally path and line_no), so files,
tables and streams are parsed alike; ``read_lines`` makes one from files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "doc_id string, page_id string, page_num int, text string, word_count int, char_count int, ocr_source string"
QUERY = (
    "query_id string, split string, type string, region string, category string, question string, page_ids array<string>, target_pages array<string>, "
    "gold_pages array<string>, exact_answer_span string, span_start int, span_end int, manually_verified boolean"
)
BLOCK = "book_page string, page_id string, bbox array<double>, page_box array<double>, label string, content string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value): lines numbered within their file, which is read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "value")).withColumn("line_no", F.col("line_no") + 1)


def parsed(lines: DataFrame, schema: str, comments: bool = False, strict: bool = False) -> DataFrame:
    """Lines that are not blank (nor, with ``comments``, begin with #) as ``row``; broken ones have a null row, or raise an error that names file and line."""
    own = lines.where(F.btrim("value", F.lit(" \t\r")) != "")
    if comments:
        own = own.where(~F.ltrim("value").startswith("#"))
    where = F.concat_ws(":", *[F.col(c).cast("string") for c in ("path", "line_no") if c in lines.columns], F.lit(" broken JSON"))
    row = F.from_json("value", schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    own = own.withColumn("row", row)
    bad = F.col("row").isNull() | F.col("row._broken").isNotNull()
    return own.withColumn("row", F.when(~bad, F.col("row")).otherwise(F.raise_error(F.concat(where, F.lit(": "), F.substring("value", 1, 200))) if strict else F.lit(None)))


def canonical_pages(lines: DataFrame) -> DataFrame:
    """Page rows with an id and text; # begins a comment."""
    rows = parsed(lines, PAGE, comments=True).where("row IS NOT NULL").select("row.*").drop("_broken")
    return rows.where((F.coalesce("page_id", F.lit("")) != "") & (F.btrim(F.coalesce("text", F.lit(""))) != ""))


def first_filled(*arrays: str) -> Column:
    """The first array that is neither null nor empty."""
    return F.coalesce(*[F.when(F.size(a) > 0, F.col(a)) for a in arrays])


def retrieval_queries(lines: DataFrame) -> DataFrame:
    """Queries with pages from the first filled key, and the type inferred from their number where it is missing."""
    rows = parsed(lines, QUERY).where("row IS NOT NULL").select("row.*")
    pages = first_filled("page_ids", "target_pages", "gold_pages")
    inferred = F.when(pages.isNull(), "out_of_corpus").when(F.size(pages) == 1, "single_page").otherwise("multi_page")
    return rows.withColumn("gold", pages).withColumn("type", F.coalesce(F.nullif("type", F.lit("")), inferred)).drop("page_ids", "target_pages", "gold_pages", "_broken").withColumnRenamed("gold", "page_ids")


def block_page() -> Column:
    """Page id of a block: from a positive page number, else its own id; raises where neither is there."""
    number = F.col("row.book_page").try_cast("int")
    own = F.nullif(F.col("row.page_id"), F.lit(""))
    return F.when(number > 0, F.format_string("p%04d", number)).when(own.isNotNull(), own).otherwise(F.raise_error(F.lit("block without a page")).cast("string"))


def blocks(lines: DataFrame) -> DataFrame:
    """(page_id, label, content, x0..y1 in shares of the page), reject reason in ``reject`` for boxes that are no boxes."""
    rows = parsed(lines, BLOCK).where("row IS NOT NULL")
    b, p = F.col("row.bbox"), F.col("row.page_box")
    w, h = F.get(p, 2) - F.get(p, 0), F.get(p, 3) - F.get(p, 1)
    good = (F.size(b) == 4) & (F.size(p) == 4) & (w > 0) & (h > 0) & (F.get(b, 2) > F.get(b, 0)) & (F.get(b, 3) > F.get(b, 1))
    part = lambda i, base, size: F.when(good, F.least(F.greatest((F.get(b, i) - base) / size, F.lit(0.0)), F.lit(1.0)))
    return rows.select(
        block_page().alias("page_id"), F.col("row.label").alias("label"), F.col("row.content").alias("content"),
        part(0, F.get(p, 0), w).alias("x0"), part(1, F.get(p, 1), h).alias("y0"), part(2, F.get(p, 0), w).alias("x1"), part(3, F.get(p, 1), h).alias("y1"),
        F.when(~F.coalesce(good, F.lit(False)), "bad box").alias("reject"), *[c for c in ("path", "line_no") if c in lines.columns],
    )


def pages_from_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """Page texts from blocks in their order, pictures left out, tags to blanks, joined by blank lines."""
    text = F.btrim(F.regexp_replace("content", r"<[^>]+>", " "))
    own = rows.where(~F.lower(F.coalesce("label", F.lit(""))).isin("figure", "image", "picture")).withColumn("_t", text).where("_t != ''")
    listed = F.sort_array(F.collect_list(F.struct(*order, "_t")))
    return own.groupBy("page_id").agg(F.array_join(F.transform(listed, lambda x: x["_t"]), "\n\n").alias("text"))


def with_page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Every page of the range; ocr_source tells the missing and the empty ones."""
    wanted = pages.sparkSession.range(first, last + 1).select(F.format_string("p%04d", "id").alias("page_id"))
    joined = wanted.join(pages, "page_id", "left")
    return joined.withColumn("ocr_source", F.when(F.col("text").isNull(), "missing").when(F.btrim("text") == "", "empty").otherwise("blocks")).withColumn("text", F.coalesce("text", F.lit("")))


def with_page_ranges(pages: DataFrame, tops: DataFrame, book: str, top: str) -> DataFrame:
    """Every page from 1 to the top of each book; ocr_source tells the missing and the empty ones."""
    wanted = tops.where(F.col(top) >= 1).select(book, F.explode(F.sequence(F.lit(1), F.col(top))).alias("_n")).select(book, F.format_string("p%04d", "_n").alias("page_id"))
    joined = wanted.join(pages, [book, "page_id"], "left")
    source = F.when(F.col("text").isNull(), "missing").when(F.btrim("text") == "", "empty").otherwise("blocks")
    return joined.select(book, "page_id", source.alias("ocr_source"), F.coalesce("text", F.lit("")).alias("text"))


def unique_or_raise(df: DataFrame, key: str) -> DataFrame:
    """``df``; reading it raises if a key stands twice."""
    counted = df.groupBy(key).agg(F.count("*").alias("_n"))
    twice = counted.where("_n > 1").agg(F.max(F.col(key).cast("string")).alias("k"))
    check = F.when(F.col("k").isNotNull(), F.raise_error(F.concat(F.lit(f"{key} stands twice: "), "k")).cast("string"))
    return df.join(F.broadcast(twice.select(check.alias("_check"))), F.col("_check").isNull()).drop("_check")


# Labels of blocks that are pictures.
PICTURES = ("figure", "image", "picture")


def page_texts(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """(page_id, text) of page rows or block rows alike: pictures left out, the texts of a page in the order of the file, a line each."""
    rows = parsed(lines, "page_id string, book_page string, text string, content string, label string").where("row IS NOT NULL")
    number = F.col("row.book_page").try_cast("int")
    page = F.coalesce(F.nullif("row.page_id", F.lit("")), F.when(number > 0, F.format_string("p%04d", number)))
    text = F.btrim(F.coalesce("row.text", "row.content"), F.lit(" \t\r\n\f"))
    own = rows.select(page.alias("page_id"), text.alias("t"), F.col(order).alias("o"), F.lower(F.coalesce("row.label", F.lit(""))).alias("label"))
    own = own.where(F.col("page_id").isNotNull() & (F.coalesce("t", F.lit("")) != "") & ~F.col("label").isin(*PICTURES))
    return own.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n").alias("text"))  # blocks of one page


def cleaned_pages(lines: DataFrame, doc_id: str, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_id, text, image) of page rows whose cleaned text is not empty; the image comes from an index (page_id, image)."""
    from quireflow.functions.text import squeeze

    rows = parsed(lines, "page_id string, text string").where("row IS NOT NULL").select(F.lit(doc_id).alias("doc_id"), F.col("row.page_id").alias("page_id"), squeeze(F.regexp_replace("row.text", r"<[^>]+>", " ")).alias("text"))
    rows = rows.where((F.coalesce("page_id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))
    return rows.join(images, "page_id", "left").select("doc_id", "page_id", "text", "image") if images is not None else rows.withColumn("image", F.lit(None).cast("string"))


def corpus_or_blocks(candidates: list[DataFrame], expected: int, block_lines: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """The first candidate with exactly ``expected`` pages, as (page_id, text, ocr_source); else pages made of blocks over the whole range."""
    for c in candidates:
        if c.limit(expected + 1).count() == expected:
            return c.select("page_id", "text", "ocr_source")
    return with_page_range(pages_from_blocks(blocks(block_lines), order), first, last).select("page_id", "text", "ocr_source")


def reference_words(lines: DataFrame) -> DataFrame:
    """(page_id, text, x0..y1) of words whose box is finite, within the page and no line or point."""
    rows = parsed(lines, "page_id string, text string, bbox_norm array<double>").where("row IS NOT NULL")
    b = F.col("row.bbox_norm")
    x0, y0, x1, y1 = (F.get(b, i) for i in range(4))
    good = (F.size(b) == 4) & ~F.isnan(x0) & ~F.isnan(y0) & (x0 >= 0) & (x0 < x1) & (x1 <= 1) & (y0 >= 0) & (y0 < y1) & (y1 <= 1)
    return rows.where(F.coalesce(good, F.lit(False))).select("row.page_id", "row.text", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def reference_figures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes of the figures of ``blocks``, and the pages that were seen at all."""
    figures = rows.where(F.lower(F.coalesce("label", F.lit(""))).isin(*PICTURES) & F.col("reject").isNull())
    return figures.select("page_id", "x0", "y0", "x1", "y1"), rows.select("page_id").distinct()


def detector_runs(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of (path, value) with the detector that the file is named after; files without rows give none."""
    rows = parsed(lines, schema).where("row IS NOT NULL")
    return rows.select(F.regexp_extract("path", r"([^/]+?)(?:\.jsonl)?$", 1).alias("detector"), "row.*").drop("_broken")


def ordered_regions(regions: DataFrame, pages: DataFrame, page: str = "page", idx: str = "idx") -> DataFrame:
    """Regions of the listed pages that are no figures (column is_figure), held within [0, 1], with their place from top left."""
    from pyspark.sql import Window

    held = regions.join(pages.select(page).distinct(), page, "left_semi").where(~F.coalesce("is_figure", F.lit(False)))
    held = held.withColumns({c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) for c in ("x0", "y0", "x1", "y1")})
    return held.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("y0", "x0", "y1", "x1", idx)))


#: Depth to which blocks within blocks are read.
DEPTH = 4


def cloud_blocks(lines: DataFrame, key: str) -> DataFrame:
    """(``key``, depth, path, type, text) of nested blocks {type, text, blocks}, in the order of the document, to ``DEPTH`` levels."""
    kind = "array<struct<type string, text string>>"
    for _ in range(DEPTH - 1):
        kind = f"array<struct<type string, text string, blocks {kind}>>"
    level = lines.select(key, F.from_json("value", f"blocks {kind}").alias("doc")).select(key, F.posexplode("doc.blocks").alias("i", "b")).select(key, F.array("i").alias("path"), "b")
    out = None
    for depth in range(DEPTH):
        own = level.select(key, F.lit(depth).alias("depth"), "path", "b.type", "b.text")
        out = own if out is None else out.unionByName(own)
        if depth < DEPTH - 1:
            level = level.select(key, "path", F.posexplode("b.blocks").alias("i", "c")).select(key, F.concat("path", F.array("i")).alias("path"), F.col("c").alias("b"))
    return out


def append_lines(rows: DataFrame, path: str) -> None:
    """Adds the rows to a folder of JSON lines; what is there stays."""
    rows.write.mode("append").json(path)


def sniffed(lines: DataFrame) -> DataFrame:
    """(path, kind, n): what each file holds, by the keys of most of its lines; of each kind the caller takes the largest."""
    keys = F.json_object_keys("value")
    has = lambda *ks: F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ks]))
    kind = F.when(has("bbox_norm") & has("text"), "words").when(has("bbox", "bbox_px"), "blocks").when(has("question"), "queries").when(has("page_id") & has("text"), "pages").otherwise("other")
    counted = lines.where(F.btrim("value") != "").groupBy("path", kind.alias("kind")).agg(F.count("*").alias("n"))
    return counted.groupBy("path").agg(F.max_by(F.struct("kind", "n"), F.struct("n", "kind")).alias("b")).select("path", "b.kind", "b.n")
