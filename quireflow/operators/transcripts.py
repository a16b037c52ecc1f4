"""Transcripts: overlapping pieces merged, books packed into chunks with page ranges, exports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.operators.windows import running_offsets
from quireflow.runtime import materialize

# Limits of chunks in characters, page types that are packed, signs that end a paragraph.
TARGET, MOST, OVERLAP, LEAST = 900, 1_400, 150, 120
PACKED = ("prose", "mixed", "table", "figure_plate")
TERMINAL = tuple(".!?:;\"')]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'(])")
_MARKER = re.compile(r"^\s*\[(?:FIGURE|TABLE)[^\]]*\]\s*$", re.I)
#: Longest and shortest prefix that is looked for, and the tail that it is looked for in.
LONGEST_PREFIX, SHORTEST_PREFIX, TAIL = 512, 32, 512


def merged_pieces(pieces: list[str]) -> str:
    """Pieces in order, each put over the end of the text where its longest prefix begins within the tail; else on a new line."""
    text = ""
    for piece in (" ".join(p.split()) for p in pieces if p):
        if not piece or not text:
            text = text or piece
            continue
        start = max(0, len(text) - TAIL)
        tail = text[max(0, start - LONGEST_PREFIX) :]
        base = len(text) - len(tail)
        for n in range(min(LONGEST_PREFIX, len(piece)), SHORTEST_PREFIX - 1, -1):
            at = tail.rfind(piece[:n])
            if at >= 0 and base + at >= start:
                text = text[: base + at] + piece
                break
        else:
            text = f"{text}\n{piece}"
    return text


def merge_overlapping(pieces: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(``group``, text) of the pieces of a page, which are few. Groups with no text at all give an empty one."""
    listed = pieces.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([merged_pieces(p or []) for p in b.column(1).to_pylist()], pa.string())], [group, "text"])

    return listed.mapInArrow(run, f"`{group}` {pieces.schema[group].dataType.simpleString()}, text string")


def paragraph_list(text: str | None) -> list[str]:
    """Paragraphs between blank lines, blanks collapsed, without markers of figures and tables."""
    found = (re.sub(r"[ \t]+", " ", p).strip() for p in re.split(r"\n\s*\n", text or ""))
    return [p for p in found if p and not _MARKER.match(p)]


def split_long(paragraph: str, most: int = MOST) -> list[str]:
    """Sentences of a long paragraph packed up to ``most`` characters; a longer sentence stays whole."""
    pieces = [""]
    for s in _SENTENCE.split(paragraph):
        if pieces[-1] and len(pieces[-1]) + len(s) + 1 > most:
            pieces.append(s)
        else:
            pieces[-1] = f"{pieces[-1]} {s}".strip()
    return [p.strip() for p in pieces if p.strip()]


def _packed_run(pages: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """(first page, last page, body) of a run of pages of one section."""
    waiting: list[list] = []
    out: list[tuple[int, int, str]] = []

    def pack() -> None:
        own: list[tuple[str, int, int]] = []
        for body, a, b in waiting:
            for piece in [body] if len(body) <= MOST else split_long(body):
                if own and sum(len(p) for p, _, _ in own) + len(piece) > TARGET:
                    emit(own)
                    own = []
                own.append((piece, a, b))
        if own:
            emit(own)
        waiting.clear()

    def emit(own: list[tuple[str, int, int]]) -> None:
        out.append((min(a for _, a, _ in own), max(b for _, _, b in own), "\n\n".join(p for p, _, _ in own).strip()))

    for number, text in pages:
        found = paragraph_list(text)
        if found and waiting and found[0][:1].islower() and not waiting[-1][0].rstrip().endswith(TERMINAL):
            # A paragraph that the page break divides keeps both pages.
            waiting[-1] = [f"{waiting[-1][0].rstrip()} {found.pop(0)}", waiting[-1][1], number]
        waiting += [[p, number, number] for p in found]
        if sum(len(w[0]) for w in waiting) >= 3 * MOST:
            pack()
    pack()
    return out


def book_chunks(pages: DataFrame, book: str, number: str, section: str, kind: str, text: str) -> DataFrame:
    """(book, chunk_no, section, first_page, last_page, text, overlap_chars, word_count) of books packed by characters.

    Pages are packed in runs of one section; a page of a kind that is not packed ends the run. A
    paragraph that a page break divides is put together. A body of fewer than ``LEAST``
    characters is added to the chunk before it, in an earlier run if need be; every other
    chunk begins with the last ``OVERLAP`` characters of the body before it in its run. Runs
    are told by global order, and each is packed by itself, so a book fills no single task;
    a run is a section of a book. Null pages have no text; null sections are one section.
    """
    kept = F.coalesce(F.col(kind).isin(*PACKED), F.lit(False))
    own = pages.where(F.col(book).isNotNull() & F.col(number).isNotNull()).select(F.col(book).alias("book"), F.col(number).cast("int").alias("number"), F.coalesce(F.col(section), F.lit("")).alias("section"), kept.alias("kept"), F.col(text).alias("text"))
    placed = materialize(running_offsets(own.withColumn("_one", F.lit(1)), ["book", "number", "section"], "_one", "at").drop("_one"), "chunk-pages")
    before = placed.select((F.col("at") + 1).alias("at"), F.col("book").alias("b"), F.col("section").alias("s"), F.col("kept").alias("k"))
    starts = placed.join(before, "at", "left").withColumn("start", F.when(F.col("b").eqNullSafe(F.col("book")) & F.col("s").eqNullSafe(F.col("section")) & F.col("k").eqNullSafe(F.col("kept")), 0).otherwise(1))
    runs = running_offsets(starts.select("at", "book", "number", "section", "kept", "text", "start"), ["at"], "start", "ended").where("kept")
    runs = runs.withColumn("run", F.col("ended") + F.col("start"))
    listed = runs.groupBy("book", "run").agg(F.first("section").alias("section"), F.sort_array(F.collect_list(F.struct("number", "text"))).alias("pages"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for bk, run, sec, own_pages in zip(*(b.column(i).to_pylist() for i in range(4))):
                rows += [(bk, run, sec, k, x, y, body) for k, (x, y, body) in enumerate(_packed_run([(p["number"], p["text"]) for p in own_pages]))]
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (b.schema.field(0).type, pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["book", "run", "section", "k", "first_page", "last_page", "body"])

    book_kind = placed.schema["book"].dataType.simpleString()
    bodies = listed.mapInArrow(pack, f"book {book_kind}, run bigint, section string, k int, first_page int, last_page int, body string").where("body <> ''")
    # A body that is too small goes to the chunk before it in the book; the first of a book stands by itself.
    numbered = materialize(running_offsets(bodies.withColumn("_one", F.lit(1)), ["book", "run", "k"], "_one", "at").drop("_one"), "chunk-bodies")
    first = numbered.groupBy("book").agg(F.min("at").alias("first_at"))
    own_chunk = (F.length("body") >= LEAST) | (F.col("at") == F.col("first_at"))
    numbered = numbered.join(first, "book").withColumn("heads", own_chunk.cast("int"))
    grouped = running_offsets(numbered, ["at"], "heads", "before").withColumn("chunk", F.col("before") + F.col("heads"))
    head = lambda c: F.max(F.when(F.col("heads") == 1, F.col(c)))
    chunks = grouped.groupBy("book", "chunk").agg(
        head("run").alias("run"), head("section").alias("section"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), head("body").alias("body"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n\n").alias("whole"),
    )
    chunks = materialize(chunks, "chunk-texts")
    tail = chunks.select((F.col("chunk") + 1).alias("chunk"), F.col("run").alias("run_before"), F.substring(F.reverse("body"), 1, OVERLAP).alias("backwards"))
    joined = chunks.join(tail, "chunk", "left").withColumn("overlap", F.when(F.col("run_before") == F.col("run"), F.reverse("backwards")).otherwise(F.lit("")))
    out = F.when(F.col("overlap") != "", F.concat("overlap", F.lit("\n\n"), "whole")).otherwise(F.col("whole"))
    base = chunks.groupBy("book").agg(F.min("chunk").alias("base"))
    return joined.join(base, "book").select(
        F.col("book").alias(book), (F.col("chunk") - F.col("base") + 1).alias("chunk_no"), "section", "first_page", "last_page", F.btrim(out).alias("text"), F.length("overlap").alias("overlap_chars"),
        F.size(F.filter(F.split(F.btrim(out), r"\s+"), lambda w: w != "")).alias("word_count"),
    )


def export_rows(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """Text chunks and figures in one table with ``modality``; columns that one side lacks are null."""
    return chunks.withColumn("modality", F.lit("text")).unionByName(figures.withColumn("modality", F.lit("figure")), allowMissingColumns=True)


def stream_pieces(text: Column | str) -> Column:
    """Pieces (page_id, piece_no, modality, content) of a readable export, whose headers are lines ``[pcma_pNNNN_cN] (modality) ...``."""
    # The text is cut before each header line; fixed value: the form of the header.
    parts = F.split(text, r"(?m)^(?=\[pcma_p\d{4}_c\d+\]\s+\([^)]*\)\s+)")
    header = r"(?s)^\[pcma_(p\d{4})_c(\d+)\]\s+\(([^)]*)\)\s+[^\n]*\n?(.*)$"
    piece = lambda p: F.struct(
        F.regexp_extract(p, header, 1).alias("page_id"), F.regexp_extract(p, header, 2).try_cast("int").alias("piece_no"), F.regexp_extract(p, header, 3).alias("modality"),
        F.btrim(F.regexp_extract(p, header, 4), F.lit(" \t\r\n\f")).alias("content"),
    )
    return F.filter(F.transform(parts, piece), lambda x: (x["page_id"] != "") & (x["content"] != ""))
