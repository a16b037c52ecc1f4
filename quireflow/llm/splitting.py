"""Cutting oversized items into pieces by content-defined chunking.

A rolling hash over the words marks landmarks in the text. Within the window of allowed
sizes, the landmark of the smallest hash is snapped to the nearest natural boundary of
the strongest kind at hand: heading, paragraph, line, sentence; failing all, the cut
stays at the landmark itself. Landmarks depend on nearby words alone, so an edit alters
the pieces around it, after which the cuts fall where they fell before.

Consecutive pieces share exactly ``overlap_words`` words. Pieces are exact slices of the
text, white space within them included. A word is a longest run of characters other
than space, tab, carriage return and line feed.

Defined results: an item with no more words than its limit, a null or blank text, and a
strategy without a limit give no pieces. Repeated rows (equal in key, strategy and text)
give their pieces once; rows that share a key but differ in text are told apart by
``item``. An overlap is cut to ``max_words - 1`` so that every piece advances.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words under the rolling hash.
WINDOW = 6
#: Smallest piece as a share of the limit, overlap included.
LEAST = 0.5

_WORD = re.compile(r"[^ \t\r\n]+")
_HEADING = re.compile(r"(?:#{1,6} |={2,6} ?\S|(?:CHAPTER|SECTION|PLATE|PART|BOOK)\b|(?:Chapter|Section|Part|Book) [IVXLC\d]+)")
_CLOSERS = "\"')]}”’»"

HEADING, PARAGRAPH, LINE, SENTENCE, WORD = 4, 3, 2, 1, 0
NAMES = ["word", "sentence", "line", "paragraph", "heading"]


def boundary_kinds(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Kind of the boundary before each word; that of the first is a paragraph."""
    kinds = [PARAGRAPH]
    for (a0, a1), (b0, _) in zip(spans, spans[1:]):
        gap = text[a1:b0]
        lines = gap.count("\n") or gap.count("\r")
        last = text[a0:a1].rstrip(_CLOSERS)[-1:]
        ended = last in (".", "!", "?", "。", "！", "？")
        if lines:
            rest = text[b0 : b0 + 120].split("\n", 1)[0]
            if _HEADING.match(rest) or (lines > 1 and rest.isupper() and len(rest) < 100):
                kinds.append(HEADING)
            elif lines > 1:
                kinds.append(PARAGRAPH)
            elif ended or not rest[:1].islower():
                kinds.append(LINE)
            else:
                kinds.append(WORD)  # a wrapped line, within a sentence
        else:
            kinds.append(SENTENCE if ended and not text[b0].islower() else WORD)
    return kinds


def landmarks(words: list[str]) -> list[int]:
    """Rolling hash of the ``WINDOW`` words up to each boundary."""
    mask, base = (1 << 61) - 1, 1_000_003
    lead = pow(base, WINDOW, mask)
    own = [zlib.crc32(w.encode("utf-8")) + 1 for w in words]
    found, h = [0], 0
    for i, x in enumerate(own):
        h = (h * base + x) % mask
        if i >= WINDOW:
            h = (h - own[i - WINDOW] * lead) % mask
        found.append((h * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return found


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces as (first word, word after the last, first character, character after the last, kind of the cut before)."""
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if n <= limit:
        return []
    overlap = max(0, min(overlap, limit - 1))
    least = min(limit, max(overlap + 1, int(limit * LEAST)))
    kinds = boundary_kinds(text, spans)
    marks = landmarks([text[a:b] for a, b in spans])
    pieces, start, kind = [], 0, PARAGRAPH
    while True:
        if n - start <= limit:
            pieces.append((start, n, spans[start][0], spans[n - 1][1], kind))
            return pieces
        low, high = start + least, min(start + limit, n - 1)
        window = range(low, high + 1)
        mark = min(window, key=marks.__getitem__)
        best = max(kinds[i] for i in window)
        end = mark if best == WORD else min((i for i in window if kinds[i] == best), key=lambda i: (abs(i - mark), i))
        pieces.append((start, end, spans[start][0], spans[end - 1][1], kind))
        start, kind = end - overlap, kinds[end]


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["item_key", "strategy", "item", "piece_no", "n_pieces", "first_word", "end_word", "cut", "text", "max_words"]
    for batch in batches:
        rows: list[tuple] = []
        for key, strategy, item, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
            found = cuts(text, limit, overlap)
            rows += [(key, strategy, item, k, len(found), a, b, NAMES[kind], text[x:y], limit) for k, (a, b, x, y, kind) in enumerate(found)]
        types = [batch.schema.field(0).type, pa.string(), pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.int32()]
        columns = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def split_oversized(df: DataFrame, limits: DataFrame, key: str, text: str, strategy: str = "strategy") -> DataFrame:
    """Pieces of every item of ``df`` that exceeds the ``max_words`` of its strategy in ``limits``.

    ``limits`` has (strategy, max_words, overlap_words). Result: item_key, strategy, item,
    piece_no, n_pieces, first_word, end_word, cut (kind of boundary before the piece), text,
    max_words. A count of separators, done in the JVM, spares Python the items that cannot
    be too long; only those left are exchanged once to drop repeated rows.
    """
    own = df.select(df[key].alias("item_key"), df[strategy].alias("strategy"), df[text].alias("item_text"))
    bound = limits.select("strategy", F.col("max_words").cast("int").alias("max_words"), F.coalesce(F.col("overlap_words").cast("int"), F.lit(0)).alias("overlap_words")).where("max_words > 0")
    separators = sum((F.octet_length("item_text") - F.octet_length(F.replace("item_text", F.lit(c), F.lit(""))) for c in " \t\r\n"), F.lit(0))
    return (
        own.join(bound, "strategy")
        .where((F.octet_length("item_text") > F.col("max_words")) & (separators >= F.col("max_words")))
        .withColumn("item", F.xxhash64("item_text"))
        .dropDuplicates(["item_key", "strategy", "item"])
        .select("item_key", "strategy", "item", "item_text", "max_words", "overlap_words")
        .mapInArrow(
            _split_batches,
            f"item_key {df.schema[key].dataType.simpleString()}, strategy string, item bigint, piece_no int, n_pieces int, first_word int, end_word int, cut string, text string, max_words int",
        )
    )
