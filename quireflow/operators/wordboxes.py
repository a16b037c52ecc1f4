"""Words with boxes: reading order, figure labels, furniture, texts of regions; detections scored by page.

Words are (page, idx, text, x0, y0, x1, y1). A page holds few words, so loops that depend on
the word before run over the list of one page, many pages to a batch. Words with a null
text or box take part in nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.operators.geometry import BOX, _by_page, _listed, matched, prefixed

# The forms of a figure label, alone, with its number and the number; separators; the last number of the series.
LABEL = r"(?i)^f[il1]gs?[.,]?$"
LABEL_NUMBER = r"(?i)^f[il1]gs?[.,]\s*(\d{1,3})[.,;:]?$"
NUMBER = r"^(\d{1,3})[.,;:]?$"
SEPARATOR = r"^[.,;:\-—–]+$"
LAST_NUMBER = 289


def _solid(words: DataFrame) -> DataFrame:
    return words.where(" AND ".join(f"{c} IS NOT NULL" for c in ("text", *BOX)))


def _lines(words: list[tuple], tolerance: float) -> list[tuple]:
    """(idx, line, place) of (y0, x0, idx): a word begins a line when it lies further than ``tolerance`` below the first word of the line."""
    out, line, first, members = [], 0, None, []

    def close() -> None:
        out.extend((idx, line, k) for k, (_, _, idx) in enumerate(sorted(members, key=lambda w: (w[1], w[2]))))

    for w in sorted(words):
        if first is not None and w[0] - first > tolerance:
            close()
            line, members, first = line + 1, [], None
        first = w[0] if first is None else first
        members.append(w)
    close()
    return out


def reading_order(words: DataFrame, tolerance: float, page: str = "page", idx: str = "idx") -> DataFrame:
    """(page, idx, line, place): lines from top to bottom, words from left to right; the first word of a line is its anchor."""
    kind = words.schema[idx].dataType.simpleString()
    listed = _listed(_solid(words), page, ["y0", "x0", idx], "words")
    return _by_page(listed, lambda w: _lines(w, tolerance), page, [(idx, kind), ("line", "int"), ("place", "int")])


def figure_labels(words: DataFrame, tolerance: float, page: str = "page", idx: str = "idx") -> DataFrame:
    """(page, number, x0..y1): labels in reading order, glued to their number or up to three words before it, separators between."""
    ordered = reading_order(words, tolerance, page, idx).join(_solid(words), [page, idx])
    listed = ordered.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("line", "place", "text", *BOX))).alias("w"))  # words of one page
    at = F.posexplode("w").alias("i", "a")
    own = listed.select(page, "w", at)
    # Of the three words after it, the first that is no separator.
    after = F.get(F.filter(F.slice("w", F.col("i") + 2, 3), lambda x: ~x["text"].rlike(SEPARATOR)), 0)
    glued = F.col("a.text").rlike(LABEL_NUMBER)
    own = own.select(page, "a", F.when(glued, F.col("a")).when(F.col("a.text").rlike(LABEL), after).alias("b"), glued.alias("glued"))
    number = F.when(F.col("glued"), F.regexp_extract("a.text", LABEL_NUMBER, 1)).otherwise(F.regexp_extract("b.text", NUMBER, 1)).try_cast("int")
    box = [F.least("a.x0", "b.x0").alias("x0"), F.least("a.y0", "b.y0").alias("y0"), F.greatest("a.x1", "b.x1").alias("x1"), F.greatest("a.y1", "b.y1").alias("y1")]
    return own.where("b IS NOT NULL").select(page, number.alias("number"), *box).where(F.col("number").between(1, LAST_NUMBER))


def furniture(blocks: DataFrame, height: float, band: float = 0.11, page: str = "page", idx: str = "idx") -> DataFrame:
    """(page, printed_page, running_head): the longest number of the top band, or else of the bottom band; the text of the top band without numbers."""
    top, bottom = F.col("y0") < band * height, F.col("y1") > (1 - band) * height
    text = lambda when: F.coalesce(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct(idx, F.btrim("text").alias("t"))))), lambda x: x["t"]), " "), F.lit(""))
    own = _solid(blocks).where(F.btrim("text") != "").groupBy(page).agg(text(top).alias("top"), text(~top & bottom).alias("bottom"))
    first = lambda c: F.regexp_extract_all(c, F.lit(r"\b(\d{1,4})\b"), 1)
    longest = lambda c: F.aggregate(first(c), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    head = F.btrim(F.regexp_replace(F.regexp_replace("top", r"\b\d{1,4}\b", " "), r"\s+", " "))
    return own.select(page, F.coalesce(F.nullif(longest("top"), F.lit("")), longest("bottom")).alias("printed_page"), head.alias("running_head"))


def region_texts(words: DataFrame, regions: DataFrame, page: str = "page", idx: str = "idx") -> DataFrame:
    """(page, r_idx, text): all words whose centre lies in a region, in order of idx; a word may be in several. Empty regions have an empty text."""
    w = _solid(words).select(page, F.col(idx).alias("w_idx"), "text", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    r = prefixed(regions, "r_", page)
    inside = F.col("cx").between(F.col("r_x0"), F.col("r_x1")) & F.col("cy").between(F.col("r_y0"), F.col("r_y1"))
    found = r.join(w, page).where(inside).groupBy(page, f"r_{idx}").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("w_idx", "text"))), lambda x: x["text"]), " ").alias("text"))
    return r.select(page, f"r_{idx}").join(found, [page, f"r_{idx}"], "left").select(page, f"r_{idx}", F.coalesce("text", F.lit("")).alias("text"))


def _bound(figures: list[tuple], captions: list[tuple], most: float) -> list[tuple]:
    free, out = list(captions), []
    for f in figures:
        near = []
        for c in free:
            if min(f[3], c[3]) - max(f[1], c[1]) > 0:
                gap = c[2] - f[4] if c[2] >= f[4] else f[2] - c[4]
                if 0 <= gap < most:
                    near.append((gap, c[0], c))
        if near:
            gap, at, c = min(near)
            free.remove(c)
            out.append((f[0], at, gap))
    return out


def bind_captions(figures: DataFrame, captions: DataFrame, most: float, page: str = "page", idx: str = "idx") -> DataFrame:
    """(page, f_idx, c_idx, gap): figures in order of idx take the nearest free caption above or below; each caption serves one figure."""
    kind, value = figures.schema[idx].dataType.simpleString(), figures.schema["x0"].dataType.simpleString()
    pages = _listed(figures, page, [idx, *BOX], "a").join(_listed(captions, page, [idx, *BOX], "b"), page).select(page, "a", "b")
    return _by_page(pages, lambda a, b: _bound(a, b, most), page, [(f"f_{idx}", kind), (f"c_{idx}", kind), ("gap", value)])


def _left_of(regions: list[tuple], figures: list[tuple]) -> list[tuple]:
    out = []
    for idx, *box in regions:
        rest = [tuple(box)]
        for f in figures:
            cut = []
            for b in rest:
                x0, y0, x1, y1 = max(b[0], f[1]), max(b[1], f[2]), min(b[2], f[3]), min(b[3], f[4])
                if x0 >= x1 or y0 >= y1:
                    cut.append(b)
                else:
                    pieces = [(b[0], b[1], b[2], y0), (b[0], y1, b[2], b[3]), (b[0], y0, x0, y1), (x1, y0, b[2], y1)]
                    cut += [p for p in pieces if p[2] > p[0] and p[3] > p[1]]
            rest = cut
        out += [(idx, *p) for p in rest]
    return out


def without_figures(regions: DataFrame, figures: DataFrame, page: str = "page", idx: str = "idx") -> DataFrame:
    """(page, idx, x0..y1): what is left of each region when every figure of its page is cut out, one after another."""
    kind, value = regions.schema[idx].dataType.simpleString(), regions.schema["x0"].dataType.simpleString()
    pages = _listed(regions, page, [idx, *BOX], "a").join(_listed(figures, page, [idx, *BOX], "b"), page, "left").select(page, "a", "b")
    return _by_page(pages, _left_of, page, [(idx, kind), *((c, value) for c in BOX)])


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; 0 where there is no base."""
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return [share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1")]


def detection_scores(found: DataFrame, truth: DataFrame, least: float = 0.5, page: str = "page", idx: str = "idx") -> DataFrame:
    """(tp, fp, fn, precision, recall, f1, mean_iou) over all pages; boxes are matched one to one within their page, the best IoU first."""
    pages = _listed(found, page, [idx, *BOX], "a").join(_listed(truth, page, [idx, *BOX], "b"), page, "full").select(page, "a", "b")
    counted = _by_page(pages, lambda a, b: _counts(a, b, least), page, [("tp", "int"), ("fp", "int"), ("fn", "int"), ("ious", "double")])
    sums = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.coalesce(F.sum("ious"), F.lit(0.0)).alias("ious"))
    return sums.select("tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")), F.coalesce(F.col("ious") / F.nullif("tp", F.lit(0)), F.lit(0.0)).alias("mean_iou"))


def _counts(a: list[tuple], b: list[tuple], least: float) -> list[tuple]:
    pairs = matched(a, b, least, False)
    return [(len(pairs), len(a) - len(pairs), len(b) - len(pairs), float(sum(v for *_, v in pairs)))]


def page_presence(found: DataFrame, truth: DataFrame, page: str = "page") -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of whether a page has a box at all."""
    both = found.select(page).distinct().withColumn("f", F.lit(True)).join(truth.select(page).distinct().withColumn("t", F.lit(True)), page, "full")
    sums = both.agg(F.count_if(F.col("f") & F.col("t")).alias("tp"), F.count_if(F.col("f") & F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull() & F.col("t")).alias("fn"))
    return sums.select("tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))
