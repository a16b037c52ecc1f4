"""Text functions as columns; those marked Arrow need what the JVM functions lack."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it, spelled out so that every regex engine reads it alike.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
IMAGE = r"!\[([^\]]*)\]\(([^)]*\.webp)\)"
TAG = r"<[^>]+>"
#: Punctuation that stands without a blank before it.
CLOSING = r"[.,;:!?)\]}%…]"
#: Fixed values of the header rule of paragraph-aware chunking.
HEADER = r"^[A-Z0-9\s,\.\-\(\)]{4,60}$"


def words(c: Column | str) -> Column:
    """Words between white space; an empty array for null and blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WS), lambda w: w != "")


def squeeze(c: Column | str) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.btrim(F.regexp_replace(c, WS, " "))


def strip_markup(c: Column | str) -> Column:
    """Image references to their description, tags to blanks, white space collapsed."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, IMAGE, "$1"), TAG, " "))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Character entities to characters. Arrow."""
    return s.map(html.unescape, na_action="ignore")


def clean_markdown(c: Column | str) -> Column:
    """Plain text of Markdown for embedding: descriptions kept, tags dropped, entities read."""
    return squeeze(unescape(F.regexp_replace(F.regexp_replace(c, IMAGE, "$1"), TAG, " ")))


def images(c: Column | str) -> Column:
    """Array of (caption, webp) of the image references."""
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(IMAGE), 1).alias("caption"), F.regexp_extract_all(c, F.lit(IMAGE), 2).alias("webp"))
    return F.transform(pairs, lambda p: F.struct(F.btrim(p["caption"]).alias("caption"), F.btrim(p["webp"]).alias("webp")))


_NOT_WORD = re.compile(r"[^\w]|_", re.UNICODE)


@F.pandas_udf(StringType())
def score_form(s: pd.Series) -> pd.Series:
    """Canonical form for scoring: entities, tags, NFKC, casefold, letters and digits only. Arrow."""

    def one(t: str) -> str:
        t = unicodedata.normalize("NFKC", re.sub(r"<[^>]+>", " ", html.unescape(t))).casefold()
        return " ".join(_NOT_WORD.sub(" ", t).split())

    return s.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition. Arrow."""
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def ligatures(c: Column | str) -> Column:
    """Ligatures spelled out, white space collapsed."""
    out = squeeze(c)
    for sign, letters in (("æ", "ae"), ("œ", "oe"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        out = F.replace(out, F.lit(sign), F.lit(letters))
    return out


def historical(c: Column | str) -> Column:
    """Reading form of old print: compatibility forms, long s, plain quotes and dashes, joined line breaks."""
    out = F.translate(nfkc(c), "ſ‘’“”–—", "s''\"\"--")
    for sign, letters in (("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")):
        out = F.replace(out, F.lit(sign), F.lit(letters))
    out = F.regexp_replace(out, r"(\p{L})[-\x{AD}]\n[ \t]*(\p{Ll})", "$1$2")
    out = F.regexp_replace(out, r"(?<!\n)\n(?!\n)", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"[ \t]+", " "), F.lit(" \t\r\n\f"))


def drop_grounding(c: Column | str) -> Column:
    """Detection boxes out, reference marks unwrapped."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<\|det\|>.*?<\|/det\|>", ""), r"<\|/?ref\|>", "")


def join_tokens(tokens: Column | str) -> Column:
    """Tokens with blanks between, but none before closing punctuation."""
    return F.regexp_replace(F.array_join(tokens, " "), f" ({CLOSING})(?= |$)", "$1")


def latin_share(c: Column | str) -> Column:
    """Share of ASCII letters among letters."""
    return F.regexp_count(c, F.lit(r"[A-Za-z]")) / F.greatest(F.lit(1), F.regexp_count(c, F.lit(r"\p{L}")))


def figure_number(c: Column | str) -> Column:
    """Number of the first figure label, misread forms of the word included."""
    return F.nullif(F.regexp_extract(c, r"(?i)\bF[i1l]g[.,]?\s*(\d{1,4})", 1), F.lit("")).try_cast("int")


def roman(c: Column | str) -> Column:
    """Value of a roman numeral, null for anything else."""
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    digit = lambda x: F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in value.items()], F.lit(0))
    digits = F.transform(F.filter(F.split(F.lower(c), ""), lambda x: x != ""), lambda x: digit(x))
    total = F.aggregate(
        F.reverse(digits),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, x: F.struct((a["sum"] + F.when(x < a["last"], -x).otherwise(x)).alias("sum"), x.alias("last")),
        lambda a: a["sum"],
    )
    return F.when(F.lower(c).rlike(r"^(?=[ivxlc])c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"), total)


def page_id(number: Column | str) -> Column:
    """Page id of a one-based page number."""
    return F.format_string("p%04d", number)


def json_object(c: Column | str) -> Column:
    """The JSON object in a model's answer: fences off, else the outermost braces; null if there is none."""
    bare = F.regexp_replace(F.btrim(c), r"^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


#: Layout labels and the kind of region they stand for.
REGION_KINDS = {"text": "text", "paragraph": "text", "list": "text", "table": "table", "figure": "figure", "image": "figure", "picture": "figure", "chart": "figure", "title": "heading", "section-header": "heading", "heading": "heading"}


def region_kind(c: Column | str, default: str = "text") -> Column:
    """Kind of a layout label."""
    label = F.lower(c)
    return F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in REGION_KINDS.items()], F.lit(default))


#: Personal data by kind, in the order of redaction.
PERSONAL = {"EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "PHONE": r"\+?[0-9][0-9 ()-]{7,}[0-9]"}


def redact(c: Column | str) -> Column:
    """Personal data replaced by its kind (our design)."""
    out = c
    for kind, pattern in PERSONAL.items():
        out = F.regexp_replace(out, pattern, f"[{kind}]")
    return out


@F.pandas_udf(StringType())
def category_form(s: pd.Series) -> pd.Series:
    """Letters and digits of any script after compatibility composition and casefolding, other signs to blanks; entities and tags stay as text. Arrow."""

    def one(t: str) -> str:
        t = unicodedata.normalize("NFKC", t).casefold()
        return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t).split())

    return s.map(one, na_action="ignore")


#: Parts of names of block types that are figures.
FIGURE_HINTS = ("figure", "image", "chart", "picture", "graphic")


def is_figure(kind: Column | str) -> Column:
    """Whether the type of a block names a figure."""
    return F.coalesce(F.lower(kind).rlike("|".join(FIGURE_HINTS)), F.lit(False))


def label_number(label: Column | str) -> Column:
    """Number that is the last word of a label, if it is one."""
    return F.element_at(F.split(F.btrim(label), r"\s+"), -1).try_cast("int")


def string_list(values: Column | str) -> Column:
    """Strings with white space collapsed, empty and null ones left out."""
    return F.filter(F.transform(values, squeeze), lambda x: x.isNotNull() & (x != ""))


def guess_numbers(c: Column | str) -> Column:
    """Page numbers that the first or last three lines may hold, in order: up to four digits, or roman numerals up to 200."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    band = F.concat(F.slice(lines, 1, 3), F.slice(F.reverse(lines), 1, 3))
    own = F.flatten(F.transform(band, lambda x: F.split(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "), " ")))
    value = lambda w: F.when(w.rlike("^[0-9]{1,4}$"), w.try_cast("int")).when(w.rlike("^(?i)[ivxlc]{1,8}$") & (roman(w) <= 200), roman(w))
    return F.array_sort(F.array_distinct(F.filter(F.transform(own, value), lambda n: n.isNotNull())))


def personal_spans(c: Column | str, kind: str) -> Column:
    """Spans (start, end, value) of personal data of a kind, counted from 0, in order; null texts have none."""
    text = F.col(c) if isinstance(c, str) else c
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(a: Column, v: Column) -> Column:
        at = F.position(v, text, a["pos"])
        span = F.struct((at - 1).alias("start"), (at - 1 + F.length(v)).alias("end"), v.alias("value"))
        return F.struct((at + F.length(v)).alias("pos"), F.concat(a["out"], F.array(span)).alias("out"))

    found = F.coalesce(F.regexp_extract_all(text, F.lit(PERSONAL[kind]), 0), F.array().cast("array<string>"))
    return F.aggregate(found, F.struct(F.lit(1).alias("pos"), none.alias("out")), add, lambda a: a["out"])
