"""Per-document text statistics and their robust Mahalanobis distance from prose.

Statistics are computed from the text without tags and entities (own word and
character counts from the text as it is): word count, mean word length, symbol ratio,
share of lines that end in punctuation and share of common words. The language of a text
is the one whose common words are most frequent in it.

For each language, mean and covariance of prose are found from all its rows: beginning
with the rows near the median share of common words in their language, fit and membership alternate until
they settle, so that lists and junk do not enter the fit. Every round is one aggregation
of sums, whatever the number of rows. The distance of a row is split exactly into the
contributions of its statistics.

A text in which common words of no language make up ``LEAST_COMMON`` has language "und".

Defined results: null, empty and blank texts have counts of 0, null ratios, a null
distance and are neither prose nor outliers; a text of nothing but markup counts as one
without common words. A language with fewer than ``LEAST_ROWS`` rows uses the fit over
all rows, and a table with fewer than that uses ``DEFAULT_FIT``. Repeated rows each
count. Only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statistics of the distance: logarithms make them near to normal in prose.
FEATURES = ["f_words", "f_length", "f_symbols", "f_ends", "f_common"]
CONTRIBUTIONS = ["by_words", "by_length", "by_symbols", "by_line_ends", "by_common"]
#: Share of common words below which no language is told ("und"); such rows are judged by the fit over all languages and enter none.
LEAST_COMMON = 0.12
#: Rows that a fit of its own needs.
LEAST_ROWS = 60
#: Squared radius within which a row counts as prose during the fit, and beyond which it is no prose.
FIT_RADIUS, OUTLIER_RADIUS = 6.0, 9.5
#: Rounds of the fit at most, and the share of rows that may still move when it ends.
ROUNDS, SETTLED = 8, 0.001
#: Mean and standard deviation of plain English prose, for tables too small for a fit.
DEFAULT_FIT = ([5.6, 1.57, -3.78, 0.54, 0.41], [0.38, 0.036, 0.26, 0.36, 0.041])

# Common words of each language; single letters are left out, for they label figures too.
COMMON = {
    "en": "about above after again all also although among an and any are as at be because been before being between both but by can could did do does during each every few for from had has have he her his how if in into is it its may might more most must no nor not of on once only or other our own said same shall she should so some such than that the their them then there these they this those though through to too under until upon us very was we were what when where which while who whom whose will with would yet you your",
    "de": "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer eines für haben hat ich im in ist kann mit nach nicht noch oder sein sich sie sind und vom von vor war wenn wie wird zu zum zur",
    "fr": "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa sans se ses son sont sur un une vous",
    "es": "al como con de del el en es esta este la las lo los más no para pero por que se sin sobre su sus también un una",
    "pt": "ao aos as com como da das de do dos em entre mais mas na nas no não nos os ou para pela pelo por que se sem seu sua também um uma",
    "pl": "ale bez być co dla do go ich jak jest jeżeli już ma na nie od oraz po przed przez przy się są tak tego to wśród za że",
    "ru": "без был была было во вы для до его ее если же за из или их как на не но от по при со так то что это",
}
_MARKUP = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]{0,200}>|&lt;/?[A-Za-z].{0,200}?&gt;|&#?\w{1,10};", re.S)
_SYMBOL = re.compile(r"[^\w\s]|_")
_ENDS = tuple(".!?;:,\"”’)…。")
#: Languages that a token is common in, kept for so many tokens of a task.
CACHE_TOKENS = 200_000


class _Reader:
    """Statistics of one text after another; remembers which tokens are common words."""

    def __init__(self) -> None:
        self.languages: dict[str, list[int]] = {}
        for i, words in enumerate(COMMON.values()):
            for w in words.split():
                self.languages.setdefault(w, []).append(i)
        self.known: dict[str, list[int]] = {}

    def statistics(self, text: str | None) -> tuple:
        raw = (text or "").split()
        if not raw:
            return (0, len(text or ""), *[None] * 10)
        clean = _MARKUP.sub(" ", text) if "<" in text or "&" in text else text
        words = raw if clean is text else clean.split()
        counts = [0] * len(COMMON)
        known = self.known
        if len(known) > CACHE_TOKENS:
            known.clear()
        for w, n in Counter(words).items():
            at = known.get(w)
            if at is None:
                at = known[w] = self.languages.get(w.lower().strip(string.punctuation + "“”‘’«»…—–"), [])
            for i in at:
                counts[i] += n
        n = max(len(words), 1)
        solid = sum(map(len, words))
        symbols = len(_SYMBOL.findall(clean))
        lines = [x for x in map(str.strip, clean.splitlines()) if x]
        ends = sum(x.endswith(_ENDS) for x in lines) / len(lines) if lines else 0.0
        most = max(counts)
        size = max(len(clean), 1)
        common = most / n
        return (
            len(raw), len(text), solid / n, symbols / size, ends, common, list(COMMON)[counts.index(most)] if common >= LEAST_COMMON else "und",
            math.log(n), math.log(max(solid, 1) / n), math.log((symbols + 1) / size), ends, common,
        )


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    for batch in batches:
        rows = [reader.statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        columns = list(zip(*rows)) or [[]] * len(_COLUMNS)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *(pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, _COLUMNS))],
            [*batch.schema.names[:-1], *(name for name, _ in _COLUMNS)],
        )


_ARROW = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
_COLUMNS = [
    ("own_words", "int"), ("own_chars", "int"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("line_end_ratio", "double"),
    ("common_ratio", "double"), ("language", "string"), *((a, "double") for a in FEATURES),
]


def text_statistics(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with own_words, own_chars, mean_word_length, symbol_ratio, line_end_ratio, common_ratio, language and FEATURES.

    Made in Arrow batches: the same statistics by higher-order functions of the JVM took
    four times the CPU, as those are interpreted for each word.
    """
    kinds = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *(f"{a} {b}" for a, b in _COLUMNS)])
    return df.select(*keys, df[text].alias("_text")).mapInArrow(_batches, kinds)


def _moments(inside: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of the rows, for each language and for all under ''."""
    k = len(FEATURES)
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(FEATURES)]
    cross = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    rows = inside.rollup("language").agg(F.count("*").alias("n"), *sums, *cross).collect()  # a row for each language
    found = {}
    for r in rows:
        if r["n"]:
            mean = np.array([r[f"s{i}"] for i in range(k)]) / r["n"]
            second = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / r["n"]
            found[r["language"] or ""] = (r["n"], mean, second - np.outer(mean, mean) + np.eye(k) * 1e-6)
    return found


def _with_default(fits: dict) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    mean, sd = map(np.array, DEFAULT_FIT)
    pooled = fits.get("")
    base = (pooled[1], pooled[2]) if pooled and pooled[0] >= LEAST_ROWS else (mean, np.diag(sd**2))
    return {x: (fits[x][1], fits[x][2]) if x in fits and fits[x][0] >= LEAST_ROWS else base for x in [*COMMON, "und"]}


def _parts(stats: DataFrame, fits: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``stats`` with CONTRIBUTIONS: the share of each statistic in the squared distance from the prose of its language.

    The fits are one literal map from language to numbers, so plans stay small.
    """
    k = len(FEATURES)
    entries: list[Column] = []
    for lang, (mean, cov) in fits.items():
        entries += [F.lit(lang), F.array(*[F.lit(float(v)) for v in (*mean, *np.linalg.inv(cov).ravel())])]
    own = stats.withColumn("_fit", F.element_at(F.create_map(*entries), F.col("language")))
    at = lambda i: F.get("_fit", F.lit(i))
    own = own.withColumns({f"_d{i}": F.col(a) - at(i) for i, a in enumerate(FEATURES)})
    parts = {c: F.col(f"_d{i}") * reduce(lambda x, y: x + y, [F.col(f"_d{j}") * at(k + i * k + j) for j in range(k)]) for i, c in enumerate(CONTRIBUTIONS)}
    return own.withColumns(parts).drop("_fit", *[f"_d{i}" for i in range(k)])


def _squared() -> Column:
    return F.greatest(reduce(lambda x, y: x + y, [F.col(c) for c in CONTRIBUTIONS]), F.lit(0.0))


def fit_prose(stats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of prose for each language, from all rows of ``stats``."""
    usable = stats.where("language != 'und'")
    # Median and spread of each language; those of few rows take the ones over all.
    half = F.percentile_approx("f_common", 0.5, 1000)
    middles = {r["language"]: r["m"] for r in usable.rollup("language").agg(half.alias("m"), F.count("*").alias("n")).where(F.col("n") >= F.when(F.col("language").isNull(), 1).otherwise(LEAST_ROWS)).collect()}  # a row for each language
    if not middles:
        return _with_default({})
    chosen = lambda found: F.coalesce(*[F.when(F.col("language") == x, F.lit(v)) for x, v in found.items() if x is not None], F.lit(found[None]))
    off = F.abs(F.col("f_common") - chosen(middles))
    spreads = {r["language"]: max(r["m"], 0.01) for r in usable.withColumn("_off", off).rollup("language").agg(F.percentile_approx("_off", 0.5, 1000).alias("m")).collect() if r["language"] is None or r["language"] in middles}
    inside = usable.where(off <= 9 * chosen(spreads))
    before = 0
    for _ in range(ROUNDS):
        found = _moments(inside)
        rows = found[""][0] if "" in found else 0
        if abs(rows - before) <= SETTLED * rows:
            break
        before, inside = rows, _parts(usable, _with_default(found)).where(_squared() < FIT_RADIUS**2)
    return _with_default(found)


def prose_distance(stats: DataFrame, fits: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``stats`` with distance, is_prose and the contribution of each statistic to the squared distance."""
    scored = _parts(stats, fits).withColumn("distance", F.when(F.col("language").isNotNull(), F.sqrt(_squared())))
    return scored.withColumn("is_prose", F.col("distance") <= OUTLIER_RADIUS).drop(*FEATURES)
