"""Repair of text from scanned pages: anagram-hash corrections, edge lines and hyphens.

1. Words are counted over distinct texts of a book, and over all rows.
2. Rare words are joined with much more frequent confusable words in SQL, however frequent
   these are in the corpus. The anagram hash of a word is the sum of a power of its code
   points: a confusion changes it by a known difference, so words one confusion apart meet
   in a hash join. The differences are those of the fixed confusions of several letters, and
   for single letters the hash without one letter. Verified candidates are ranked by likelihood
   and by the frequency of the word. Rare words that are a word with a stray sign in it, or
   two words run together, are found by joins on the same words. What is left is tried with
   two errors: confusions on both sides of a place where words ran together, or two in one word.
3. Lines at the edges of rows (the first and last two), without numbers and signs, that
   recur in a book are its running heads; their first word and the words of heads lead to
   heads elsewhere in the text.
4. Each row is read once more against the lexicon, the words that make up at least
   ``LEXICON_SHARE`` of the text (so never more than ``1 / LEXICON_SHARE``): words broken over a
   line end (joined where the whole word is known and the compound with a hyphen is not), words
   torn apart, page numbers on lines at the edges or alone between two sentences, and heads.

Defined results: null and blank texts are unchanged and hold no noise. Markup is set aside
before words are read. A text under many rows makes no word frequent or rare by itself: a
word is much rarer than another if it is in distinct texts, or in rows while distinct texts
do not say the reverse. Tokens beyond
``LONGEST`` characters are no words and are kept as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm import markup
from quireflow.runtime import materialize

#: Least share of all words that puts a word into the lexicon of the readers (100,000 words at most), and how often it must stand to be evidence.
LEXICON_SHARE, LEXICON_LEAST = 1e-5, 10
LONGEST = 64
#: Lines on either side of a text that are its edge, and the share of the texts of a book that a head stands in.
EDGE_LINES, HEAD_SHARE = 2, 0.02
#: Most a variant may stand for each time its word does: for likely confusions, for any letter, for words run together.
LIKELY, ANY, TOGETHER = 0.08, 0.01, 0.01
#: Tokens remembered in a task.
CACHE_TOKENS = 200_000
#: Length from which any listed confusion may stand beside a second error.
LONG_TOKEN = 8
#: How many times as often as its rarest fragment a word must stand to be put together, and fragments at most.
TORN_TIMES, FRAGMENTS = 50, 16
#: Share of all words from which a word is common, so that nothing is looked for beside it.
COMMON_SHARE = 1e-4
#: Evidence (as a logarithm of odds) that a variant stands by itself more often than noise does, from which it is a word of its own.
OWN_EVIDENCE = 4.6

# Confusions of scanning, as read and as printed.
SINGLE = "ce ec bh hb un nu if fi li il tl lt qg gq oc co ji ij 0o 1l 1i 5s 8b @a !i !l |l |i ſs sſ ao oa vy yv rt".split()
SEVERAL = "rn>m m>rn cl>d d>cl li>h h>li vv>w w>vv ii>n ii>u in>m ni>m lc>k rl>d iii>m tl>d ri>n nn>m ll>u".split()

#: Words that begin headings of parts, which are no running heads.
PARTS = set("chapter section part book fig figure plate table appendix index contents preface".split())

_STRIP = ".,;:!?()[]{}\"“”‘’'«»*_`~<>=…-–—\\/#$%&+"
_LETTERS = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_CUT = re.compile(r"(?<=[^\W\d_])(?:[-=¬\xad‐~] ?\n[ \t]*|[¬\xad‐][ \t]?)(?=[^\W\d_])")
_AROUND = re.compile(r"[-\w]*")
_ROMAN = re.compile(r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_NUMBER = re.compile(r"(?:[·\[(|]|[-–—]{1,2})?\s*(?:page|p\.|pag\.|p)?\s*([0-9lOoIi|]{1,5}|[ivxlc]{1,8})\s*(?:[·\])|]|[-–—]{1,2})?", re.I)
_LIGATURE = re.compile(r"[ſﬀ-ﬆ]")
_MAY_CUT = re.compile(r"[-=~] ?\n|[¬­‐]")
_SIGNS = re.compile(r"[^\w'’!|@-]+")
_FRONTS = re.compile(r"[^\W\d_]+")
SWAPS = sorted({(x[0], x[1]) for x in SINGLE} | {tuple(x.split(">")) for x in SEVERAL})
_TAIL, _FRONT = re.compile(r"[^\W\d_]+$"), re.compile(r"[^\W\d_]+")
_TITLE = "\x01"


def plain(text: str) -> str:
    """Text without markup."""
    return markup.convert(text)[0] if markup.QUICK.search(text) else text


def split(text: str) -> list[str]:
    return text.replace("—", " ").replace("/", " ").split()


def token(raw: str) -> str | None:
    """The word of what stands between blanks, if it is one."""
    w = raw.lower().strip(_STRIP)
    return w if w and len(w) <= LONGEST and _LETTERS.search(w) else None


def _head_words(text: str, stem: str) -> list[tuple[int, int, list[str]]]:
    """Runs of capitals that begin with the name of the book: (start, end, words after the name)."""
    found = []
    for m in re.finditer(rf"\b{re.escape(stem)}\b((?:[ \t]+(?:[A-Z][^\s.]*|of|to)){{1,9}})", text) if stem else ():
        found.append((m.start(), m.end(), m.group(1).split()))
    return found


def _stems(name: str | None) -> list[str]:
    """Forms of the first word of the book's head."""
    return [name.capitalize(), name.upper()] if name else []


def edges(text: str) -> set[str]:
    """The first and last ``EDGE_LINES`` lines that are not blank."""
    found, start, end = set(), 0, len(text)
    for _ in range(EDGE_LINES):
        while start < end:
            cut = text.find("\n", start, end)
            line, start = (text[start:cut], cut + 1) if cut >= 0 else (text[start:end], end)
            if line.strip():
                found.add(line)
                break
    for _ in range(EDGE_LINES):
        while start < end:
            cut = text.rfind("\n", start, end)
            line, end = text[cut + 1 if cut >= 0 else start : end], cut if cut >= 0 else start
            if line.strip():
                found.add(line)
                break
    return found


def edge_lines(text: str) -> set[str]:
    """Lines at the edges of a text that may be heads, without numbers and signs."""
    found = set()
    for line in edges(text):
        if len(line) <= 90:
            own = [w for w in _WORD.findall(re.sub(r"\[[^\]]*\]", " ", line)) if not _ROMAN.fullmatch(w)]
            if 2 <= len(own) <= 8 and own[0].lower() not in PARTS and len(own[0]) > 2 and sum(w[0].isupper() for w in own) * 2 > len(own):
                found.add(" ".join(own).lower())
    return found


def _counted(raw: dict[str, list[int]], heads: dict[str, list[int]]) -> pa.RecordBatch:
    counts = {t: list(n) for t, n in heads.items()}
    for r, n in raw.items():
        if (w := token(r)) is not None:
            c = counts.setdefault(w, [0, 0])
            c[0] += n[0]
            c[1] += n[1]
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([n[i] for n in counts.values()], pa.int64()) for i in (0, 1))], ["token", "n", "n_rows"])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once: Counter[str] = Counter()
    more: Counter[str] = Counter()  # what copies add
    heads: dict[str, list[int]] = {}

    def done() -> pa.RecordBatch:
        return _counted({w: [n, n + more[w]] for w, n in once.items()}, heads)

    for batch in batches:
        for doc, text, copies in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if text:
                text = plain(text)
                raws = split(text)
                once.update(raws)
                if copies > 1:
                    for w, n in Counter(raws).items():
                        more[w] += n * (copies - 1)
                if doc is not None:
                    for line in (*edge_lines(text), ""):
                        c = heads.setdefault(f"{_TITLE}{doc}{_TITLE}{line}", [0, 0])
                        c[0] += 1
                        c[1] += copies
        if len(once) > 200_000 or len(heads) > 100_000:
            yield done()
            once.clear()
            more.clear()
            heads.clear()
    yield done()


def count_words(rows: DataFrame) -> DataFrame:
    """(token, n, n_rows) of (doc_id, text): words, and edge lines under their book, over distinct texts of a book and over all rows."""
    texts = rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    return texts.mapInArrow(_count_batches, "token string, n bigint, n_rows bigint").groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))


def book_heads(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, head_word) of the books with a recurring head, and (token, n_title) of the words of heads but the first."""
    lines = vocabulary.where(F.col("token").startswith(_TITLE)).select(F.split("token", _TITLE).alias("x"), "n")
    lines = lines.select(F.col("x")[1].alias("doc_id"), F.col("x")[2].alias("line"), "n")
    texts = lines.where("line = ''").select("doc_id", F.col("n").alias("texts"))
    lines = lines.where("line <> ''").join(texts, "doc_id").where((F.col("n") >= 2) & (F.col("n") >= HEAD_SHARE * F.col("texts")))
    best = lines.groupBy("doc_id").agg(F.max_by("line", F.struct("n", "line")).alias("line"), F.max("n").alias("n"))
    words = best.select("n", F.explode(F.split("line", " ")).alias("token")).where("length(token) > 3")
    first = best.select("doc_id", F.substring_index("line", " ", 1).alias("head_word"))
    names = first.select(F.col("head_word").alias("token")).distinct()
    return first, words.join(names, "token", "left_anti").groupBy("token").agg(F.sum("n").alias("n_title"))


#: Prime that powers of code points are taken by, so that sums never overflow.
PRIME = (1 << 31) - 1


def _value(x: int) -> int:
    return x**3 % PRIME * (x**2 % PRIME) % PRIME


def _fifth(c: Column) -> Column:
    x = F.ascii(c).cast("bigint")
    return (x * x * x % PRIME) * (x * x % PRIME) % PRIME


def _hash(token: Column) -> Column:
    return F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: a + _fifth(c))


def lexicon(vocabulary: DataFrame) -> tuple[DataFrame, int]:
    """Frequent words of letters, over distinct texts or rows, and the number of all words of distinct texts."""
    total = vocabulary.where(~F.col("token").startswith(_TITLE)).agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows")).first()
    often = [F.col(c) >= max(LEXICON_LEAST, LEXICON_SHARE * (total[c] or 0)) for c in ("n", "n_rows")]
    return vocabulary.where((often[0] | often[1]) & F.col("token").rlike(r"^\p{L}+(?:[-'’]\p{L}+)*$")), total["n"] or 0


def _fewer(share: float) -> Column:
    """Whether a token stands for at most this share of the word."""
    return (F.col("n") <= share * F.col("n_word")) | ((F.col("n_rows") <= share * F.col("rows_word")) & (F.col("n") <= F.col("n_word")))


def variants(vocabulary: DataFrame) -> DataFrame:
    """(token, correction, how) of rare words that are variants of words so many times as frequent, the best ranked for each."""
    rare = vocabulary.where(F.col("token").rlike(r"^\S{2,64}$") & ~F.col("token").rlike("^[ivxlc]+$")).withColumn("len", F.length("token")).withColumn("h", _hash(F.col("token")))
    # A word has at least 1 / LIKELY times the rows of its variant, so rarer ones need not be joined.
    words = vocabulary.where(F.col("token").rlike(r"^\p{L}+(?:[-'’]\p{L}+)*$") & (F.length("token") >= 2) & (F.col("n_rows") >= 1 / LIKELY))
    known = words.select(F.col("token").alias("word"), F.col("n").alias("n_word"), F.col("n_rows").alias("rows_word")).withColumn("h_word", _hash(F.col("word")))
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    # One letter for another at the same place: both hashes without that letter agree.
    a = rare.select("token", "n", "n_rows", "len", F.posexplode(letters(F.col("token"))).alias("at", "read"), "h").withColumn("key", F.col("h") - _fifth(F.col("read")))
    b = known.select("word", "n_word", "rows_word", F.length("word").alias("len"), F.posexplode(letters(F.col("word"))).alias("at", "printed"), "h_word").withColumn("key", F.col("h_word") - _fifth(F.col("printed")))
    b = b.withColumnRenamed("len", "len_b").withColumnRenamed("at", "at_b").withColumnRenamed("key", "key_b")
    at = F.col("at")
    same = (F.substring("token", F.lit(1), at) == F.substring("word", F.lit(1), at)) & (F.substring("token", at + 2, F.lit(LONGEST)) == F.substring("word", at + 2, F.lit(LONGEST)))
    likely = F.concat("read", "printed").isin(SINGLE)
    single = (
        a.join(b, (F.col("key") == F.col("key_b")) & (F.col("len") == F.col("len_b")) & (at == F.col("at_b")))
        .where(same & (F.col("read") != F.col("printed")))
        .where((likely & _fewer(LIKELY)) | ((F.col("len") >= 5) & _fewer(ANY)) | ((F.col("len") >= 3) & _fewer(0.1 * ANY)))
        .select("token", "word", "n_word", F.when(likely, 0).otherwise(1).alias("rank"), F.lit("confusion").alias("how"))
    )
    # Several letters for others: the hash differs by a known amount.
    pairs = [x.split(">") for x in SEVERAL]
    listed = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(sum(_value(ord(c)) for c in y) - sum(_value(ord(c)) for c in x)).cast("bigint").alias("d")) for x, y in pairs])
    c = rare.select("token", "n", "n_rows", "len", "h", F.explode(listed).alias("p")).where(F.instr(F.col("token"), F.col("p.x")) > 0)
    replaced = F.exists(
        F.sequence(F.lit(1), F.col("len")),
        lambda i: (F.substring("token", i, F.length("p.x")) == F.col("p.x")) & (F.concat(F.substring("token", F.lit(1), i - 1), F.col("p.y"), F.substring("token", i + F.length("p.x"), F.lit(LONGEST))) == F.col("word")),
    )
    several = (
        c.join(known, F.col("h") + F.col("p.d") == F.col("h_word"))
        .where(replaced & _fewer(LIKELY))
        .select("token", "word", "n_word", F.lit(0).alias("rank"), F.lit("confusion").alias("how"))
    )
    # A stray sign within a frequent word.
    bare = F.regexp_replace("token", r"[^\p{L}'’-]+", "")
    stray = (
        rare.where(F.col("token").rlike(r"[^\p{L}'’0-9-]")).withColumn("bare", bare)
        .join(known, F.col("bare") == F.col("word"))
        .where(_fewer(LIKELY))
        .select("token", "word", "n_word", F.lit(0).alias("rank"), F.lit("sign").alias("how"))
    )
    quoted = (
        rare.where(F.col("token").rlike(r"\p{L}['’-]\p{L}")).withColumn("bare", F.regexp_replace("token", r"['’-]", ""))
        .join(known, F.col("bare") == F.col("word"))
        .where((F.length("bare") >= 3) & _fewer(ANY) & ~F.col("token").rlike(r"['’](?:s|t|d|m|ll|re|ve)$"))
        .select("token", "word", "n_word", F.lit(2).alias("rank"), F.lit("sign").alias("how"))
    )
    apart = single.unionByName(several).unionByName(stray).unionByName(quoted)
    # A word that is itself a variant is no original.
    apart = materialize(apart.groupBy("token", "word").agg(F.min(F.struct("rank", -F.col("n_word"), "how")).alias("b")), "scan-confused")
    confused = apart.select(F.col("token").alias("word")).distinct()
    apart = apart.join(confused, "word", "left_anti").select("token", "word", (-F.col("b.col2")).alias("n_word"), "b.rank", "b.how")
    known = known.join(confused, "word", "left_anti")
    # Two words run together.
    first = known.where("length(word) >= 2 OR word = 'a'").select(F.col("word").alias("w1"), F.col("n_word").alias("n1"), F.col("rows_word").alias("r1"))
    second = known.where("length(word) >= 2 OR word = 'a'").select(F.col("word").alias("w2"), F.col("n_word").alias("n2"), F.col("rows_word").alias("r2"))
    run = (
        rare.where(F.col("token").rlike(r"^\p{L}{4,24}$"))
        .select("token", "n", "n_rows", "len", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("cut"))
        .withColumn("w1", F.substring("token", F.lit(1), F.col("cut")))
        .withColumn("w2", F.substring("token", F.col("cut") + 1, F.lit(LONGEST)))
        .join(first, "w1")
        .join(second, "w2")
        .where(((F.col("n") <= TOGETHER * F.least("n1", "n2")) | ((F.col("n_rows") <= TOGETHER * F.least("r1", "r2")) & (F.col("n") <= F.least("n1", "n2")))) & ((F.length("w1") > 1) | (F.length("w2") >= 4)) & ((F.length("w2") > 1) | (F.length("w1") >= 4)) & (F.length("token") >= 5))
        .select("token", F.concat("w1", F.lit(" "), "w2").alias("word"), F.least("n1", "n2").alias("n_word"), F.lit(3).alias("rank"), F.lit("together").alias("how"))
    )
    return (
        apart.unionByName(run)
        .groupBy("token")
        .agg(F.min_by(F.struct(F.col("word").alias("correction"), "how"), F.struct("rank", -F.col("n_word"), "word")).alias("best"))
        .select("token", "best.correction", "best.how")
    )


class Reader:
    """Finds in one text what needs no count of the corpus beyond the lexicon."""

    def __init__(self, frequent: dict[str, int], titles: set[str]) -> None:
        self.frequent, self.titles = frequent, titles
        least = COMMON_SHARE * sum(frequent.values())
        self.common = {w for w, n in frequent.items() if n >= least}
        self.known: dict[str, tuple[str | None, bool, bool]] = {}
        self.fine: set[str] = set()
        self.ends: dict[str, tuple[str, str, bool]] = {}

    def words(self, raws: list[str]) -> tuple[list[str], set[str], int]:
        """Rare words of a text, the tokens that are no common word, and how many title words stand in capitals.

        Tokens seen before that are neither are taken off at once.
        """
        known, fine = self.known, self.fine
        if len(known) + len(fine) > CACHE_TOKENS:
            known.clear()
            fine.clear()
        rare, odd, capitals = set(), set(), 0
        for raw in set(raws) - fine:
            k = known.get(raw)
            if k is None:
                w = token(raw)
                single = w is not None and len(w) == 1 and w not in "aio"
                k = (w if w is not None and w not in self.frequent and not single else None, single or (w is not None and len(w) > 1 and w not in self.common), w in self.titles and raw[0].isupper())
                if k == (None, False, False):
                    fine.add(raw)
                    continue
                known[raw] = k
            if k[0] is not None:
                rare.add(k[0])
            if k[1]:
                odd.add(raw)
            capitals += k[2]
        return list(rare), odd, capitals

    def cuts(self, text: str) -> list[tuple[int, int, str, str]]:
        """Words broken over a line end: (start, end, joined, with the hyphen kept)."""
        found = []
        for m in _CUT.finditer(text):
            left, right = _TAIL.search(text, max(0, m.start() - LONGEST), m.start()), _FRONT.match(text, m.end())
            a, sign, b = left.group(), m.group()[0], right.group()
            joined, whole = (a + b).lower(), f"{a}-{b}".lower()
            if sign == "-" and joined not in self.frequent:
                around = _AROUND.match(text, right.end()).group()
                if whole in self.frequent or (a.lower() in self.frequent and b.lower() in self.frequent) or b[0].isupper() or around.startswith("-"):
                    continue
                if not b[0].islower():
                    continue
            found.append((left.start(), right.end(), a + b, f"{a}-{b}"))
        return found

    def _whole(self, parts: list[str]) -> list[str] | None:
        """The words that fragments divided by blanks make up: one word, or two divided at another place."""
        n = [self.frequent.get(p, 0) if len(p) > 1 or p in "aio" else 0 for p in parts]
        joined = "".join(parts)
        whole = self.frequent.get(joined, 0)
        if whole and len(joined) >= 3 and TORN_TIMES * min(n) <= whole:
            return [joined]
        if len(parts) == 2:
            for cut in range(max(1, len(parts[0]) - 3), min(len(joined), len(parts[0]) + 4)):
                a, b = joined[:cut], joined[cut:]
                if cut != len(parts[0]) and all(len(x) > 1 or x in "aio" for x in (a, b)) and len(joined) >= 5 and min(self.frequent.get(a, 0), self.frequent.get(b, 0)) >= max(1, TORN_TIMES * min(n)) and max(len(a), len(b)) >= 3:
                    if min(n) == 0 or TORN_TIMES * max(n) <= max(self.frequent[a], self.frequent[b]):
                        return [a, b]
        return None

    def torn(self, text: str) -> list[tuple[int, int, str]]:
        """Words torn apart by blanks, or divided at the wrong place: (start, end, words)."""
        found = []
        words = [(m.start(), m.end(), m.group().lower()) for m in _FRONTS.finditer(text)]
        i = 0
        while i < len(words):
            j = i
            while j + 1 < len(words) and j - i + 1 < FRAGMENTS and words[j + 1][0] - words[j][1] == 1 and text[words[j][1]] in " \n":
                j += 1
            for k in range(j, i, -1):
                own = [w for _, _, w in words[i : k + 1]]
                if k > i + 1 and sum(map(len, own)) > 24:
                    continue
                if all(w in self.common and len(w) > 1 for w in own):
                    continue
                whole = self._whole(own)
                if whole is not None:
                    s, e = words[i][0], words[k][1]
                    plain_ = "".join(text[a:b] for a, b, _ in words[i : k + 1])
                    found.append((s, e, plain_ if len(whole) == 1 else f"{plain_[: len(whole[0])]} {plain_[len(whole[0]) :]}"))
                    i = k
                    break
            i += 1
        return found

    def _ends(self, raw: str) -> tuple[str, str, bool]:
        """Letters that a token begins and ends with, and whether it is a lone letter; remembered."""
        e = self.ends.get(raw)
        if e is None:
            if len(self.ends) > CACHE_TOKENS:
                self.ends.clear()
            front, tail = _FRONT.match(raw), _TAIL.search(raw)
            e = self.ends[raw] = (front.group().lower() if front else "", tail.group().lower() if tail else "", len(raw) == 1 and raw.isalpha())
        return e

    def _maybe(self, a: str, b: str, shift: bool) -> bool:
        """Whether two neighbours may make up another word, or with ``shift`` two words divided elsewhere."""
        joined, frequent = a + b, self.frequent
        if not a or not b:
            return False
        if joined in frequent:
            return True
        return shift and any(joined[:c] in frequent and joined[c:] in frequent for c in range(max(1, len(a) - 3), min(len(joined), len(a) + 4)) if c != len(a)) if len(joined) >= 5 else False

    def any_torn(self, raws: list[str], odd: set[str]) -> bool:
        """Whether ``torn`` finds anything, looked for beside uncommon words and lone letters only."""
        n = len(raws)
        for i, raw in enumerate(raws):
            if raw in odd:
                front, tail, lone = self._ends(raw)
                before, after = self._ends(raws[i - 1])[1] if i else "", self._ends(raws[i + 1])[0] if i + 1 < n else ""
                rare = self.known[raw][0] is not None
                if self._maybe(before, front, rare) or self._maybe(tail, after, rare) or (before and after and front == raw.lower() and before + front + after in self.frequent) or (lone and i + 1 < n and self._ends(raws[i + 1])[2]):
                    if self.torn(" ".join(raws[max(0, i - 3 if not lone else i - FRAGMENTS) : i + (4 if not lone else FRAGMENTS)])):
                        return True
        return False

    def near(self, word: str) -> str:
        """A word that was put together, or the word of the lexicon a confusion away from it."""
        w = word.lower()
        if w in self.frequent or len(w) < 4:
            return word
        forms = set(swapped(w))
        if len(w) >= 7:
            forms |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abcdefghijklmnopqrstuvwxyz"}
        best = max(((self.frequent[f], f) for f in forms if f in self.frequent), default=None)
        return word if best is None else best[1] if word.islower() else best[1].capitalize() if word[1:].islower() else best[1].upper()

    def numbers(self, lines: list[str]) -> list[int]:
        """Lines that are a page number: at the edges of the text, or alone between the end of one sentence and the beginning of another."""
        solid = [i for i, x in enumerate(lines) if x.strip()]
        at = {}
        for k, i in enumerate(solid):
            s = lines[i].strip()
            if len(s) <= 12 and (m := _NUMBER.fullmatch(s)):
                core = m.group(1)
                if any(c.isdigit() for c in core) or (len(core) > 1 and not core.strip("lI|O")) or (core.islower() or core.isupper()) and _ROMAN.fullmatch(core) and core.lower() not in ("c", "l"):
                    at[k] = s != core
        found = []
        for k, dressed in at.items():
            if k < EDGE_LINES or k >= len(solid) - EDGE_LINES:
                found.append(solid[k])
            elif k - 1 not in at and k + 1 not in at:
                above, below = lines[solid[k - 1]].strip(), lines[solid[k + 1]].strip()
                if dressed or (above[-1:] in ".?!\"”’)" and below[:1].isupper() and min(len(above), len(below)) > 3):
                    found.append(solid[k])
        return found

    def heads(self, text: str, head_word: str | None, capitals: int = 2) -> list[tuple[int, int]]:
        """Running heads; fewer than two title words in capitals make none without the name of the book."""
        found = [(s, e) for stem in _stems(head_word) if stem in text for s, e, words in _head_words(text, stem) if any(w.lower().strip(_STRIP) in self.titles for w in words)]
        if not found and capitals > 1:
            for m in re.finditer(r"(?:[A-Z][\w|!@'’]+\s+){2,7}[A-Z][\w|!@'’]+", text):
                words = [w.lower() for w in m.group().split()]
                if any(a in self.titles and b in self.titles for a, b in zip(words, words[1:])):
                    found.append(m.span())
        return found

    def read(self, text: str, head_word: str | None) -> tuple[bool, list[str]]:
        """Whether noise is sure, and the rare words that may be noise."""
        text = plain(text)
        raws = split(text)
        rare, odd, capitals = self.words(raws)
        sure = (
            bool(_LIGATURE.search(text))
            or bool(_MAY_CUT.search(text) and self.cuts(text))
            or bool(self.numbers(text.split("\n")))
            or bool(self.heads(text, head_word, capitals))
            or bool(odd and self.any_torn(raws, odd))
        )
        return sure, rare


def _read_batches(batches: Iterator[pa.RecordBatch], reader: Reader) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [reader.read(t, d) if t else (False, []) for d, t in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-2], pa.array([s for s, _ in done], pa.bool_()), pa.array([w for _, w in done], pa.list_(pa.string()))],
            [*batch.schema.names[:-2], "sure", "rare"],
        )


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _x, _y in SWAPS:
    _BY_FIRST.setdefault(_x[0], []).append((_x, _y))


def swapped(w: str) -> list[str]:
    """A word with each of the listed confusions taken back, at each of its places."""
    return [w[:i] + y + w[i + len(x) :] for i, c in enumerate(w) for x, y in _BY_FIRST.get(c, ()) if w.startswith(x, i)]


def misread(w: str) -> list[str]:
    """What a word may be read as, by one of the listed confusions."""
    return [w[:i] + x + w[i + len(y) :] for x, y in SWAPS for i in range(len(w) - len(y) + 1) if w.startswith(y, i)]


def _two_errors(batches: Iterator[pa.RecordBatch], lexicon_: dict[str, int], usual: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """(token, correction, how) of tokens that two errors explain: confusions in one word, or on the sides of a place where two words ran together.

    In tokens shorter than ``LONG_TOKEN`` only ``usual`` variants of the corpus count as confusions, for many names are a few letters off two short words.
    """
    # What common words (10,000 at most) may be read as, by one confusion.
    least = COMMON_SHARE * sum(lexicon_.values())
    forms: dict[str, str] = {}
    for v in sorted((v for v, n in lexicon_.items() if n >= least), key=lexicon_.get):
        for form in misread(v):
            forms[form] = v

    def one(w: str, long: bool) -> tuple[tuple[str, int], ...]:
        """Words a confusion away, or the word itself, with the confusions needed."""
        if w in lexicon_:
            return ((w, 0),)
        v = usual.get(w)
        if v is None or v not in lexicon_:
            v = forms.get(w) if long else None
        return () if v is None else ((v, 1),)

    def best(w: str, n: int) -> str | None:
        found: list[tuple[int, int, str]] = []
        for form in swapped(w) if len(w) >= 6 else ():
            for v, k in one(form, True):
                if k == 1 and len(v) >= 5:
                    found.append((1, -lexicon_[v], v))
        bare = _SIGNS.sub("", w)
        for cut in range(1, len(bare)):
            left = one(bare[:cut], len(bare) >= LONG_TOKEN)
            for a, i in left:
                for b, j in one(bare[cut:], len(bare) >= LONG_TOKEN) if left else ():
                    k = i + j + (bare != w)
                    if 1 <= k <= 2 and len(a) + len(b) >= 5 and all(len(x) > 1 or x in "ai" for x in (a, b)) and (i + j == 0 or min(len(a), len(b)) >= 2):
                        found.append((1 + k, -min(lexicon_[a], lexicon_[b]), f"{a} {b}"))
        found = [f for f in found if n <= TOGETHER * 5 * -f[1]]
        return min(found)[2] if found else None

    for batch in batches:
        tokens = batch.column(0).to_pylist()
        done = [(t, c) for t, n in zip(tokens, batch.column(1).to_pylist()) if (c := best(t, n)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([c for _, c in done], pa.string()), pa.array(["two"] * len(done), pa.string())], ["token", "correction", "how"])


def _fitted(rows: DataFrame) -> tuple[Reader, DataFrame, DataFrame]:
    """Reader with the lexicon, the variants of the rare words, and the first word of the head of each book."""
    vocabulary = materialize(count_words(rows), "scan-words")
    words = vocabulary.where(~F.col("token").startswith(_TITLE))
    frequent, total = lexicon(vocabulary)
    bad = materialize(variants(words), "scan-variants")
    letters = ~F.col("token").rlike(r"^(?:[^aio]|(\p{L})\1+)$")
    known = {r["token"]: r["n"] for r in frequent.join(bad, "token", "left_anti").where(letters).select("token", "n").collect()}  # 1 / LEXICON_SHARE words at most
    usual = {r["token"]: r["correction"] for r in words.where(F.col("n") >= LEXICON_SHARE * total).join(bad.where("how = 'confusion'"), "token").select("token", "correction").collect()}  # so many, too
    odd = words.where(F.length("token").between(5, 40) & (F.col("n") < COMMON_SHARE * total)).join(bad, "token", "left_anti")
    more = materialize(odd.select("token", "n").mapInArrow(lambda b: _two_errors(b, known, usual), "token string, correction string, how string"), "scan-two-errors")
    for r in more.join(frequent, "token", "left_semi").select("token").collect():  # some of the lexicon
        known.pop(r["token"], None)
    head_words, titles = book_heads(vocabulary)
    # Title words that mostly stand in heads; rarer than in one head of a thousand they tell nothing outside their own book.
    titles = titles.crossJoin(F.broadcast(titles.agg(F.sum("n_title").alias("all_titles")))).where("n_title >= 0.001 * all_titles").join(vocabulary, "token").where("n_title >= 0.3 * n")
    names = {r["token"] for r in titles.select("token").collect()}  # 1,000 at most
    return Reader(known, names), bad.unionByName(more), materialize(head_words, "scan-heads")


def find_noise(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of the rows of (``keys``, doc_id, text) that hold noise of scanning."""
    reader, bad, head_words = _fitted(rows)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    own = rows.select(*keys, "doc_id", "text").join(head_words, "doc_id", "left").select(*keys, "head_word", "text")
    read = materialize(own.mapInArrow(lambda b: _read_batches(b, reader), f"{kinds}, sure boolean, rare array<string>"), "scan-read")
    noisy = _in_company(read, bad, keys)
    return read.where("sure").select(*keys).unionByName(noisy.select(*keys)).distinct()


def _in_company(read: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, token, correction) of the noise words of each row.

    Noise seldom comes alone. A variant whose rows show other noise so much more seldom than
    those of all variants that chance does not explain it is a word in its own right and is
    left out. Where noise is light throughout, nothing is left out.
    """
    hits = materialize(read.select(*keys, "sure", F.explode("rare").alias("token")).join(bad, "token"), "scan-hits")
    each = hits.withColumn("other", (F.col("sure") | (F.count("*").over(Window.partitionBy(*keys)) > 1)).cast("int"))
    share = materialize(each.groupBy("token").agg(F.count("*").alias("r"), F.sum("other").alias("c")), "scan-company")
    q = share.agg((F.sum("c") / F.sum("r")).alias("q"))
    p = F.col("c") / F.col("r")
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    evidence = F.col("r") * (part(p, F.col("q")) + part(1 - p, 1 - F.col("q")))
    own = share.crossJoin(F.broadcast(q)).where((p < F.col("q")) & (F.col("q") < 1) & (evidence > OWN_EVIDENCE)).select("token")
    return hits.join(own, "token", "left_anti").select(*keys, "token", "correction")


def _repair_text(text: str, head_word: str | None, reader: Reader, fixes: dict[str, str]) -> str:
    """Continuous paragraphs: page numbers and heads out, cuts and torn words joined, rare words corrected, lines unwrapped."""
    text = plain(text)
    for s, e in sorted(reader.heads(text, head_word), reverse=True):
        near = re.compile(r"[ \t]*(?:\d{1,4}|[ivxlc]+)?[ \t]*$", re.I).search(text[:s])
        after = re.compile(r"[.]?[ \t]*(?:\[[IVXLC]+\.?\])?[ \t]*(?:—[ \t]*)?(?:\d{1,4})?").match(text[e:])
        text = text[: near.start()] + " " + text[e + after.end() :]
    lines = text.split("\n")
    drop = set(reader.numbers(lines))
    text = "\n".join(x for i, x in enumerate(lines) if i not in drop)
    for s, e, joined, _ in sorted(reader.cuts(text), reverse=True):
        text = text[:s] + reader.near(joined) + text[e:]
    text = re.sub(r"(\w)-[ \t]?\n[ \t]*(?=\w)", r"\1-", text)  # a compound broken at its own hyphen
    text = re.sub(r"(?<!\S)[·^°¬|]+(?=[^\W\d_])", "", text)
    for s, e, joined in sorted(reader.torn(text), reverse=True):
        text = text[:s] + joined + text[e:]
    text = text.replace("ſ", "s")
    for sign, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        text = text.replace(sign, letters)

    def fix(m: re.Match) -> str:
        word = m.group()
        core = word.strip(_STRIP)
        to = fixes.get(core.lower())
        if to is None or not core:
            return word
        to = to.upper() if core.isupper() and len(core) > 1 else to[0].upper() + to[1:] if core[0].isupper() else to
        return word.replace(core, to, 1)

    text = re.sub(r"\S+", fix, text)
    text = re.sub(r"(?<=\w) (?=[.,;:?!](?:\s|$))", "", text)
    paragraphs = [re.sub(r"[ \t]*\n[ \t]*", " ", p).strip() for p in re.split(r"\n[ \t]*\n+", text)]
    return "\n\n".join(re.sub(r"[ \t]{2,}", " ", p) for p in paragraphs if p)


def _repair_batches(batches: Iterator[pa.RecordBatch], reader: Reader) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts, fixes = (batch.column(batch.num_columns - k).to_pylist() for k in (3, 2, 1))
        done = [_repair_text(t, d, reader, dict(f or [])) if t else t for d, t, f in zip(docs, texts, fixes)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(done, pa.string())], [*batch.schema.names[:-3], "clean_text"])


def repair(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and clean_text of every row of (``keys``, doc_id, text); ``keys`` must be unique."""
    reader, bad, head_words = _fitted(rows)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    own = rows.select(*keys, "doc_id", "text").join(head_words, "doc_id", "left").select(*keys, "head_word", "text")
    read = own.mapInArrow(lambda b: _read_batches(b, reader), f"{kinds}, sure boolean, rare array<string>")
    fixes = _in_company(read, bad, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "correction"))).alias("fixes"))
    return own.join(fixes, keys, "left").mapInArrow(lambda b: _repair_batches(b, reader), f"{kinds}, clean_text string")
