"""Records that ask the same across splits, found by a compressed full-text index.

A question is read as its sequence of content words: articles, forms of "to be" and fillers
are left out, and verbs of one meaning share a sign. Words of direction, time, place, number
and negation always stay. Each distinct sequence is handled once.

Evaluation texts are indexed in shards. A shard holds texts as rotations that end in one of
their anchors, under a Burrows-Wheeler transform over words with ranks; a training text is
streamed through backward search from each of its anchors. A step goes to the same word, or to
a word of the interval that is a slip of the pen away, so the exact matches between slips are
drawn out to their maximum and merged to the span of the whole text; a training text that
spans a whole rotation is a pair. As a rotation, a clause moved to the front is the same
sequence; it counts as the same order only if the place of the cut is set off by punctuation.

Anchors are the rarest words, as many as make sure that two texts of which at least half of
the words agree letter for letter share one. So texts go to the shards of their anchors only,
and work grows with the number of texts. Shards of a frequent anchor are split, and so are
the training texts that go to one shard; nothing is cut off by frequency.

A word that is a slip of another must be much rarer, or both must be rare: two words that
each stand in ``OWN_TEXTS`` distinct texts or more, the rarer in at least ``OWN_RATIO`` times
those of the other, are words of their own.

Defined results: null and blank questions and records with a null or unknown split belong
to no pair. Records that recur under one id give one pair. A question without content words
is compared by all its words. Numbers are never slips. Texts of which more than half of the
words differ are no pair.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.runtime import materialize

#: Indexed rotations of a shard, and training texts that are streamed through it in one task.
SHARD_ROWS, BLOCK_ROWS = 8_000, 30_000
#: Distinct texts, and share of the texts of the other word, from which a word is one of its own.
OWN_TEXTS, OWN_RATIO = 8, 0.001
#: Share of the texts from which a word counts as frequent in the choice of anchors; results do not depend on it.
FREQUENT_SHARE = 1e-3
#: Pairs of words that are compared at once in a task.
PAIRS = 4_000_000

# English words that add nothing to what a question asks, alone or as phrases.
ARTICLES = set("a an the of to is are was were be been being am has have had that".split())
FILLERS = set("please kindly then indeed exactly properly generally usually commonly ordinarily really actually quite simply namely certainly perhaps".split())
PHRASES = ["in this book", "in book", "from card", "on card", "as rule", "in general", "tell me", "state", "say"]
#: Words of an opening remark, left out where a clause holds nothing else.
REMARK = set("question query card note state say tell me asked reader".split())
#: Words and phrases of one meaning; phrases, in which articles are left out, come first.
PHRASE_CLASSES = {"in course": "during", "in treatment": "treating", "in treating": "treating", "set out": "described", "set forth": "described", "laid down": "described"}
CLASSES = [
    "with having", "should ought", "give gives gave given giving administer administers administered administering", "take takes took taken taking use uses used using",
    "recommend recommends recommended advise advises advised counsel counsels counselled", "attack attacks attacked seize seizes seized", "prefer prefers preferred favour favours favoured",
    "suffer suffers suffered suffering", "treat treats treated treating", "serve serves served serving service", "describe describes described describing", "live lives lived living reside resides resided residing dwell dwells dwelling",
]
#: Short words that are never taken for a slip of an article or filler.
FIRM = set("on in or at no not nor by for from with without before after above under over below up down off out into than when where what which who why how his her him its it if as so do two ten one six she he they them these those there here this".split())

_CLASS = {w: "=" + group.split()[0] for group in CLASSES for w in group.split()}
_MEMBERS = {"=" + group.split()[0]: group.split() for group in CLASSES}
_PART = re.compile(r"[^\W_]+|[:;,()—–.]")
_PHRASE = re.compile(r"\b(?:" + "|".join(sorted([*PHRASES, *PHRASE_CLASSES], key=len, reverse=True)) + r")\b")
_MARKS = set(":;,()—–.")


def words(question: str) -> list[str]:
    """Lower-case words without accents, and signs that set off a clause."""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", question).lower().replace("ſ", "s"))
    s = "".join(c for c in s if not unicodedata.combining(c)).replace("'", "").replace("’", "")
    return _PART.findall(s)


def content(question: str) -> tuple[list[str], list[int]]:
    """Content words, and the places (beyond 0) where a clause begins that punctuation sets off."""
    parts = words(question)
    text = _PHRASE.sub(lambda m: PHRASE_CLASSES.get(m.group(), " "), " ".join(w for w in parts if w not in ARTICLES and w not in FILLERS))
    found: list[str] = []
    starts: list[int] = []
    for clause in re.split(r"[:;,()—–.]", text):
        own = [_CLASS.get(w, w) for w in clause.split()]
        if not own or all(w in REMARK for w in own):
            continue
        if found:
            starts.append(len(found))
        found += own
    if not found:
        return [w for w in parts if w not in _MARKS], []
    return found, starts


def packed(question: str) -> str:
    """``content`` as one text, with a bar before each clause."""
    own, starts = content(question)
    at = set(starts)
    return " ".join(("|" + w if i in at else w) for i, w in enumerate(own))


@lru_cache(200_000)
def unpacked(text: str) -> tuple[tuple[str, ...], tuple[int, ...]]:
    raw = text.split(" ")
    return tuple(w.lstrip("|") for w in raw), tuple(i for i, w in enumerate(raw) if w[:1] == "|")


#: Fixed value: signs that words are compared by before their edits are counted; all others share one place.
_SIGNS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789", 1)}


def _letters(listed: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each sign stands in each word, and which do, as bits."""
    size = np.array([len(w) for w in listed], np.int64)
    table = np.zeros(1 << 16, np.int64)
    for c, i in _SIGNS.items():
        table[ord(c)] = i
    points = np.minimum(np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32), (1 << 16) - 1)
    flat = np.repeat(np.arange(len(listed)), size) * 40 + table[points]
    counts = np.bincount(flat, minlength=len(listed) * 40).reshape(len(listed), 40)
    bits = ((counts > 0) * (np.uint64(1) << np.arange(40, dtype=np.uint64))).sum(1, dtype=np.uint64)
    return np.minimum(counts, 100).astype(np.int8), bits


@lru_cache(400_000)
def slip(a: str, b: str) -> bool:
    """Whether two words are a slip of the pen apart: one edit or swap, two in long words."""
    if a.isdigit() or b.isdigit():
        return a == b
    most = 2 if min(len(a), len(b)) >= 8 else 1
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > most:
        return a == b
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return False
        before = last
    return row[-1] <= most


_EMPTY_WORDS = sorted((ARTICLES | FILLERS) - FIRM)


@lru_cache(200_000)
def _empty_slip(w: str) -> bool:
    if w in FIRM or w.isdigit() or w[:1] == "=":
        return False
    if len(w) <= 2:
        return len(w) == 1 or any(len(x) == 2 and (sorted(w) == sorted(x) or w[0] == x[0] or w[1] == x[1]) for x in _EMPTY_WORDS)
    return any(slip(w, x) or (len(x) == 2 and len(w) == 3 and any(w[:i] + w[i + 1 :] == x for i in range(3))) for x in _EMPTY_WORDS)


def empty_slips(listed: list[str]) -> np.ndarray:
    """Whether each word may be an article or filler with a slip, or a stray letter."""
    counts, _ = _letters(listed)
    known, _ = _letters(_EMPTY_WORDS)
    near = np.array([len(w) <= 2 for w in listed], bool)
    for row in known:
        near |= np.abs(counts.astype(np.int16) - row).sum(1) <= 4
    near[near] = [_empty_slip(listed[i]) for i in np.flatnonzero(near)]
    return near


def anchors(own: tuple[str, ...], frequent: dict[str, int]) -> list[str]:
    """The rarest distinct words, so many that texts of which half the words agree share one."""
    distinct = sorted(set(own), key=lambda w: (frequent.get(w, 0), w))
    return distinct[: len(distinct) // 2 + 1]


def same_order(x: tuple, y: tuple, at_x: int, at_y: int, out_x: set[int], out_y: set[int]) -> bool:
    """Whether two texts matched as rotations begin at the same word, or are cut where punctuation sets a clause off."""
    begins, places = [], []
    for (own, starts), at, out in ((x, at_x, out_x), (y, at_y, out_y)):
        place, n = [], 0
        for i in range(len(own)):
            place.append(n)
            n += i not in out
        begins.append({place[s] % max(n, 1) for s in (0, *starts)})
        places.append((place[at], n))
    (a, n), (b, m) = places
    return n == m and any((s - a + b) % n in begins[1] for s in begins[0])


class RotationIndex:
    """Burrows-Wheeler transform of word sequences with ranks for backward search."""

    def __init__(self, rows: list[list[str]]) -> None:
        m = len(rows)
        self.rows = m
        self.symbol: dict[str, int] = {}
        flat: list[int] = []
        for r, row in enumerate(rows):
            flat.append(r)  # a separator of its own, so that suffixes differ
            for w in row:
                flat.append(self.symbol.setdefault(w, m + 1 + len(self.symbol)))
        flat.append(m)
        text = np.array(flat, np.int64)
        n = len(text)
        rank, step = text, 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1
            key = rank * (n + len(self.symbol) + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank, step = new, step * 2
            if int(rank.max()) == n - 1 or step > n:
                break
        self.bwt = text[order - 1]
        by = np.argsort(self.bwt, kind="stable")
        self.n = n
        self.keys = self.bwt[by] * (n + 1) + by
        self.words = list(self.symbol)

    def step(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one word more to the left."""
        return np.searchsorted(self.keys, c * (self.n + 1) + low), np.searchsorted(self.keys, c * (self.n + 1) + high)

    def before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the interval, symbol) of what stands before the places of each interval, once each."""
        width = high - low
        total = int(width.sum())
        of = np.repeat(np.arange(len(low)), width)
        place = np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(total)
        both = np.unique(of * (self.n + 1) + self.bwt[place])
        return both // (self.n + 1), both % (self.n + 1)


class _Spellings:
    """Written forms of words: those of a class are all of its members."""

    def __init__(self, listed: list[str]) -> None:
        forms = [(i, s) for i, w in enumerate(listed) for s in _MEMBERS.get(w, [w])]
        self.text = [s for _, s in forms]
        self.length = np.array([len(s) for s in self.text], np.int64)
        self.counts, self.mask = _letters(self.text)
        self.is_class = np.array([listed[i][:1] == "=" for i, _ in forms], bool)
        owner = np.array([i for i, _ in forms], np.int64)
        self.owner = owner
        self.first = np.searchsorted(owner, np.arange(len(listed) + 1))

    def expand(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``at``, spelling)."""
        count = self.first[at + 1] - self.first[at]
        row = np.repeat(np.arange(len(at)), count)
        start = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        return row, start + np.arange(int(count.sum()))


def _slips(u_t: np.ndarray, w_t: np.ndarray, a: _Spellings, u_h: np.ndarray, w_h: np.ndarray, b: _Spellings) -> list[tuple[int, int, int]]:
    """(interval, training word, indexed word) a slip apart; both inputs are sorted by interval and distinct."""
    found: set[tuple[int, int, int]] = set()
    row, sa = a.expand(w_t)
    ua = u_t[row]
    row, sb = b.expand(w_h)
    ub = u_h[row]
    low, high = np.searchsorted(ub, ua, "left"), np.searchsorted(ub, ua, "right")
    width = high - low
    ends = np.cumsum(width)
    i = 0
    while i < len(ua):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        w = width[i:j]
        x = np.repeat(np.arange(i, j), w)
        y = np.repeat(low[i:j] - np.concatenate([[0], np.cumsum(w)[:-1]]), w) + np.arange(int(w.sum()))
        la, lb = a.length[sa[x]], b.length[sb[y]]
        most = np.where(np.minimum(la, lb) >= 8, 2, 1)
        ma, mb = a.mask[sa[x]], b.mask[sb[y]]
        ok = (np.abs(la - lb) <= most) & (np.bitwise_count(ma & ~mb) <= most) & (np.bitwise_count(mb & ~ma) <= most) & ~(a.is_class[sa[x]] & b.is_class[sb[y]])
        x, y, most = x[ok], y[ok], most[ok]
        ok = np.abs(a.counts[sa[x]] - b.counts[sb[y]]).sum(1) <= 2 * most
        for p, q in zip(x[ok].tolist(), y[ok].tolist()):
            s, t = a.text[sa[p]], b.text[sb[q]]
            if s != t and slip(s, t):
                found.add((int(ua[p]), int(a.owner[sa[p]]), int(b.owner[sb[q]])))
        i = j
    return sorted(found)


def _search(train: list[tuple[str, int]], held: list[tuple[str, int]]) -> Iterator[tuple[str, str, list[str]]]:
    """(train_text, held_text, slips) of the rotations that span each other."""
    turned = lambda text, at: [*unpacked(text)[0][at + 1 :], *unpacked(text)[0][: at + 1]]
    index = RotationIndex([turned(t, a) for t, a in held])
    vocabulary: dict[str, int] = {}
    flat: list[int] = []
    first, size = [], []
    for t, a in train:
        own = turned(t, a)
        first.append(len(flat))
        size.append(len(own))
        flat.extend([vocabulary.setdefault(w, len(vocabulary)) for w in reversed(own)])
    seq, first, size = np.array(flat, np.int64), np.array(first, np.int64), np.array(size, np.int64)
    listed = list(vocabulary)
    symbol = np.array([index.symbol.get(w, -1) for w in listed], np.int64)
    empty_t, empty_h = empty_slips(listed), empty_slips(index.words)
    a, b = _Spellings(listed), _Spellings(index.words)
    subs: list[tuple[int, int, int]] = []  # (the one before, place in the training row, place in the indexed row)

    n = len(train)
    state = [np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, index.rows + 1, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)]
    start = True
    while len(state[0]):
        t, q, d, low, high, sub, slips = state
        ended = q == size[t]
        for i in np.flatnonzero(ended):
            found = index.bwt[low[i] : high[i]]
            for r in found[found <= index.rows].tolist():
                x, at = unpacked(train[t[i]][0]), train[t[i]][1]
                y, at_y = unpacked(held[r][0]), held[r][1]
                out_x, out_y, pairs, s = set(), set(), [], int(sub[i])
                while s >= 0:
                    s, px, py = subs[s]
                    px, py = (at - px) % len(x[0]) if px >= 0 else -1, (at_y - py) % len(y[0]) if py >= 0 else -1
                    if py < 0:
                        out_x.add(px)
                    if px < 0:
                        out_y.add(py)
                    pairs.append(f"{x[0][px] if px >= 0 else ''}>{y[0][py] if py >= 0 else ''}")
                if same_order(x, y, at, at_y, out_x, out_y):
                    yield train[t[i]][0], held[r][0], sorted(pairs)
        parts: list[list[np.ndarray]] = []
        go = np.flatnonzero(~ended)
        w = seq[first[t[go]] + q[go]]
        c = symbol[w]
        at = go[c >= 0]
        lo, hi = index.step(c[c >= 0], low[at], high[at])
        on = hi > lo
        parts.append([t[at][on], q[at][on] + 1, d[at][on] + 1, lo[on], hi[on], sub[at][on], slips[at][on]])
        if not start:
            turns: list[tuple[int, int, int, int]] = []  # (state, words taken of the training row, of the indexed row, symbol)
            span, of = np.unique(low * (index.n + 1) + high, return_inverse=True)
            u_h, sym = index.before(span // (index.n + 1), span % (index.n + 1))
            u_h, w_h = u_h[sym > index.rows], sym[sym > index.rows] - index.rows - 1
            by_span = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[by_span], np.arange(len(span) + 1))
            # A training word left out, and an indexed one.
            for i in go[empty_t[w]].tolist():
                turns.append((i, 1, 0, 0))
            left_out = empty_h[w_h]
            for u, v in zip(u_h[left_out].tolist(), w_h[left_out].tolist()):
                for i in by_span[edges[u] : edges[u + 1]].tolist():
                    turns.append((i, 0, 1, v + index.rows + 1))
            # One word for another.
            both = of[go] * len(listed) + w
            distinct = np.unique(both)
            order = np.argsort(both, kind="stable")
            for u, wt, wh in _slips(distinct // len(listed), distinct % len(listed), a, u_h, w_h, b):
                key = u * len(listed) + wt
                for k in order[np.searchsorted(both[order], key, "left") : np.searchsorted(both[order], key, "right")].tolist():
                    turns.append((int(go[k]), 1, 1, wh + index.rows + 1))
            if turns:
                i, dq, dd, sym = np.array(turns, np.int64).T
                lo, hi = index.step(sym, low[i], high[i])
                lo, hi = np.where(dd > 0, lo, low[i]), np.where(dd > 0, hi, high[i])
                on = (hi > lo) & (slips[i] < size[t[i]] // 2)
                i, dq, dd, lo, hi = i[on], dq[on], dd[on], lo[on], hi[on]
                parts.append([t[i], q[i] + dq, d[i] + dd, lo, hi, len(subs) + np.arange(len(i)), slips[i] + 1])
                subs += zip(sub[i].tolist(), np.where(dq > 0, q[i], -1).tolist(), np.where(dd > 0, d[i], -1).tolist())
        state = [np.concatenate(x) for x in zip(*parts)]
        start = False


def _match(train: pa.Table, held: pa.Table) -> pa.Table:
    rows: list[tuple[str, str, list[str]]] = []
    if train.num_rows and held.num_rows:
        pick = lambda x: list(zip(x.column("text").to_pylist(), x.column("at").to_pylist()))
        rows = list(_search(pick(train), pick(held)))
    columns = list(zip(*rows)) or [[]] * 3
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("train_text", "held_text", "slips"), columns, (pa.string(), pa.string(), pa.list_(pa.string())))})


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [packed(q or "") for q in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["query_id", "side", "text"])


def _anchor_batches(batches: Iterator[pa.RecordBatch], frequent: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor of a text and each place of it; of evaluation texts the first place alone."""
    for batch in batches:
        rows = []
        for side, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = unpacked(text)[0]
            for w in anchors(own, frequent):
                for i in [i for i, x in enumerate(own) if x == w] if side == "train" else [own.index(w)]:
                    rows.append((w, side, text, i))
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()))], ["anchor", "side", "text", "at"])


def sides(queries: DataFrame) -> DataFrame:
    """(query_id, side, text) of each record of the train and of the evaluation side, once for each id and text."""
    split = F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))
    side = F.when(split == "train", "train").when(split.isin("dev", "test"), "held")
    own = queries.select(F.col("query_id").cast("string").alias("query_id"), side.alias("side"), F.col("question").alias("question"))
    own = own.where("query_id IS NOT NULL AND side IS NOT NULL AND question IS NOT NULL")
    return own.mapInArrow(_text_batches, "query_id string, side string, text string").where("text != ''").distinct()


def _split_up(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation rows with (bucket, part, block): a group holds at most about SHARD_ROWS and BLOCK_ROWS of either."""
    spark = rows.sparkSession
    held, train = rows.where("side = 'held'"), rows.where("side = 'train'")
    buckets = max(1, math.ceil(held.count() / SHARD_ROWS))
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int")
    sizes = rows.groupBy(bucket.alias("bucket")).agg(F.count_if(F.col("side") == "held").alias("n_held"), F.count_if(F.col("side") == "train").alias("n_train"))
    # A row for each bucket that is too large: at most one for so many rows.
    large = [(r["bucket"], math.ceil(r["n_held"] / SHARD_ROWS), math.ceil(r["n_train"] / BLOCK_ROWS)) for r in sizes.where((F.col("n_held") > 1.5 * SHARD_ROWS) | (F.col("n_train") > BLOCK_ROWS)).collect()]
    plan = F.broadcast(spark.createDataFrame(large, "bucket int, parts int, blocks int"))
    placed = [df.withColumn("bucket", bucket).join(plan, "bucket", "left").na.fill(1, ["parts", "blocks"]) for df in (train, held)]
    here = lambda n: F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.col(n))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col(n)) - 1))
    return (
        placed[0].select("bucket", "text", "at", here("blocks").alias("block"), each("parts").alias("part")),
        placed[1].select("bucket", F.col("text").alias("text"), F.col("at").alias("at"), here("parts").alias("part"), each("blocks").alias("block")),
    )


def _own_words(found: DataFrame, counts: DataFrame, n_texts: int) -> DataFrame:
    """``found`` without matches that take one word of its own for another."""
    held_to = found.where("size(slips) > 0").select("train_text", "held_text", "slips", F.explode("slips").alias("s"))
    held_to = held_to.withColumns({"x": F.split_part("s", F.lit(">"), F.lit(1)), "y": F.split_part("s", F.lit(">"), F.lit(2))})
    n = counts.select(F.col("word"), F.col("n"))
    both = held_to.join(n.select(F.col("word").alias("x"), F.col("n").alias("nx")), "x", "left").join(n.select(F.col("word").alias("y"), F.col("n").alias("ny")), "y", "left").na.fill(n_texts, ["nx", "ny"])
    apart = (F.least("nx", "ny") >= OWN_TEXTS) & (F.least("nx", "ny") >= OWN_RATIO * F.greatest("nx", "ny"))
    good = both.groupBy("train_text", "held_text", "slips").agg(F.max(apart.cast("int")).alias("apart")).where("apart = 0")
    return found.where("size(slips) = 0").select("train_text", "held_text").unionByName(good.select("train_text", "held_text")).distinct()


def overlapping_texts(rows: DataFrame) -> DataFrame:
    """(train_text, held_text) of the sequences of content words that ask the same."""
    texts = materialize(rows.select("side", "text").distinct(), "overlap-texts")
    n_texts = texts.count()
    words_ = texts.select(F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"\|", ""), " "))).alias("word"))
    counts = materialize(words_.groupBy("word").agg(F.count("*").alias("n")), "overlap-words")
    # Words in so large a share of texts of bounded length are few.
    frequent = {r["word"]: r["n"] for r in counts.where(F.col("n") >= max(2.0, FREQUENT_SHARE * n_texts)).collect()}
    rows_ = materialize(texts.mapInArrow(lambda b: _anchor_batches(b, frequent), "anchor string, side string, text string, at int"), "overlap-anchors")
    train, held = _split_up(rows_)
    keys = ["bucket", "part", "block"]
    found = train.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_match, "train_text string, held_text string, slips array<string>")
    return _own_words(materialize(found.distinct(), "overlap-found"), counts, n_texts)


def find_overlaps(queries: DataFrame) -> DataFrame:
    """(train_id, held_id) of every pair of records that ask the same across the splits."""
    rows = materialize(sides(queries), "overlap-rows")
    pairs = overlapping_texts(rows)
    train = rows.where("side = 'train'").select(F.col("query_id").alias("train_id"), F.col("text").alias("train_text"))
    held = rows.where("side = 'held'").select(F.col("query_id").alias("held_id"), F.col("text").alias("held_text"))
    return pairs.join(train, "train_text").join(held, "held_text").select("train_id", "held_id").distinct()
