"""Text decoded with the wrong character encoding: found and restored by a table of garbled words.

Every distinct word of the corpus with letters or signs beyond ASCII is garbled under all
encoding chains, and the tokens of the documents are hash-joined with this table. A token is
garbled if the corpus holds the word it would come from often enough beside it: in distinct
texts, so that a garbled text under many ids does not outnumber its words, or in rows, so
that a clean text under many ids counts as well, unless distinct texts say the reverse. The
same is done for the pieces of words (a run of signs beyond ASCII with the kinds of its
neighbours, and pairs of signs within long runs), for names and sentences whose clean form
stands nowhere else. All evidence is a ratio of counts, so it does not change with the size
of the corpus.

Restoring puts verified originals in the place of garbled tokens: the word of the table
where a whole word was found; else the token with the chain of the document (the most
frequent among its tokens) or its own taken back, if the corpus holds this word; else by
pieces. A run with the sign of a failed decoding (U+FFFD), which no chain can take back, is
joined to the most frequent word that fits around it, and else to the sign that mostly
stands between such neighbours.

Signs of failed decoding (the replacement character, and control characters that no
text is written with) are garbled in themselves.

Defined results: null, empty and blank texts, and texts of ASCII alone, are never found
and stay as they are. Digits count as one digit. Repeated rows are judged alike. Every found
row has a restored text; ``restorable`` is false where something garbled is left in it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.runtime import materialize

# The encoding a text was written in and the one it was read with; two steps where that happened twice.
CHAINS = [
    *[(("utf-8", x),) for x in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1254", "gbk", "cp932", "big5")],
    *[(("cp1252", x),) for x in ("mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2", "iso8859-7", "cp1253", "gbk")],
    *[((x, "cp1252"),) for x in ("mac_roman", "cp437", "cp850", "cp852", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "shift_jis", "euc_jp", "gbk")],
    *[((x, "latin-1"),) for x in ("cp1250", "iso8859-2", "cp1251", "koi8-r", "shift_jis", "euc_jp", "mac_roman", "cp437", "cp850")],
    *[((x, "cp1250"),) for x in ("iso8859-2", "mac_roman", "cp852")],
    *[((x, "mac_roman"),) for x in ("latin-1", "cp1250", "iso8859-2", "cp1251", "shift_jis", "euc_jp")],
    *[((x, "cp1251"),) for x in ("koi8-r", "cp866", "iso8859-5", "mac_cyrillic")],
    *[(("cp1251", x),) for x in ("koi8-r", "cp866", "iso8859-5", "mac_cyrillic")],
    (("koi8-r", "cp866"),), (("cp866", "koi8-r"),), (("koi8-r", "iso8859-5"),), (("iso8859-2", "cp437"),), (("cp1250", "cp437"),), (("cp1250", "cp850"),), (("cp1250", "cp852"),), (("cp852", "cp1250"),), (("shift_jis", "euc_jp"),), (("euc_jp", "shift_jis"),), (("euc_jp", "gbk"),), (("shift_jis", "gbk"),),
    *[(("utf-8", x), ("utf-8", y)) for x in ("cp1252", "latin-1") for y in ("cp1252", "latin-1")],
    (("utf-8", "mac_roman"), ("utf-8", "mac_roman")), (("utf-8", "cp437"), ("utf-8", "cp437")), (("utf-8", "cp850"), ("utf-8", "cp850")), (("utf-8", "cp1251"), ("utf-8", "cp1251")),
]
WIDE = {"utf-8", "gbk", "cp932", "big5", "shift_jis", "euc_jp"}
#: How many times as often as a garbled form its original must stand, whole words and pieces; for chains that lengthen text and for others.
WORD_TIMES, PIECE_TIMES = (1, 2), (3, 20)
#: Share of the longer garbled words that a chain must have before single signs are laid to it.
SEEN_SHARE = 0.002
#: How many times the number that the share of a chain lets one expect a piece may stand, beside one that chance may add.
EXPECTED_TIMES = 5
#: Share of the signs between such neighbours that one must have to stand for a lost one.
SIGN_SHARE = 0.75
#: Length of a run beyond which it is judged by pairs of signs.
RUN = 12
#: Bytes in memory up to which a side of a join is broadcast; ``_side`` measures them.
SENT_BYTES = 16_000_000

_TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]*[\x80-\U0010ffff][0-9A-Za-z\x80-\U0010ffff]*")
_BEYOND = re.compile(r"[\x80-\U0010ffff]+")
_HARD = re.compile(r"[\x80-\x84\x86-\x9f�]|(?<=\w)\x85|\x85(?=\w)")
_DIGIT = re.compile(r"[0-9]")


@cache
def _reading(codec: str) -> list[str]:
    """Character of each byte; bytes without one stand for themselves, as lenient readers do."""
    return [bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)]


@cache
def _writing(codec: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_reading(codec))))}


def misread(text: str, chain: tuple) -> str | None:
    """``text`` written and read by the chain; None where it can't be written."""
    for written, read in chain:
        try:
            raw = text.encode(written)
            text = raw.decode(read) if read in WIDE else "".join(map(_reading(read).__getitem__, raw))
        except UnicodeError:
            return None
    return text


def reread(text: str, chain: tuple) -> str | None:
    """The original of a garbled text, or None."""
    for written, read in reversed(chain):
        try:
            raw = text.encode(read) if read in WIDE else bytes(map(_writing(read).__getitem__, text))
            text = raw.decode(written)
        except (UnicodeError, KeyError):
            return None
    return text


def tokens(text: str) -> set[str]:
    return {_DIGIT.sub("0", m.group()) for m in _TOKEN.finditer(text)}


def _kind(c: str) -> str:
    return "^" if not c else "0" if c.isdigit() else "A" if c.isupper() else "a"


def pieces(token: str) -> set[str]:
    """Runs beyond ASCII with the kinds of their neighbours; of long runs, pairs of wide signs and what such pairs may have become."""
    found = set()
    for m in _BEYOND.finditer(token):
        run = m.group()
        if len(run) <= RUN:
            found.add(f"{_kind(token[m.start() - 1 : m.start()])}|{run}|{_kind(token[m.end() : m.end() + 1])}")
        found.update(run)  # single signs, as originals of what long chains make of them
        if 3 <= len(run) <= RUN:
            found.update(run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1) if "a" <= run[i].lower() < "ɐ" or run[i] > "‐")
        if len(run) >= 4:
            wide = sum(c >= "⺀" for c in run) * 2 > len(run)
            for n in (2, 3) if wide else (4, 6):
                found.update(run[i : i + n] for i in range(len(run) - n + 1))
    return found


def forms(unit: str, rows: int) -> Iterator[tuple[str, int]]:
    """What a unit may become, with the number of the chain; a unit of one row can stand against chains that lengthen text alone."""
    left, run, right = unit.split("|") if unit.count("|") == 2 else ("", unit, "")
    for i, chain in enumerate(CHAINS):
        if rows < 2 and chain[0][0] not in WIDE:
            continue
        g = misread(run, chain)
        if g is not None and g != run:
            yield (f"{left}|{g}|{right}" if left else g), i


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, batch.schema.field(0).type), batch.column(1), pa.array([bool(_HARD.search(t)) for t in texts], pa.bool_()), pa.array([sorted(tokens(t)) for t in texts], pa.list_(pa.string()))],
            ["key", "hash", "hard", "tokens"],
        )


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(pieces(t)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.string()))], ["token", "n", "n_rows", "pieces"])


def _form_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        for a in range(0, len(units), 2_000):
            rows = [(g, i, u, n, m) for u, n, m in units[a : a + 2_000] for g, i in forms(u, m)]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["form", "chain", "clean", "n_clean", "rows_clean"])


def _side(df: DataFrame) -> DataFrame:
    """The smaller side of a join over the corpus, cheap to read: broadcast up to ``SENT_BYTES``, merged in order beyond.

    Spark takes the size from compressed files and does not see what lists and batches are
    unfolded to, so sides it takes for small can fill the driver. The other joins here are merged.
    """
    row = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(64))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= SENT_BYTES else df.hint("merge")


def _garbled(units: DataFrame, unit: str, times: tuple[int, int]) -> DataFrame:
    """(``unit``, clean, chain) of the units that are a garbled form of one that is so many times as frequent.

    Counts over distinct texts decide, or those over rows. A chain that does not lengthen text
    may have its reverse among the chains: there rows decide only if texts do not say the reverse.
    """
    spread = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = units.select(unit, "n", "n_rows").repartition(spread).mapInArrow(_form_batches, "form string, chain int, clean string, n_clean bigint, rows_clean bigint")
    least = F.when(_long_chain(), F.lit(times[0])).otherwise(F.lit(times[1]))
    by_texts = F.col("n_clean") >= least * F.col("n")
    by_rows = (F.col("rows_clean") >= least * F.col("n_rows")) & (_long_chain() | (F.col("n") <= least * F.col("n_clean")))
    met = units.join(table.hint("merge"), F.col(unit) == F.col("form")).where(by_texts | by_rows)
    best = met.groupBy(unit).agg(F.first("n").alias("n"), F.min_by(F.struct("clean", "chain", "n_clean"), F.struct(-F.col("n_clean"), -F.col("rows_clean"), "chain")).alias("b"))
    return best.select(unit, "n", "b.clean", "b.chain", "b.n_clean")


def _long_chain() -> Column:
    return F.col("chain").isin([i for i, c in enumerate(CHAINS) if c[0][0] in WIDE])


def _own(df: DataFrame, key: str, text: str) -> DataFrame:
    """Tokens beyond ASCII of the rows that have any, written once."""
    own = df.select(df[key].alias("key"), F.md5(df[text]).alias("hash"), df[text].alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return materialize(own.mapInArrow(_token_batches, f"key {df.schema[key].dataType.simpleString()}, hash string, hard boolean, tokens array<string>"), "encoding-tokens")


def _words(read: DataFrame) -> DataFrame:
    """(token, n, n_rows): distinct texts and rows of each token."""
    texts = read.groupBy("hash").agg(F.first("tokens").alias("tokens"), F.count("*").alias("copies"))
    return materialize(texts.select("copies", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.sum("copies").alias("n_rows")), "encoding-words")


def garbled_tokens(words: DataFrame) -> DataFrame:
    """(token, clean, chain) of the garbled tokens; clean is null where the token was found by its pieces."""
    whole = materialize(_garbled(words, "token", WORD_TIMES), "encoding-whole")
    # A chain that turns up in hardly any of the longer words is a chance likeness of signs. Its share is how often words are garbled by it.
    longer = whole.where("length(token) >= 4").groupBy("chain").agg(F.count("*").alias("words"), (F.sum("n") / F.sum("n_clean")).alias("share"))
    seen = longer.crossJoin(F.broadcast(longer.agg(F.sum("words").alias("all_words")))).where(F.col("words") >= SEEN_SHARE * F.col("all_words")).select("chain", "share")  # a row for each chain at most
    seen = materialize(seen, "encoding-chains")
    whole = whole.where("length(token) >= 3").unionByName(whole.where("length(token) < 3").join(F.broadcast(seen), "chain", "left_semi").select(*whole.columns))
    cut = materialize(words.mapInArrow(_piece_batches, "token string, n bigint, n_rows bigint, pieces array<string>"), "encoding-pieces")
    exploded = cut.select("token", "n", "n_rows", F.explode("pieces").alias("piece"))
    units = materialize(exploded.groupBy("piece").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows")), "encoding-units")
    bad = materialize(_garbled(units, "piece", PIECE_TIMES), "encoding-bad")
    # Signs that stand far more often than the chain garbles words are written as they are. A single sign without its neighbours tells nothing.
    likely = bad.where(~_long_chain() & (F.length("piece") > 1)).join(F.broadcast(seen), "chain").where(F.col("n") <= 1 + EXPECTED_TIMES * F.col("share") * F.col("n_clean"))
    bad = bad.where(_long_chain()).select("piece", "chain").unionByName(likely.select("piece", "chain"))
    votes = exploded.select("token", "piece").join(_side(bad), "piece").groupBy("token", "chain").agg(F.count("*").alias("votes"))
    partly = votes.groupBy("token").agg(F.min_by("chain", F.struct(-F.col("votes"), "chain")).alias("chain"))
    found = whole.select("token", "clean", "chain").unionByName(partly.join(whole.hint("merge"), "token", "left_anti").select("token", F.lit(None).cast("string").alias("clean"), "chain"))
    return materialize(found, "encoding-found")


def find_garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` of the rows whose text is garbled, wholly or in part."""
    read = _own(df, key, text)
    bad = garbled_tokens(_words(read))
    soft = read.where("NOT hard").select("key", F.explode("tokens").alias("token")).join(_side(bad.select("token")), "token", "left_semi")
    return read.where("hard").select("key").unionByName(soft.select("key")).distinct().withColumnRenamed("key", key)


def _skeleton(token: str) -> str:
    """A token with one sign for each run beyond ASCII."""
    return _BEYOND.sub("\ufffd", token)


def _nature(c: str) -> str:
    return "0" if c.isdigit() else "_" if c.isspace() else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "\ufffd" if c > "\x7f" else c


#: Levels of context, from near to the letter to kinds alone: (signs on either side, whether letters are kept).
LEVELS = [(6, True), (4, True), (3, False), (2, False), (1, False)]


def _contexts(text: str, start: int, end: int) -> list[str]:
    """What stands on either side of a run, level by level."""
    found = []
    for k, (n, letters) in enumerate(LEVELS):
        left, right = text[max(0, start - n) : start], text[end : end + n]
        found.append(f"{k}" + "|".join("".join(c.lower() if letters and "A" <= c <= "z" else _nature(c) for c in s) for s in (left, right)))
    return found


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, sign, n): runs beyond ASCII of three signs at most with their neighbours, those of failed decodings left out."""
    counts: Counter[tuple[str, str]] = Counter()
    for batch in batches:
        for t in batch.column(0).to_pylist():
            for m in _BEYOND.finditer(t):
                if len(m.group()) <= 3 and "\ufffd" not in m.group():
                    for unit in _contexts(t, m.start(), m.end()):
                        counts[unit, m.group()] += 1
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["unit", "sign", "n"])


def _plan(text: str, given: list[tuple[str, str | None, int]]) -> Iterator[tuple[str, str, list[str]]]:
    """(kind, token or context, units to look up) of what is garbled in a text, best units first.

    Kind "is": the unit is the original. "word": the first unit that the corpus holds. "fit": the best word around lost signs. "sign": by neighbours.
    """
    own = {t: (c, i) for t, c, i in given}
    votes = Counter(i for _, _, i in given).most_common()
    main = votes[0][0] if votes and 2 * votes[0][1] > sum(n for _, n in votes) and (len(votes) == 1 or votes[0][1] > 2) else None
    for token in sorted({m.group() for m in _TOKEN.finditer(text)}):
        folded = _DIGIT.sub("0", token)
        clean, chain = own.get(folded, (None, None))
        if "\ufffd" in token:
            if _skeleton(folded) != "\ufffd":
                yield "fit", token, [_skeleton(folded)]
            continue
        found = []
        for i in dict.fromkeys(x for x in (main, chain) if x is not None):
            back = reread(token, CHAINS[i])
            if back and back != token:
                found.append(back)
        if clean is not None:
            digits = iter(_DIGIT.findall(token))
            whole = re.sub("0", lambda m: next(digits, "0"), clean)
            # The document's own chain may say another word of the corpus; the word of the table is verified already.
            yield ("word", token, [found[0], whole]) if found and main is not None and found[0] != whole else ("is", token, [whole])
        elif chain is not None or (found and main is not None):
            if chain is not None and CHAINS[chain][0][0] in WIDE:
                found.append(_BEYOND.sub(lambda m: _within(m.group(), CHAINS[chain]), token))
            # A chain that lengthens text, taken back, leaves no doubt; of others the corpus must hold the word.
            yield ("word" if chain is None and CHAINS[main][0][0] not in WIDE else "back"), token, found
    for m in _BEYOND.finditer(text):
        if "\ufffd" in m.group():
            for unit in _contexts(text, m.start(), m.end()):
                yield "sign", unit, [unit]


def _within(run: str, chain: tuple) -> str:
    """Takes the chain back wherever a stretch of the run gives one sign."""
    out, i = [], 0
    while i < len(run):
        for n in (9, 8, 7, 6, 5, 4, 3, 2):
            found = reread(run[i : i + n], chain) if i + n <= len(run) else None
            if found and len(found) == 1:
                out.append(found)
                i += n
                break
        else:
            out.append(run[i])
            i += 1
    return "".join(out)


def _plan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, given in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for kind, token, units in _plan(text, [(g["token"], g["clean"], g["chain"]) for g in given or []]):
                rows += [(key, kind, token, unit, _DIGIT.sub("0", unit) if kind in ("word", "back") else unit, at) for at, unit in enumerate(units)]
        columns = list(zip(*rows)) or [[]] * 6
        kinds = (batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "kind", "token", "unit", "folded", "at"])


def _restore(text: str, fixes: dict[tuple[str, str], str]) -> tuple[str, bool]:
    """The text with its originals put in, and whether nothing garbled is left."""

    def one(m: re.Match) -> str:
        token = m.group()
        to = fixes.get(("token", token))
        if to is not None and "\ufffd" in token:
            digits = iter(_DIGIT.findall(token))
            return re.sub("0", lambda x: next(digits, "0"), to)
        return to if to is not None else token

    done = _TOKEN.sub(one, text)
    if "\ufffd" in done:
        def sign(m: re.Match) -> str:
            if "\ufffd" not in m.group():
                return m.group()
            # The longest context that the corpus knows decides; it may know no sign that mostly stands there. Within a word kinds tell nothing.
            within = done[m.start() - 1 : m.start()].isalpha() and done[m.end() : m.end() + 1].isalpha()
            return next((s for u in _contexts(done, m.start(), m.end())[: 2 if within else None] if (s := fixes.get(("sign", u))) is not None), "") or m.group()

        done = _BEYOND.sub(sign, done)
    return done, not _HARD.search(done)


def _restore_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [_restore(t, {("sign" if f["kind"] == "sign" else "token", f["token"]): f["to"] for f in x or []}) for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([r for _, r in done], pa.bool_())], ["key", "restored_text", "restorable"])


def restore(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, restored_text and restorable of each garbled row; ``key`` must be unique."""
    kind = df.schema[key].dataType.simpleString()
    read = _own(df, key, text)
    words = _words(read)
    bad = garbled_tokens(words)
    given = read.select("key", F.explode("tokens").alias("token")).join(_side(bad), "token").groupBy("key").agg(F.collect_list(F.struct("token", "clean", "chain")).alias("given"))  # tokens of one text
    found = read.where("hard").select("key").join(given, "key", "full")
    own = df.select(df[key].alias("key"), df[text].alias("text"))
    found = materialize(own.join(found.hint("merge"), "key").select("key", "text", "given"), "encoding-rows")
    plan = materialize(found.mapInArrow(_plan_batches, f"key {kind}, kind string, token string, unit string, folded string, at int"), "encoding-plan")
    good = words.join(bad.select("token").hint("merge"), "token", "left_anti").where(~F.col("token").contains("\ufffd"))
    held = plan.where("kind IN ('word', 'back')").join(good.select(F.col("token").alias("folded"), F.lit(True).alias("held")).hint("merge"), "folded", "left")
    # Of what the pieces say something is garbled the first reading is taken even if the corpus holds none.
    chosen = held.where("held OR kind = 'back'").groupBy("key", "kind", "token").agg(F.min_by("unit", F.struct(F.col("held").isNull(), "at")).alias("to"))
    fit = plan.where("kind = 'fit'").select("key", "kind", "token", "unit")
    skeletons = good.withColumn("unit", F.regexp_replace("token", r"[\x{80}-\x{10ffff}]+", "\ufffd")).join(fit.select("unit").distinct().hint("merge"), "unit", "left_semi")
    best = skeletons.groupBy("unit").agg(F.max_by("token", F.struct("n", "token")).alias("to"))
    signs = own.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("text").mapInArrow(_sign_batches, "unit string, sign string, n bigint").groupBy("unit", "sign").agg(F.sum("n").alias("n"))
    signs = signs.join(plan.where("kind = 'sign'").select("unit").distinct().hint("merge"), "unit", "left_semi").groupBy("unit").agg(F.max_by("sign", F.struct("n", "sign")).alias("to"), F.max("n").alias("most"), F.sum("n").alias("all_signs"))
    signs = signs.select("unit", F.when(F.col("most") >= SIGN_SHARE * F.col("all_signs"), F.col("to")).otherwise("").alias("to"))
    fixes = (
        plan.where("kind = 'is'").select("key", "kind", "token", F.col("unit").alias("to"))
        .unionByName(chosen)
        .unionByName(fit.join(best.hint("merge"), "unit").select("key", "kind", "token", "to"))
        .unionByName(plan.where("kind = 'sign'").select("key", "kind", "token", "unit").distinct().join(signs.hint("merge"), "unit").select("key", "kind", "token", "to"))
        .groupBy("key").agg(F.collect_list(F.struct("kind", "token", "to")).alias("fixes"))
    )
    done = found.select("key", "text").join(fixes.hint("merge"), "key", "left").mapInArrow(_restore_batches, f"key {kind}, restored_text string, restorable boolean")
    return done.withColumnRenamed("key", key)
