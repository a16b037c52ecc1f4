"""Each operator against a brute-force version, an exact round trip or verified cases, and at its edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.llm import encodings, markup, mixing, neighbours, overlap, quality, scan, splitting, tokenize

PROSE = "The kidneys receive the blood of the body, and it is well understood that the liver of a patient may not be relieved by such a tonic. "


# Markup


@pytest.mark.parametrize(
    "text, clean, marked",
    [
        ("<h2>Head</h2><p>Some <b>bold</b> text.</p><ul><li>a</li><li>b</li></ul>", "Head\n\nSome bold text.\n\n- a\n- b", True),
        ("# Head\n\n**b** and `c` [t](u.html)", "Head\n\nb and c t", True),
        ("== Head ==\n'''b''' [[x|y]] {{cite}}", "Head\n\nb y", True),
        ("\\section{Head}\nA \\emph{x} and $m_{8}=2$.", "Head\n\nA x and $m_{8}=2$.", True),
        ("```\ncode\n```", "code", True),
        ("a &amp; b", "a & b", True),
        ("pulse < 60 or > 110; *See p. 3; $2 for one and $1 more; {or two}; Name ____, age __ [1] A_2 5 * 3 #4", None, False),
        ("1. one\n2. two\nHinge   36 gr.", None, False),
        ("", None, False),
    ],
)
def test_convert(text, clean, marked):
    got, marks = markup.convert(text)
    assert (marks > 0) == marked
    assert got == (text if clean is None else clean) or got.strip() == clean


P = "<p>The kidneys, as a rule, receive the blood of the body; it is well understood that the liver may not be relieved by a tonic, nor by rest.</p>"
FARM = "".join(f'<a href="/{w}">{w}</a> ' for w in ("Home", "Index", "Plates", "Remedies"))


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<nav>{}</nav>", "<div><section>{}</section></div>", "<div><footer>{}</footer></div>", "<table><tr><td>{}</td></tr></table>"])
def test_link_farms_fall_by_their_ratio(wrap):
    body = f"<div><h2>Head</h2>{P * 3}<ul><li>a short item</li><li>more</li></ul></div>"
    clean, _ = markup.convert(wrap.format(FARM) + body)
    assert "Plates" not in clean and "Head" in clean and "- a short item" in clean and clean.count("kidneys") == 3
    # The same element with text in place of links is content.
    clean, _ = markup.convert(wrap.format(P) + body)
    assert clean.count("kidneys") == 4


def test_links_in_prose_stay():
    clean, _ = markup.convert('<a href="x">x</a> is a word of running text. ' + P.replace("the blood", '<a href="b">the blood</a>') * 2 + "<div><footer>" + FARM + "</footer></div>")
    assert clean.startswith("x is a word") and clean.count("receive the blood of") == 2 and "Plates" not in clean


def test_clean_markup_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (4, "<p>a</p>", None), (4, "<p>a</p>", None), (5, "<i>b</i> " * 20_000, "y")]
    df = spark.createDataFrame(rows, "row_id int, text string, clean_text string")
    got = sorted((r["row_id"], r["clean_text"] if r["row_id"] < 5 else len(r["clean_text"]), r["n_marks"]) for r in markup.clean_markup(df, ["row_id"], "text").collect() if r["clean_text"] is not None)
    assert got[:4] == [(2, "", 0), (3, "plain", 0), (4, "a", 2), (4, "a", 2)] and got[4][2] == 40_000
    assert markup.clean_markup(df, ["row_id"], "text", only_marked=True).count() == 3
    assert markup.clean_markup(df.limit(0), ["row_id"], "text").count() == 0


def test_prefilter_passes_what_the_parser_marks(spark):
    texts = ["x $" + "a_" * 400 + "z$ y", "&lt;i class='" + "k" * 900 + "'&gt;x", "&lt;!--" + "c" * 900 + "--&gt; t", "See [http://a.b the page].", "a | b\n|---|---|\n1 | 2", "Head\n-----\nText.", "a\n|-\nb", "a\n    ====\nb"]
    assert all(markup.convert(t)[1] for t in texts)
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    assert markup.clean_markup(df, ["row_id"], "text", only_marked=True).count() == len(texts)


# Scan noise


def noisy_table(spark):
    rows = [(i, "lantern-1", PROSE * 4) for i in range(60)]
    rows += [
        (100, "lantern-1", PROSE + "Tbe liver of thc body."),
        (101, "lantern-1", PROSE.replace("understood", "under-\nstood")),
        (102, "lantern-1", "12\n" + PROSE),
        (103, "lantern-1", "LANTERN HOUSEHOLD PHYSICIAN\n" + PROSE),
        (104, "lantern-1", "LANTERN HOUSEHOLD PHYSICIAN\n" + PROSE * 2),
        (105, "lantern-1", "12 Lantern Household Physician.\n" + PROSE * 3),
        (106, "lantern-1", PROSE.replace("kidneys", "kid neys")),
        (107, "lantern-1", None),
        (108, None, ""),
        (109, None, PROSE),
    ]
    return spark.createDataFrame(rows, "row_id int, doc_id string, text string").withColumn("token", F.lit(1)).withColumn("sure", F.lit(1))


def test_scan_noise(spark):
    df = noisy_table(spark)
    assert sorted(r["row_id"] for r in scan.find_noise(df, ["row_id"]).collect()) == [100, 101, 102, 103, 104, 105, 106]
    fixed = {r["row_id"]: r["clean_text"] for r in scan.repair(df, ["row_id"]).collect()}
    for i in (101, 102, 103, 106, 109):
        assert fixed[i] == PROSE.strip()
    assert fixed[100].endswith("The liver of the body.")
    assert fixed[107] is None and fixed[108] == ""
    assert scan.find_noise(df.limit(0), ["row_id"]).count() == 0


def test_hyphen_evidence():
    reader = scan.Reader({"understood": 900, "well": 900, "known": 900, "well-known": 90}, set())
    assert [c[2] for c in reader.cuts("under-\nstood")] == ["understood"]
    assert reader.cuts("well-\nknown") == []
    assert reader.numbers(["12", "· 4 ·", "The text ends.", "c", "1. one", "xii", "Page 3"]) == [0, 1, 5, 6]
    assert reader.numbers(["A line of prose.", "One more line here.", "41", "The next page begins", "and goes on.", "The end."]) == [2]
    years = ["Head of a page.", "The list of years was", "1887", "1890", "read in the order", "of the book, and then", "1895", "as before, and so on.", "Last line."]
    assert reader.numbers(years) == []


def test_torn_words():
    reader = scan.Reader({"heart": 900, "such": 900, "an": 900, "a": 900, "fresh": 900, "lines": 900, "in": 900, "to": 900, "into": 900, "li": 3, "attended": 900}, set())
    joined = lambda t: [x for _, _, x in reader.torn(t)]
    assert joined("the external h\ne a r t may") == ["heart"] and joined("suc han") == ["such an"] and joined("af resh") == ["a fresh"]
    assert joined("it li nes") == ["lines"] and joined("in to such a heart") == [] and reader.near("attendjd") == "attended"


def test_two_errors(spark):
    known = {"convulsive": 900, "eruption": 900, "habitual": 900, "and": 900, "of": 900, "the": 900, "lines": 900}
    import pyarrow as pa

    words = ["convuls!veeruption", "habitua1@nd", "o·fthe", "oithe", "ljnesthe", "umbrelore", "ofhhe"]
    got = {r["token"]: r["correction"] for b in scan._two_errors(iter([pa.record_batch({"token": words, "n": [1] * len(words)})]), known, {"oi": "of"}) for r in b.to_pylist()}
    assert got == {"convuls!veeruption": "convulsive eruption", "habitua1@nd": "habitual and", "o·fthe": "of the", "oithe": "of the", "ljnesthe": "lines the"}

# Quality


def test_quality(spark):
    rng = random.Random(1)
    words = "the of and to in a that it was for with kidneys liver tonic patient bark such".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(80, 300))) + ".") for i in range(200)]
    rows += [(900, "\n".join(f"Hinge {i}, {i + 3}" for i in range(80))), (901, "oo " * 90), (902, "|/\\^~" * 60), (903, None), (904, ""), (905, " \n\t")]
    stats = quality.text_statistics(spark.createDataFrame(rows, "row_id int, text string").withColumn("own_words", F.lit("x")), ["row_id"], "text").cache()
    scored = quality.prose_distance(stats, quality.fit_prose(stats)).collect()
    assert sorted(r["row_id"] for r in scored if r["is_prose"] is False) == [900, 901, 902]
    by = {r["row_id"]: r for r in scored}
    assert by[903]["own_words"] == by[905]["own_words"] == 0 and by[903]["distance"] is None and by[905]["own_chars"] == 3
    assert by[901]["own_words"] == 90
    for r in scored[:50]:
        assert sum(r[c] for c in quality.CONTRIBUTIONS) == pytest.approx(r["distance"] ** 2, abs=1e-6)
    assert quality.fit_prose(stats.limit(0))["en"][0].tolist() == quality.DEFAULT_FIT[0]


def test_moments_agree_with_numpy(spark):
    x = np.random.default_rng(2).normal(size=(300, len(quality.FEATURES)))
    df = spark.createDataFrame([("en", *map(float, r)) for r in x], "language string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    n, mean, cov = quality._moments(df)["en"]
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True), atol=1e-5)


# Overlap


def test_index_against_brute_force():
    rng = random.Random(4)
    rows = [[rng.choice("abcd") for _ in range(rng.randint(1, 7))] for _ in range(80)]
    index = overlap.RotationIndex(rows)
    for query in rows[:20] + [["a", "b"], ["d"], ["c", "c", "c"], ["a", "d", "a", "b"]]:
        low, high = np.array([0]), np.array([index.rows + 1])
        for w in reversed(query):
            low, high = index.step(np.array([index.symbol[w]]), low, high)
        ends = [r for r, row in enumerate(rows) if row[-len(query):] == query]
        assert high[0] - low[0] == len(ends)
        before = index.bwt[low[0]:high[0]]
        assert sorted(before[before <= index.rows].tolist()) == [r for r in ends if rows[r] == query]


def _pairs(spark, train, held):
    rows = [(f"t{i}", "train", q) for i, q in enumerate(train)] + [(f"d{i}", "dev", q) for i, q in enumerate(held)]
    return {(r["train_id"], r["held_id"]) for r in overlap.find_overlaps(spark.createDataFrame(rows, "query_id string, split string, question string")).collect()}


def test_opposite_questions_are_no_pairs(spark):
    apart = [
        ("Should the tonic of nithvora be taken before meals?", "Should the tonic of nithvora be taken after meals?"),
        ("Is the plaster laid above the knee for a sprain?", "Is the plaster laid under the knee for a sprain?"),
        ("Does Dr. Hale advise the remedy only once?", "Does Dr. Hale advise the remedy more than once?"),
        ("What eases a pain of the hand from a burn?", "What eases a burn from a pain of the hand?"),
        ("Is pulmar bark given with milk to a sailor?", "Is pulmar bark given without milk to a sailor?"),
        ("Was the root brought to Zelnevkham from Kelmora?", "Was the root brought from Zelnevkham to Kelmora?"),
        ("May 12 grains of olvash be given to a child?", "May 13 grains of olvash be given to a child?"),
        ("Is it not safe to bathe in winter?", "Is it safe to bathe in winter?"),
    ]
    assert _pairs(spark, [a for a, _ in apart], [b for _, b in apart]) == set()


def test_small_differences_are_pairs(spark):
    same = [
        ("Should the tonic of nithvora be taken before meals?", "Please state: ought tonic of Nithvroa be used before the meals"),
        ("Where is the strength of pelkham root set forth for a miner?", "for a miner: where is strngth of pelkham root described?"),
        ("What did the farmer eat, given his dropsy?", "(from the card) given his dropsy: What did the farmer eat"),
        ("Does olvash balsam serve a nurse during the ague?", "Does olvash balsam usually serve nurse in the course of the ague?"),
        ("Cure of gout?", "Question: cure of gouut?"),
    ]
    assert _pairs(spark, [a for a, _ in same], [b for _, b in same]) == {(f"t{i}", f"d{i}") for i in range(len(same))}


def test_words_of_their_own_are_no_slips(spark):
    fill = [f"What {w} of {n}bark is {v} in case {i}?" for i, (w, n, v) in enumerate((w, n, v) for w in ("weight", "height") for n in ("tor", "kel", "zan", "pru") for v in ("noted", "entered"))]
    got = _pairs(spark, fill + ["What weight of umbra resin is noted?"], ["What height of umbra resin is noted?", "What weihgt of umbra resin is noted?"])
    assert got == {("t16", "d1")}


def test_overlap_split_shards(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD_ROWS", 7)
    monkeypatch.setattr(overlap, "BLOCK_ROWS", 5)
    train = [f"What dose of {c}vash bark helps a miner with croup at {c}elby?" for c in ("torvu", "kelmod", "zanni", "prulse", "gimbra", "holqui")]
    assert _pairs(spark, train, [q.replace("miner", "mimer") for q in train]) == {(f"t{i}", f"d{i}") for i in range(6)}


def test_long_and_wordless_questions(spark):
    long = " ".join(f"w{i}x" for i in range(4_000))
    assert _pairs(spark, [long + "?", "Is it the?", "???"], [long.replace("w77x", "w77xx"), "is it THE", "!!!"]) == {("t0", "d0"), ("t1", "d1")}


def test_overlap(spark):
    names = [f"{a}{b}{c}" for a in ("Torvas", "Kelmor", "Zelnev", "Pranum") for b in ("kham", "ford", "wick") for c in ("ora", "ium")]
    rows = [(f"t{i}", "train", f"What dose of {n} bark is given to a miner with dry croup at {n[::-1]}by?") for i, n in enumerate(names)]
    rows += [
        ("d1", " DEV ", rows[0][2].upper()),
        ("d2", "test", "(from the card) " + rows[1][2].replace("miner", "minner").replace("given", "administered")),
        ("d3", "dev", rows[2][2].replace("miner", "weaver")),
        ("d4", "test", rows[3][2].replace("dose", "taste")),
        ("d5", None, rows[4][2]),
        ("d6", "dev", None),
        ("d7", "dev", "  "),
        ("d8", "dev", "at " + names[5][::-1] + "by: " + rows[5][2].replace(" at " + names[5][::-1] + "by", "")),
        ("d1", "dev", rows[0][2].upper()),
        ("x", "other", rows[0][2]),
    ]
    df = spark.createDataFrame(rows, "query_id string, split string, question string").withColumn("side", F.lit(1)).withColumn("text", F.lit("x"))
    assert sorted((r["train_id"], r["held_id"]) for r in overlap.find_overlaps(df).collect()) == [("t0", "d1"), ("t1", "d2"), ("t5", "d8")]
    assert overlap.find_overlaps(df.limit(0)).count() == 0


def test_overlap_hot_questions(spark):
    wards = "quorv zembla tisk lopra mivun dathel sorbin yuncar pelth rovax".split()
    slips = [f"What dose of torvaskham bark for dry croup of a {v}?" for v in ("mner", "miiner", "minor", "imner", "minre", "mineer", "minex", "miber", "mkner", "niner", "zminer", "mimer", "minner", "miiner", "mined", "miher", "mioner", "minerr", "mijer", "monner", "minerx", "mxiner")]
    rows = [("t", "train", "What dose of torvaskham bark for dry croup of a miner?"), ("s", "train", "Cure of gout?"), ("e", "dev", "Cure of gouut?")]
    rows += [(f"d{i}", "dev", q) for i, q in enumerate(slips)] + [(f"w{i}", "dev", f"What dose of torvaskham bark for dry croup of a {w}?") for i, w in enumerate(wards)]
    got = {(r["train_id"], r["held_id"]) for r in overlap.find_overlaps(spark.createDataFrame(rows, "query_id string, split string, question string")).collect()}
    assert got == {("s", "e")} | {("t", f"d{i}") for i, q in enumerate(slips) if overlap.slip("miner", q[:-1].split()[-1])}


def test_slips():
    assert overlap.slip("vaskorum", "vakorum") and overlap.slip("seamstress", "seamtsress") and overlap.slip("chr0nic", "chronic")
    assert not overlap.slip("12", "13") and not overlap.slip("dose", "taste") and not overlap.slip("colour", "odour")


# Splitting


@pytest.mark.parametrize("limit, overlap_words", [(20, 4), (7, 0), (5, 9), (1, 0)])
def test_pieces_cover_the_text(limit, overlap_words):
    rng = random.Random(limit)
    for _ in range(30):
        text = "".join(rng.choice(["word ", "Two. ", "x\n", "end.\n\n", "CHAPTER I\n\n", "\t"]) for _ in range(rng.randint(0, 150)))
        words = text.split()
        pieces = splitting.cuts(text, limit, overlap_words)
        assert bool(pieces) == (len(words) > limit)
        shared = max(0, min(overlap_words, limit - 1))
        for k, (a, b, x, y, _) in enumerate(pieces):
            assert 0 < b - a <= limit and text[x:y].split() == words[a:b]
            assert k == 0 or a == pieces[k - 1][1] - shared
        if pieces:
            assert pieces[0][0] == 0 and pieces[-1][1] == len(words)


def test_edits_stay_local():
    rng = random.Random(5)
    words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 50)) for _ in range(1500)]
    a, b = (splitting.cuts(" ".join(w), 60, 0) for w in (words, words[:20] + ["new"] + words[20:]))
    tail = lambda p, w: {" ".join(w[x:y]) for x, y, *_ in p}
    same = tail(a, words) & tail(b, words[:20] + ["new"] + words[20:])
    assert len(same) > 0.7 * len(a)


def test_split_edges(spark):
    rows = [("a", "s", "w " * 30), ("a", "s", "w " * 30), ("b", "s", None), ("c", "none", "w " * 90), ("d", "s", ""), ("e", "s", "w " * 10), (None, "s", "v " * 11), ("f", None, "w " * 99)]
    df = spark.createDataFrame(rows, "id string, strategy string, text string").withColumn("max_words", F.lit(3)).withColumn("item", F.lit("x"))
    limits = spark.createDataFrame([("s", 10, None)], "strategy string, max_words int, overlap_words int")
    got = splitting.split_oversized(df, limits, "id", "text").collect()
    assert {(r["item_key"], r["n_pieces"]) for r in got} == {("a", len([r for r in got if r["item_key"] == "a"])), (None, 2)}
    assert sum(len(r["text"].split()) for r in got if r["item_key"] == "a") == 30
    assert splitting.split_oversized(df.limit(0), limits, "id", "text").count() == 0


# Neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 96))
    x = (centres[rng.integers(0, 30, 900)] + rng.normal(scale=0.4, size=(900, 96))).astype(np.float32)
    x[10:20] = x[5]  # eleven copies in all
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 96), (1003, [float("nan")] * 96), (1004, [1.0] * 32), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("h", F.lit("x")).withColumn("cos", F.lit(1))
    got = neighbours.nearest(df, "vec_id", "embedding", settings=neighbours.IndexSettings(cell_rows=50, block_rows=200)).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cos = u @ u.T
    np.fill_diagonal(cos, -9)
    found = {}
    for r in got:
        found.setdefault(r["vec_id"], set()).add(r["near_id"])
        assert r["cos"] == pytest.approx(cos[r["vec_id"], r["near_id"]], abs=1e-4)
    assert set(found) == set(range(900)) and all(len(v) == 5 for v in found.values())
    least = np.sort(cos, axis=1)[:, -5]
    recall = np.mean([np.mean([cos[i, j] >= least[i] - 1e-6 for j in found[i]]) for i in range(900)])
    assert recall >= 0.9
    assert found[15] == {5, 10, 11, 12, 13}
    assert neighbours.nearest(df.where("vec_id > 999"), "vec_id", "embedding").count() == 0


# Tokens


def test_encoding_is_that_of_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.default_vocabulary())
    t.encode_special_tokens = True
    rng = random.Random(7)
    texts = ["", None, " ", "\n\n  x", "<|endoftext|>", "don't we'll", "naïve 漢方 🌿👩🏽‍⚕️", "1234567 aaaaaaa", "\u200b\xad\x00", "ab" * 30_000]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 1000), rng.randint(0x3000, 0x9000)])) for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("key", F.lit(3)).withColumn("ids", F.lit(3))
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode_ids(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokenize.token_counts(df, "doc_id", "text").collect()}
    assert sizes == {i: len(v) for i, v in got.items()}
    assert tokenize.encode_ids(df.limit(0), "doc_id", "text").count() == 0


# Mixing


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["big"] * 8 + ["mid", "small"]), rng.randint(1, 200)) for i in range(4000)]
    docs += [(9001, None, 50), (9002, "untargeted", 50), (9003, "big", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").withColumn("share", F.lit("x")).withColumn("rank", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2), ("none", 0.1, 5), ("odd", None, None)], "source string, target_share double, max_repeats int")
    mixture = mixing.mix(df, targets, total_tokens=150_000).cache()
    got = {r["source"]: r for r in mixing.shares(mixture, df, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert got[s]["actual_share"] == pytest.approx(share, abs=0.02)
        assert got[s]["most_copies"] <= {"big": 1, "mid": 3, "small": 2}[s]
    assert got["none"]["tokens_taken"] == got["odd"]["tokens_taken"] == 0
    assert abs(sum(r["tokens_taken"] for r in got.values()) - 150_000) < 600
    assert mixing.mix(df.limit(0), targets).count() == 0
    full = mixing.mix(df, targets, total_tokens=10**9)
    assert {r["source"]: r["copies"] for r in full.select("source", "copies").distinct().collect()} == {"big": 1, "mid": 3, "small": 2}


def test_allocation_keeps_proportions():
    got = mixing.allocate({"a": (0.5, 10, 10), "b": (0.3, 10**6, 1), "c": (0.2, 10**6, 1)}, 100)
    assert got["a"] == 10 and got["b"] == pytest.approx(54) and got["c"] == pytest.approx(36)


# Encodings


@pytest.mark.parametrize("chain", encodings.CHAINS)
def test_chains_round_trip(chain):
    for text in ("naïve café", "Größe", "żółć", "тёплый", "静養"):
        g = encodings.misread(text, chain)
        if g is not None and g != text and "\ufffd" not in g:
            back = encodings.reread(g, chain)
            assert back is None or back == text


def test_garbled(spark):
    clean = "A café and the régime of Größe – don’t exceed it"
    rows = [(i, clean) for i in range(40)]
    for k, chain in enumerate(((("utf-8", "cp1252"),), (("utf-8", "mac_roman"),), (("cp1252", "mac_roman"),), (("mac_roman", "cp1252"),), (("utf-8", "latin-1"), ("utf-8", "latin-1")))):
        rows.append((100 + k, encodings.misread(clean, chain)))
    rows += [(200, None), (201, ""), (202, "plain"), (203, "CAFÉ ├── plates"), (204, "soft\ufffdhyphen"), (205, clean.replace("régime", "rÃ©gime")), (205, clean.replace("régime", "rÃ©gime"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit("x")).withColumn("tokens", F.lit("x"))
    assert sorted(r["doc_id"] for r in encodings.find_garbled(df, "doc_id", "text").collect()) == [100, 101, 102, 103, 104, 204, 205]
    fixed = {r["doc_id"]: r["restored_text"] for r in encodings.restore(df.dropDuplicates(["doc_id"]), "doc_id", "text").collect()}
    assert {fixed[i] for i in (100, 101, 102, 103, 104, 205)} == {clean}
    assert encodings.find_garbled(df.limit(0), "doc_id", "text").count() == 0


def test_garbled_sides_by_real_size(spark, monkeypatch):
    """No side that grows with the data is broadcast because Spark takes it for small; only the chains, a row each."""
    rows = [(i, "Zoë prepared naïve poultices for the hæmorrhage of café owners in 1887") for i in range(20)]
    rows += [(100 + i, encodings.misread(rows[0][1], (("utf-8", "cp1252"),))) for i in range(3)] + [(200, "The ca\ufffde is open to hæmorrhage of Zo\ufffd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plans, write = [], encodings.materialize
    monkeypatch.setattr(encodings, "materialize", lambda d, label: plans.append(d) or write(d, label))
    small = [sorted(map(tuple, f(df, "doc_id", "text").collect())) for f in (encodings.find_garbled, encodings.restore)]
    assert [r[0] for r in small[0]] == [r[0] for r in small[1]] == [100, 101, 102, 200]
    plans.clear()
    monkeypatch.setattr(encodings, "SENT_BYTES", 0, raising=False)
    results = [f(df, "doc_id", "text") for f in (encodings.find_garbled, encodings.restore)]
    joins = [x for d in plans + results for x in d._jdf.queryExecution().sparkPlan().toString().split("\n") if "BroadcastHashJoin" in x]
    assert joins and all("BroadcastHashJoin [chain#" in x for x in joins)
    assert [sorted(map(tuple, d.collect())) for d in results] == small


def test_garbled_copies(spark):
    clean = "Größe und Käse benötigt"
    rows = [(i, f"{clean} {i}") for i in range(12)]
    rows += [(100 + i, encodings.misread(clean, (("mac_roman", "cp1252"),))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in encodings.find_garbled(df, "doc_id", "text").collect()) == list(range(100, 140))
    assert {r["restored_text"] for r in encodings.restore(df, "doc_id", "text").collect()} == {clean}


def test_lost_signs_and_verified_originals(spark):
    """Lost signs come back by the word or the neighbours that fit; every found row has a text and says whether it is whole."""
    clean = "The hæmorrhage of 4½ days – a naïve jalapeño; it costs £27 now, and don’t exceed it"
    rows = [(i, f"{clean}, case {i}") for i in range(30)]
    rows += [(100, f"{clean}, case 7".replace("æ", "\ufffd").replace("–", "\ufffd").replace("£", "\ufffd").replace("’", "\ufffd")), (101, "A w\ufffdrd without a likeness zz\ufffdzz")]
    rows += [(102, encodings.misread("Naïve hæmorrhage of Zoë", (("utf-8", "cp1252"),)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"] for r in encodings.find_garbled(df, "doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in encodings.restore(df, "doc_id", "text").collect()}
    assert found == set(got) == {100, 101, 102}
    assert got[100]["restored_text"] == f"{clean}, case 7" and got[100]["restorable"]
    assert not got[101]["restorable"] and got[102]["restored_text"] == "Naïve hæmorrhage of Zoë"
    assert encodings.restore(df.limit(0), "doc_id", "text").count() == 0


def test_scan_noise_copies(spark):
    rows = [(i, "lantern-1", f"{PROSE * 2}{PROSE[: 60 + i]}") for i in range(40)]
    rows += [(100 + i, "lantern-1", "12\n" + PROSE.replace("liver", "livcr").replace("patient", "paticnt")) for i in range(30)]
    fixed = {r["row_id"]: r["clean_text"] for r in scan.repair(spark.createDataFrame(rows, "row_id int, doc_id string, text string"), ["row_id"]).collect()}
    assert {fixed[i] for i in range(100, 130)} == {PROSE.strip()}
