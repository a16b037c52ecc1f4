"""Operators over words, transcripts, files and searches against brute force and hand-made cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.operators import aggregates as A
from quireflow.operators import metrics as M
from quireflow.operators import recovery as V
from quireflow.operators import retrieval as R
from quireflow.operators import transcripts as X
from quireflow.operators import vectors, wordboxes
from quireflow.plans import catalog
from quireflow.sources import jsonl
from tests.oracle import duck


def test_reading_order_and_labels(spark):
    words = [(1, i, t, x, y, x + 5.0, y + 3.0) for i, (t, x, y) in enumerate([("b", 30.0, 1.0), ("a", 10.0, 4.0), ("c", 5.0, 6.5), ("Fig.", 1.0, 20.0), ("-", 8.0, 20.0), ("45,", 15.0, 20.0), ("F1g, 290", 30.0, 20.0), ("Flg. 7", 40.0, 20.0)])]
    words += [(2, 0, None, 1.0, 1.0, 2.0, 2.0), (2, 1, "Fig.", 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(words, "page int, idx int, text string, x0 double, y0 double, x1 double, y1 double")
    order = {(r["page"], r["idx"]): (r["line"], r["place"]) for r in wordboxes.reading_order(df, 5.0).collect()}
    # The third word lies within the tolerance of the one before but not of the first of the line.
    assert [order[1, i] for i in range(3)] == [(0, 1), (0, 0), (1, 0)] and (2, 0) not in order
    labels = sorted((r["page"], r["number"], r["x0"], r["x1"]) for r in wordboxes.figure_labels(df, 5.0).collect())
    assert labels == [(1, 7, 40.0, 45.0), (1, 45, 1.0, 20.0)]
    assert wordboxes.reading_order(df.limit(0), 5.0).count() == 0


def test_captions_are_used_once(spark):
    figures = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 0, 30, 10, 40)], "page int, idx int, x0 int, y0 int, x1 int, y1 int")
    captions = spark.createDataFrame([(1, 5, 0, 12, 10, 14), (1, 6, 0, 60, 10, 62), (1, 7, 50, 12, 60, 14)], "page int, idx int, x0 int, y0 int, x1 int, y1 int")
    got = sorted((r["f_idx"], r["c_idx"], r["gap"]) for r in wordboxes.bind_captions(figures, captions, 100).collect())
    assert got == [(0, 5, 2), (1, 6, 20)]


def test_regions_without_figures_against_a_raster():
    rng = random.Random(3)
    box = lambda i: (i, *(lambda a, b: (min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]) + 1, max(a[1], b[1]) + 1))((rng.randint(0, 19), rng.randint(0, 19)), (rng.randint(0, 19), rng.randint(0, 19))))
    for _ in range(40):
        region, figures = box(0), [box(i) for i in range(rng.randint(0, 4))]
        raster = np.zeros((21, 21), int)
        raster[region[2]:region[4], region[1]:region[3]] = 1
        for f in figures:
            raster[f[2]:f[4], f[1]:f[3]] = 0
        seen = np.zeros((21, 21), int)
        for _, x0, y0, x1, y1 in wordboxes._left_of([region], figures):
            seen[y0:y1, x0:x1] += 1
        assert (seen == raster).all()


def test_detection_scores(spark):
    make = lambda rows: spark.createDataFrame(rows, "page int, idx int, x0 int, y0 int, x1 int, y1 int")
    found, truth = make([(1, 0, 0, 0, 10, 10), (1, 1, 50, 50, 60, 60), (2, 0, 0, 0, 5, 5)]), make([(1, 0, 0, 0, 10, 12), (3, 0, 0, 0, 5, 5)])
    r = wordboxes.detection_scores(found, truth).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 1) and r["mean_iou"] == pytest.approx(10 / 12) and r["f1"] == pytest.approx(2 / 5)
    p = wordboxes.page_presence(found, truth).first()
    assert (p["tp"], p["fp"], p["fn"], p["precision"]) == (1, 1, 1, 0.5)
    assert wordboxes.detection_scores(found.limit(0), truth.limit(0)).first()["f1"] == 0.0


def test_merged_pieces():
    a, b = "x" * 10 + "the end of the first piece of the text", "the end of the first piece of the text goes on"
    assert X.merged_pieces([a, b]) == "x" * 10 + b
    assert X.merged_pieces(["one", None, " ", "two"]) == "one\ntwo" and X.merged_pieces([]) == ""
    text = " ".join(f"word{i}" for i in range(900))
    assert X.merged_pieces([text[i : i + 300] for i in range(0, len(text), 150)]) == text


def test_book_chunks(spark):
    para = lambda n, end=".": ("w%d " % n) * (300 // 4) + "end" + end
    rows = [
        ("b", 1, "s", "prose", f"{para(1)}\n\n[FIGURE 3]\n\n{para(2, '')}"),
        ("b", 2, "s", "prose", f"goes on here. {para(3)}\n\n{para(4)}"),
        ("b", 3, "s", "index", "Index, 4"),
        ("b", 4, "s", "prose", para(5)),
        ("b", 5, "t", "prose", "A tail."),
        ("b", 6, "t", None, None),
        ("c", 1, None, "prose", "Short."),
        (None, 1, "s", "prose", "lost"),
    ]
    df = spark.createDataFrame(rows, "book string, page int, section string, kind string, text string").withColumn("run", F.lit("x"))
    got = X.book_chunks(df, "book", "page", "section", "kind", "text").orderBy("book", "chunk_no").collect()
    b = [r for r in got if r["book"] == "b"]
    assert [(r["chunk_no"], r["first_page"], r["last_page"]) for r in b][0] == (1, 1, 2)  # the divided paragraph carries both pages
    assert b[1]["overlap_chars"] == X.OVERLAP and b[1]["text"].startswith(b[0]["text"][-X.OVERLAP:].strip()[:40])
    assert b[-1]["first_page"] == 4 and b[-1]["last_page"] == 5 and b[-1]["text"].endswith("A tail.") and b[-1]["overlap_chars"] == 0
    assert "FIGURE" not in "".join(r["text"] for r in got) and "Index" not in "".join(r["text"] for r in got)
    assert [(r["text"], r["chunk_no"]) for r in got if r["book"] == "c"] == [("Short.", 1)]
    assert X.book_chunks(df.limit(0), "book", "page", "section", "kind", "text").count() == 0


def test_split_long():
    text = " ".join(f"Sentence number {i} ends." for i in range(200))
    pieces = X.split_long(text, 500)
    assert " ".join(pieces) == text and max(map(len, pieces)) <= 500 and X.split_long("x" * 3000) == ["x" * 3000]


def test_readers(spark):
    lines = lambda rows: spark.createDataFrame(rows, "path string, line_no int, value string")
    with pytest.raises(Exception, match="f.jsonl:2"):
        jsonl.parsed(lines([("f.jsonl", 1, '{"a": 1}'), ("f.jsonl", 2, "{broken")]), "a int", strict=True).select("row").collect()
    words = lines([("f", i, v) for i, v in enumerate(['{"page_id": "p1", "text": "a", "bbox_norm": [0.1, 0.1, 0.2, 0.2]}', '{"page_id": "p1", "text": "b", "bbox_norm": [0.1, 0.1, 0.1, 0.2]}', '{"page_id": "p1", "text": "c", "bbox_norm": [0.1, 0.1, 1.2, 0.2]}', '{"page_id": "p1", "text": "d"}', ""])])
    assert [r["text"] for r in jsonl.reference_words(words).collect()] == ["a"]
    texts = lines([("f", 2, '{"book_page": "7", "content": "second", "label": "Text"}'), ("f", 1, '{"page_id": "p0007", "text": "first"}'), ("f", 3, '{"book_page": "7", "content": "x", "label": "Figure"}')])
    assert [(r["page_id"], r["text"]) for r in jsonl.page_texts(texts).collect()] == [("p0007", "first\nsecond")]
    kinds = {r["path"]: r["kind"] for r in jsonl.sniffed(lines([("a", 1, '{"page_id": "x", "text": "y"}'), ("b", 1, '{"question": "x"}'), ("c", 1, "not json")])).collect()}
    assert kinds == {"a": "pages", "b": "queries", "c": "other"}


def test_corpus_or_blocks(spark):
    block = '{"page_id": "p0002", "bbox": [0, 0, 1, 1], "page_box": [0, 0, 1, 1], "label": "text", "content": "<b>hi</b>"}'
    lines = spark.createDataFrame([(block,)], "value string")
    one = spark.createDataFrame([("p0001", "t", "x")], "page_id string, text string, ocr_source string")
    assert [r["text"] for r in jsonl.corpus_or_blocks([one], 1, lines, ["content"], 1, 2).collect()] == ["t"]
    assert sorted(tuple(r) for r in jsonl.corpus_or_blocks([one], 2, lines, ["content"], 1, 2).collect()) == [("p0001", "", "missing"), ("p0002", "hi", "blocks")]


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_percentiles(spark, n):
    rng = np.random.default_rng(n)
    rows = [("a", float(v)) for v in rng.integers(0, 40, n)] + [("b", None), (None, 3.0)] + [("c", 5.0)] * n
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"low": 0.0, "third": 1 / 3, "most": 0.9, "high": 1.0}
    got = {r["g"]: r for r in A.exact_percentiles(df, ["g"], "v", shares).collect()}
    for name, p in shares.items():
        assert got["a"][name] == pytest.approx(np.quantile([v for g, v in rows if g == "a"], p))
        assert got["c"][name] == 5.0 and got[None][name] == 3.0
    assert "b" not in got and A.exact_percentiles(df.limit(0), ["g"], "v", shares).count() == 0


HUNDREDTHS = [float(v) / 100 for v in np.random.default_rng(5).integers(0, 40_000, 300)]


@pytest.mark.parametrize("values", [HUNDREDTHS, [0.1, 0.7], [3.0], [], [None, None], [1.0, None, float("inf"), 2.5, float("-inf"), 7.1, float("inf")], [0.3, float("nan"), 0.1, float("-inf")]])
def test_percentiles_to_the_last_digit(spark, tmp_path, values):
    """a15_percentiles and its SQL on the same files, with no digit rounded off."""
    spark.createDataFrame([(v,) for v in values], "value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = catalog()
    found = [r["ps"] for r in c.queries["a15_percentiles"](spark, str(tmp_path)).collect()]
    assert repr(found) == repr([r[0] for r in duck(tmp_path).sql(c.sql["a15_percentiles"]).fetchall()])


def test_exact_search_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (300, 8)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "id bigint, v array<double>")
    want = {(q, j) for q in range(0, 300, 10) for j in np.lexsort((np.arange(300), -(x @ x[q])))[:5]}
    for size in (R.PASS_QUERIES, 7):
        monkeypatch.setattr(R, "PASS_QUERIES", size)
        got = R.exact_top_k(df, df.where("id % 10 = 0 AND id < 300"), "id", "v", 5)
        assert {(r["query_id"], r["item_id"]) for r in got.collect()} == want
    assert R.exact_top_k(df, df.limit(0), "id", "v").count() == 0 and R.exact_top_k(df.limit(0), df, "id", "v").count() == 0


def test_ivf_recall(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ITEMS", 40)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    x = centres[rng.integers(0, 20, 1500)] + rng.normal(scale=0.5, size=(1500, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    asked = df.where("id % 50 = 0")
    near = R.agreement(R.exact_top_k(df, asked, "id", "v"), R.ivf_top_k(df, asked, "id", "v"))
    assert near.agg(F.avg("agreement")).first()[0] >= 0.9
    assert R.ivf_top_k(df.limit(0), asked, "id", "v").count() == 0


def test_hashed_vectors_do_not_sum_for_every_place(spark):
    texts = spark.createDataFrame([(1, "oak bark oak"), (2, "elm"), (3, None)], "i int, t string")
    vectors_ = R.hashed_vectors(texts, "i", "t")
    raw = {r["i"]: np.array(r["vector"]) for r in R.hashed_vectors(texts, "i", "t", unit_length=False).collect()}
    for r in vectors_.collect():
        assert np.allclose(r["vector"], raw[r["i"]] / np.linalg.norm(raw[r["i"]]))
    # No sum over the vector stands within another function over it.
    assert "aggregate(" not in vectors_._jdf.queryExecution().optimizedPlan().toString().lower().replace("hashaggregate(", "")


def test_two_level_cells():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    cells = vectors.train_cells(x, 3000, 3, rng)
    assert cells.top is not None and cells.first[-1] == len(cells.centroids)
    near = cells.nearest(x[:200], 3)
    best = vectors.nearest_centroid(x[:200], cells.centroids)
    assert np.mean(near[:, 0] == best) > 0.9 and all(len(set(r)) == 3 for r in near.tolist())


def test_bm25_reads_any_script(spark):
    items = spark.createDataFrame([(1, "тёплый отвар"), (2, "жёлтый отвар коры"), (3, None), (4, "")], "i int, t string")
    asked = spark.createDataFrame([("q", "Тёплый!")], "q string, t string")
    assert [r["item_id"] for r in R.bm25(items, asked, "i", "t", "q", "t").collect()] == [1]


def _shuffled_rows(spark):
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_bm25_exchanges_no_pairs(spark):
    items = spark.range(2000).selectExpr("id", "concat('the leaf of number', id % 97, ' and number', id % 89) AS t")
    asked = spark.range(600).selectExpr("id AS q", "concat('the number', id % 97, ' of number', id) AS t")
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    before = _shuffled_rows(spark)
    assert R.bm25(items, asked, "id", "t", "q", "t").count() == 6000
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    assert _shuffled_rows(spark) - before < 100_000  # of 1,200,000 pairs that share a term


def test_bm25_counts_rows_of_one_id_together_and_breaks_ties_by_id(spark):
    rows = [(i, f"bark {'dose ' * (i % 3)}") for i in range(40)] + [(7, "bark of the oak, of the elm"), (8, None), (None, "dose"), (None, "oak dose")]
    items = spark.createDataFrame(rows, "i int, t string")
    asked = spark.createDataFrame([("a", "Dose of bark?"), ("b", "bark of (dose)"), ("c", "unheard"), ("d", None), ("e", "the bark"), ("e", "the oak")], "q string, t string")
    found = {(r["query_id"], r["rank"]): (r["item_id"], r["score"]) for r in R.bm25(items, asked, "i", "t", "q", "t").collect()}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).extend("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    mean = sum(map(len, texts.values())) / len(rows)
    for q, words in (("a", {"dose", "of", "bark"}), ("b", {"bark", "of", "dose"}), ("c", {"unheard"}), ("d", set()), ("e", {"the", "bark", "oak"})):
        df = {w: sum(w in x for x in texts.values()) for w in words}
        score = {i: round(sum(np.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in words if w in x), 6) for i, x in texts.items() if i is not None}
        best = sorted(((-s, i) for i, s in score.items() if s > 0))[:10]
        assert [found.get((q, n + 1)) for n in range(len(best))] == [(i, pytest.approx(-s)) for s, i in best] and (q, len(best) + 1) not in found


@pytest.mark.parametrize("name,rows", [("e12_select_best", [("single", 1.0, 1.0)]), ("e9_page_metrics", [("q1", 1), ("q2", 1), ("q50", 1)])])
def test_metrics_of_pages_take_all_questions(spark, tmp_path, name, rows):
    texts = [(1, "d", "oak bark", ["p1"]), (2, "d", "elm leaf", ["p2"])]
    spark.createDataFrame(texts, "row_id bigint, doc_id string, text string, page_ids array<string>").write.parquet(str(tmp_path / "chunks.parquet"))
    asked = [("q1", "single", "oak?", "d", ["p1"]), ("q2", "single", "a leaf", "d", ["p2"]), ("q50", "zweifold", "the bark", "d", ["p1", "p2"])]
    spark.createDataFrame(asked, "query_id string, type string, question string, doc_id string, page_ids array<string>").write.parquet(str(tmp_path / "retrieval_queries.parquet"))
    found = catalog().queries[name](spark, str(tmp_path))
    assert sorted(tuple(r) for r in (found.select("query_id", "hit_at_1") if name[:2] == "e9" else found).collect()) == rows


def test_best_threshold_and_selection(spark):
    scores = spark.createDataFrame([(0.9, False), (0.8, False), (0.3, True), (0.2, True)], "score double, is_negative boolean")
    r = M.best_threshold(scores).first()
    assert 0.3 < r["tau"] <= 0.8 and r["objective"] == pytest.approx(2.0)
    models = spark.createDataFrame([("b", 1.0, 0.5, 0.5, 0.5, 3.0), ("a", 1.0, 0.5, 0.5, 0.5, 2.0), ("c", 0.9, 1.0, 1.0, 1.0, 0.0)], "model string, r5 double, mrr double, coverage double, span double, latency double")
    assert M.select_best(models, "model").first()["model"] == "a"


def test_text_forms(spark):
    df = spark.createDataFrame([("\n\nA line\n\n", "Fig. 45", "FIrst<b>&amp;"), ("ab\xad\n  cd\ne", "x", None)], "t string, l string, c string")
    got = df.select(T.historical("t").alias("h"), T.label_number("l").alias("n"), T.category_form("c").alias("c")).collect()
    assert [r["h"] for r in got] == ["A line", "abcd e"] and [r["n"] for r in got] == [45, None] and got[0]["c"] == "first b amp"


def test_first_complete(spark):
    parents = spark.createDataFrame([("p", 3, 2), ("p", 1, 2), ("p", 0, 1), ("q", 5, 0)], "page string, row int, expected int")
    children = spark.createDataFrame([("p",), ("p",)], "page string")
    assert sorted((r["page"], r["row"]) for r in V.first_complete(parents, children, ["page"], "expected", "row").collect()) == [("p", 1), ("q", 5)]


def test_machine_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from quireflow.runtime import shared_dir

    conf = SimpleNamespace(get=lambda k, d=None: {"spark.master": "spark://host:7077"}.get(k, d))
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf))


def test_pipeline_parts(spark):
    from quireflow.plans.pipeline import Pipeline, Registry, scored

    def tidy(df):
        return df.where("x > 1")

    p = Pipeline().at("after_ocr", tidy).at("after_load", tidy)
    assert p.manifest() == [("after_load", 0, "tidy"), ("after_ocr", 0, "tidy")]
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert p.run(df).count() == 2
    made = scored(df, {"twice": lambda d: d.where("x < 3").select("x", (F.col("x") * 2.0).alias("score"))}, ["x"])
    assert sorted(tuple(r) for r in made.collect())[:2] == [(1, 2.0), (2, 4.0)] and made.where("twice IS NULL").count() == 1
    r, engine = Registry(), lambda: None
    broken = lambda: None
    broken.probe = lambda: "no weights"
    r.add("a", engine)
    r.add("b", broken)
    assert r.status() == {"a": "ready", "b": "no weights"}


def test_gated_search(spark):
    hits = spark.createDataFrame([("a", 1, 0.9), ("b", 11, 0.6), ("c", 1, 0.1), ("d", 40, 0.56)], "query_id string, rank int, score double")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "query_id string")
    got = {r["query_id"]: (r["k_used"], r["abstains"]) for r in R.gated_search(asked, hits).collect()}
    assert got == {"a": (10, False), "b": (20, False), "c": (40, True), "d": (40, False), "e": (40, True)}
