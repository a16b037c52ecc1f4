"""The k most similar vectors of every vector: inverted file with product quantisation.

Coarse centroids and the codebooks of the residuals are trained on a sample of about
``train_rows`` distinct vectors (the only bound on what is looked at; every row is
indexed). There is a cell for ``cell_rows`` vectors; in large tables cells grow in number and in
size with the square root of the rows, and centroids are searched in two levels, so work grows
as n to the power 1.5 and the centroids sent to tasks stay small. The candidates of a cell
that are ranked exactly grow with the square root of its size. Centroids that lie together form
groups, sized from the sample so that a task holds about ``block_rows`` vectors; a group
that outgrows this, such as a crowded cell, is split into several blocks by hash. Each
vector is sent as a query to the blocks of its ``probes`` nearest cells, once a group; to its own
block it goes once, as query and as entry. In a block, asymmetric distance tables score the
codes of the probed cells, and the best of each cell are ranked again by exact cosine.

Exact copies are collapsed before any exchange and once more in each block, so a vector
that a third of all rows repeat is searched once. Copies come back at the end: each of
them counts as a neighbour of cosine 1, lowest id first.

Defined results: a vector is usable if it has ``dim`` numbers, all finite and not all
zero. Others, null ones among them, are neither queries nor neighbours. Ties of cosine
go to the smaller id. Rows with a null id are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.operators.vectors import Cells, cell_count, kmeans, train_cells
from quireflow.runtime import materialize


#: Parts that the copies of one vector are divided into.
SALTS = 32


@dataclass(frozen=True)
class IndexSettings:
    dim: int = 96
    #: Size of the training sample: so many vectors, or so many a cell, up to the bound.
    train_rows: int = 20_000
    train_rows_a_cell: int = 8
    most_train_rows: int = 400_000
    #: Vectors a coarse cell holds on average, up to ``knee`` rows; beyond, cells grow with the square root of the rows.
    cell_rows: int = 200
    knee: int = 400_000
    parts: int = 12
    codes: int = 64
    probes: int = 5
    #: Candidates of a cell that are ranked exactly: so many, and this times the square root of its size.
    rerank: int = 64
    rerank_root: float = 4.5
    block_rows: int = 16_000
    seed: int = 17


@dataclass
class Quantizer:
    """What training gives: tens of MB at most, for cells grow with the square root of the rows."""

    cells: Cells
    books: np.ndarray
    group_of_cell: np.ndarray
    blocks_of_group: np.ndarray
    settings: IndexSettings = field(default_factory=IndexSettings)

    @property
    def centroids(self) -> np.ndarray:
        return self.cells.centroids

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        s, rest = self.settings, x - self.centroids[cell]
        sub = s.dim // s.parts
        out = np.empty((len(x), s.parts), np.uint8)
        for m in range(s.parts):
            b = self.books[m]
            out[:, m] = (rest[:, m * sub : (m + 1) * sub] @ b.T - 0.5 * (b**2).sum(1)).argmax(1)
        return out


def halve(centroids: np.ndarray, weight: np.ndarray, cells: np.ndarray, most: float, groups: list[np.ndarray]) -> None:
    """Splits cells across their widest direction until a group weighs at most ``most``."""
    if len(cells) == 1 or weight[cells].sum() <= most:
        groups.append(cells)
        return
    x = centroids[cells] - centroids[cells].mean(0)
    along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
    order = cells[np.argsort(along)]
    run = np.cumsum(weight[order])
    cut = int(np.clip(np.searchsorted(run, run[-1] / 2), 1, len(order) - 1))
    halve(centroids, weight, order[:cut], most, groups)
    halve(centroids, weight, order[cut:], most, groups)


def train(sample: np.ndarray, rows: int, s: IndexSettings) -> Quantizer:
    """Cells, codebooks and the plan of blocks for an index of ``rows`` vectors."""
    rng = np.random.default_rng(s.seed)
    coarse = train_cells(sample, min(len(sample) // 4 or 1, cell_count(rows, s.cell_rows, s.knee)), 8, rng)
    c = coarse.centroids
    cell = coarse.nearest(sample, 1)[:, 0]
    rest, sub = sample - c[cell], s.dim // s.parts
    part = rest[rng.choice(len(rest), min(len(rest), 8_000), replace=False)]
    books = np.zeros((s.parts, s.codes, sub), np.float32)
    for m in range(s.parts):
        b = kmeans(part[:, m * sub : (m + 1) * sub], s.codes, 6, rng)
        books[m, : len(b)] = b
        books[m, len(b) :] = b[0]
    weight = (np.bincount(cell, minlength=len(c)) + 0.5) * (rows / len(sample))
    groups: list[np.ndarray] = []
    halve(c, weight, np.arange(len(c)), s.block_rows, groups)
    of = np.empty(len(c), np.int32)
    for g, cells in enumerate(groups):
        of[cells] = g
    blocks = np.array([max(1, math.ceil(weight[cells].sum() / s.block_rows)) for cells in groups], np.int32)
    coarse.centroids = c.astype(np.float32)
    return Quantizer(coarse, books, of, blocks, s)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of float32."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _usable(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """(h, v, ids, n): unit vectors, distinct within the batch, with the six lowest ids and the number of copies, and all ids beyond six."""
    for batch in batches:
        kept: dict[bytes, list[int]] = {}
        for i, e in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)):
            if i is None or e is None or len(e) != dim:
                continue
            x = np.asarray(e, np.float64)
            top = np.abs(x).max()
            if not np.isfinite(x).all() or not top > 0:
                continue
            x = x / top  # no overflow of the squares
            kept.setdefault((x / np.sqrt(x @ x)).astype(np.float32).tobytes(), []).append(i)
        ids = [sorted(x) for x in kept.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashlib.md5(v).digest() for v in kept], pa.binary()), pa.array(list(kept), pa.binary()), pa.array(ids, pa.list_(pa.int64()))],
            ["h", "v", "ids"],
        )


def _route(batches: Iterator[pa.RecordBatch], q: Quantizer) -> Iterator[pa.RecordBatch]:
    """Rows for the blocks: a vector to be indexed has its cell in ``own``; ``cells`` are those of that group it probes."""
    s = q.settings
    for batch in batches:
        if not batch.num_rows:
            continue
        hs, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        near = q.cells.nearest(_matrix(batch.column(1), s.dim), s.probes)
        salt = np.array([int.from_bytes(h[:4], "big") for h in hs])
        rows: list[tuple] = []
        for i in range(len(hs)):
            mine = int(q.group_of_cell[near[i, 0]])
            groups = q.group_of_cell[near[i]]
            for g in np.unique(groups).tolist():
                cells = near[i][groups == g].astype("<u4").tobytes()
                for b in range(int(q.blocks_of_group[g])):
                    entry = g == mine and b == int(salt[i] % q.blocks_of_group[g])
                    rows.append((g, b, int(near[i, 0]) if entry else -1, hs[i], vs[i], cells))
        names = ["grp", "block", "own", "h", "v", "cells"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for a in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 20_000]), types)], names)


def _distinct(h: list[bytes]) -> np.ndarray:
    return np.array(list({x: i for i, x in enumerate(h)}.values()), np.int64)


def search_block(table: pa.Table, q: Quantizer, k: int, min_cos: float) -> pa.Table:
    """The best ``k`` of a block for each of its queries."""
    s = q.settings
    base, ask = table.filter(pa.array(table.column("own").to_numpy() >= 0)), table
    empty = pa.table({"h": pa.array([], pa.binary()), "near": pa.array([], pa.binary()), "cos": pa.array([], pa.float32())})
    if not base.num_rows or not ask.num_rows:
        return empty
    bh, ah = base.column("h").to_pylist(), ask.column("h").to_pylist()
    bi, ai = _distinct(bh), _distinct(ah)
    bh, ah = [bh[i] for i in bi], [ah[i] for i in ai]
    base, ask = base.take(pa.array(bi)).combine_chunks(), ask.take(pa.array(ai)).combine_chunks()
    bx, ax = _matrix(base.column("v"), s.dim), _matrix(ask.column("v"), s.dim)
    cell = base.column("own").to_numpy().astype(np.int64)
    codes = q.encode(bx, cell)
    probed = ask.column("cells").to_pylist()
    count = np.array([len(p) // 4 for p in probed])
    p_cell = np.frombuffer(b"".join(probed), "<u4").astype(np.int64)
    p_row = np.repeat(np.arange(len(ax)), count)
    sub = s.dim // s.parts
    tables = np.einsum("qmd,mkd->mqk", ax.reshape(len(ax), s.parts, sub), q.books, optimize=True).astype(np.float32)
    by_cell, by_probe = np.argsort(cell, kind="stable"), np.argsort(p_cell, kind="stable")
    c_sorted, p_sorted = cell[by_cell], p_cell[by_probe]
    self_row = {h: i for i, h in enumerate(bh)}
    self_of = np.array([self_row.get(h, -1) for h in ah])
    got_q, got_b = [], []
    floor = min_cos - 0.3 if min_cos > -1 else -9.0  # the scores are off by what the codes lose
    for c in np.unique(c_sorted):
        members = by_cell[np.searchsorted(c_sorted, c) : np.searchsorted(c_sorted, c, "right")]
        asking = p_row[by_probe[np.searchsorted(p_sorted, c) : np.searchsorted(p_sorted, c, "right")]]
        for a in range(0, len(asking), 2_000):
            rows = asking[a : a + 2_000]
            score = np.repeat((ax[rows] @ q.centroids[c])[:, None], len(members), 1)
            for m in range(s.parts):
                score += tables[m][rows][:, codes[members, m]]
            score[self_of[rows][:, None] == members[None, :]] = -9.0
            most = max(s.rerank, math.ceil(s.rerank_root * math.sqrt(len(members))))
            if len(members) > most:
                top = np.argpartition(-score, most - 1, axis=1)[:, :most]
            else:
                top = np.broadcast_to(np.arange(len(members)), score.shape)
            keep = np.take_along_axis(score, top, 1) > floor
            got_q.append(np.repeat(rows, keep.sum(1)))
            got_b.append(members[top[keep]])
    qi, di = np.concatenate(got_q), np.concatenate(got_b)
    if not len(qi):
        return empty
    cos = np.empty(len(qi), np.float32)
    for a in range(0, len(qi), 50_000):
        cos[a : a + 50_000] = np.einsum("ij,ij->i", ax[qi[a : a + 50_000]].astype(np.float64), bx[di[a : a + 50_000]].astype(np.float64))
    ok = cos >= min_cos - 1e-6
    qi, di, cos = qi[ok], di[ok], cos[ok]
    order = np.lexsort((di, -cos, qi))
    qi, di, cos = qi[order], di[order], cos[order]
    first = np.searchsorted(qi, qi)
    best = np.arange(len(qi)) - first < k
    return pa.table({"h": pa.array([ah[i] for i in qi[best]], pa.binary()), "near": pa.array([bh[i] for i in di[best]], pa.binary()), "cos": pa.array(cos[best])})


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, min_cos: float = -1.0, settings: IndexSettings | None = None) -> DataFrame:
    """(``vec_id``, ``near_id``, ``cos``): the ``k`` nearest of each usable vector, those of cosine ``min_cos`` or more."""
    s = settings or IndexSettings()
    own = df.select(df[key].cast("bigint").alias("id"), df[vector].cast("array<float>").alias("e"))
    kinds = "h binary, v binary, ids array<bigint>"
    distinct = lambda x: x.mapInArrow(lambda b: _usable(b, s.dim), kinds)
    rows = own.count()
    wanted = min(s.most_train_rows, max(s.train_rows, s.train_rows_a_cell * cell_count(rows, s.cell_rows, s.knee)))
    # A hash of the id tells the sample, with no sort and no exchange.
    grain = 1 << 30
    sample = distinct(own.where(F.pmod(F.xxhash64("id", F.lit(s.seed)), F.lit(grain)) < math.ceil(min(1.0, wanted / max(rows, 1)) * grain))).select("h", "v").toArrow()
    if not sample.num_rows:
        return df.sparkSession.createDataFrame([], "vec_id bigint, near_id bigint, cos float")
    at = _distinct(sample.column("h").to_pylist())
    x = _matrix(sample.take(pa.array(at)).column("v").combine_chunks(), s.dim)
    model = df.sparkSession.sparkContext.broadcast(train(x, rows, s))
    # The ids of each vector are written once; the vectors themselves go straight to their blocks.
    members = materialize(distinct(own).select("h", "ids"), "vector-ids")
    found = (
        distinct(own).select("h", "v")
        .mapInArrow(lambda b: _route(b, model.value), "grp int, block int, own int, h binary, v binary, cells binary")
        .groupBy("grp", "block")
        .applyInArrow(lambda t: search_block(t, model.value, k, min_cos), "h binary, near binary, cos float")
    )
    # Members of each class of copies: the k + 1 lowest ids and the number; first by task, so that no list grows with the copies.
    low = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k + 1)
    classes = (
        members.groupBy("h", (F.spark_partition_id() % 64).alias("salt")).agg(low(F.slice("ids", 1, k + 1)).alias("low"), F.sum(F.size("ids")).alias("n"))
        .groupBy("h").agg(low("low").alias("low"), F.sum("n").alias("n"))
    )
    best = (
        found.join(classes.select(F.col("h").alias("near"), F.col("low").alias("near_low")), "near")
        .groupBy("h")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cos")).alias("minus"), "near_low"))), 1, k).alias("best"))
    )
    one = F.struct(F.lit(-1.0).cast("float").alias("minus"), F.col("low").alias("near_low"))
    lists = (
        classes.join(best, "h", "left")
        .withColumn("all", F.concat(F.array(one), F.coalesce("best", F.slice(F.array(one), 1, 0))))
        .withColumn("all", F.flatten(F.transform("all", lambda x: F.transform(x["near_low"], lambda i: F.struct(x["minus"].alias("minus"), i.alias("id"))))))
        .select("h", "low", "n", "all")
    )
    lists = materialize(lists, "vector-lists")
    few = lists.select(F.explode("low").alias("vec_id"), "all")
    # Classes with more copies than that: their lists are laid out under salts, so that the ids of one vector do not meet in one task.
    many = lists.where(F.col("n") > k + 1).select("h", F.col("low").alias("out"), "all", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rest = (
        members.select("h", F.explode("ids").alias("vec_id")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
        .join(many, ["h", "salt"]).where(~F.array_contains("out", F.col("vec_id"))).select("vec_id", "all")
    )
    return (
        few.unionByName(rest)
        .select("vec_id", F.explode(F.slice(F.filter("all", lambda x: x["id"] != F.col("vec_id")), 1, k)).alias("x"))
        .select("vec_id", F.col("x.id").alias("near_id"), (-F.col("x.minus")).alias("cos"))
    )
