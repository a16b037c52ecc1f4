"""Encoding of text columns with a public byte-level BPE, by corpus-level merge replay.

The distinct words of a block of documents form one flat array of symbols. An inverted
index leads from each pair of adjacent symbols to the positions where it stands. Merges
are applied in rank order, each to all its positions at once, and only the pairs with
the touched neighbours are entered anew. A merge can only give rise to pairs of higher
rank, so one pass in rank order equals the usual word-by-word encoding.

Blocks lie within a task, so the operator needs no shuffle at all and its memory is
bounded by ``BLOCK_CHARS`` and ``CACHE_WORDS`` whatever the size of the corpus.

Defined results: a null text and an empty text both give an empty list. Other columns
of the input never reach Python; rows that repeat are encoded as often as they stand.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern by which byte-level BPE vocabularies of this kind split text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of text whose new words are merged together.
BLOCK_CHARS = 2_000_000
#: Encoded words kept in a task; beyond it the memory of words starts anew.
CACHE_WORDS = 300_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k in the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b if b in printable else next(moved)) for b in range(256)]


class MergeReplay:
    """Vocabulary with its ranked merges; encodes many distinct words at a time."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.of_byte = [vocab[c] for c in byte_alphabet()]
        self.rank: dict[tuple[int, int], int] = {}
        self.result: list[int] = []
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[vocab[a], vocab[b]] = r
            self.result.append(vocab[a + b])
        self.pairs = list(self.rank)

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        of_byte, rank_of, result = self.of_byte, self.rank, self.result
        symbols: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(symbols))
            symbols.extend([of_byte[b] for b in w.encode("utf-8")])
            symbols.append(-1)  # no pair crosses the end of a word
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        for i in range(n - 1):
            r = rank_of.get((symbols[i], symbols[i + 1]))
            if r is not None:
                places.setdefault(r, []).append(i)
        todo = list(places)
        heapq.heapify(todo)
        by_rank = self.pairs
        while todo:
            r = heapq.heappop(todo)
            a, b = by_rank[r]
            new = result[r]
            at = places.pop(r)
            at.sort()
            for i in at:
                if symbols[i] != a:
                    continue
                j = after[i]
                if j >= n or symbols[j] != b:
                    continue
                symbols[i] = new
                symbols[j] = -2  # swallowed
                k = after[j]
                after[i] = k
                if k < n:
                    before[k] = i
                    q = rank_of.get((new, symbols[k]))
                    if q is not None:
                        if q in places:
                            places[q].append(i)
                        else:
                            places[q] = [i]
                            heapq.heappush(todo, q)
                h = before[i]
                if h >= 0:
                    q = rank_of.get((symbols[h], new))
                    if q is not None:
                        if q in places:
                            places[q].append(h)
                        else:
                            places[q] = [h]
                            heapq.heappush(todo, q)
        ends = [*starts[1:], n]
        return [[s for s in symbols[x : y - 1] if s >= 0] for x, y in zip(starts, ends)]


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, counts_only: bool) -> Iterator[pa.RecordBatch]:
    replay = MergeReplay(path)
    split = regex.compile(SPLIT).findall
    known: dict[str, list[int]] = {}
    for batch in batches:
        keys, texts = batch.columns[:-1], batch.column(batch.num_columns - 1).to_pylist()
        names = batch.schema.names[:-1]
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= BLOCK_CHARS):
                size += len(texts[stop] or "")
                stop += 1
            words = [split(t) if t else [] for t in texts[start:stop]]
            if len(known) > CACHE_WORDS:
                known.clear()
            new = list({w for ws in words for w in ws if w not in known})
            if new:
                known.update(zip(new, replay.encode(new)))
            if counts_only:
                sizes = pa.array([sum([len(known[w]) for w in ws]) for ws in words], pa.int64())
                yield pa.RecordBatch.from_arrays([*(k.slice(start, stop - start) for k in keys), sizes], [*names, "n_tokens"])
            else:
                flat: list[int] = []
                offsets = [0]
                for ws in words:
                    for w in ws:
                        flat += known[w]
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([*(k.slice(start, stop - start) for k in keys), ids], [*names, "ids"])
            start = stop


def encode_ids(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """One row (``key``, ``ids``) for each row of ``df``: the ids of its text."""
    path = vocabulary or default_vocabulary()
    kind = df.schema[key].dataType.simpleString()
    return (
        df.select(df[key].alias("key"), df[text].alias("text"))
        .mapInArrow(lambda b: _encode_batches(b, path, False), f"key {kind}, ids array<int>")
        .withColumnRenamed("key", key)
    )


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row (``key``, ``carry``, ``n_tokens``) for each row of ``df``: the length of its encoding."""
    path = vocabulary or default_vocabulary()
    names = [key, *(carry or [])]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names)
    return df.select(*names, df[text].alias("_text")).mapInArrow(lambda b: _encode_batches(b, path, True), f"{kinds}, n_tokens bigint")
