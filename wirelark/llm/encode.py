"""Problem 8: a corpus in ids of a public byte-level BPE tokenizer.

Method: corpus-level merge replay. The distinct words of a block of the corpus are cut into bytes; an inverted index
leads from each pair of neighbouring tokens to its places in the words; the pairs are merged in rank order, each at all
its places at once, and only the neighbours of a merge are updated. A merge can only make pairs of a higher rank, so one
pass in rank order gives what merging word by word gives.

A block is what one task holds at a time; words that an earlier block settled are taken from memory (bounded), so a
frequent word is merged once a task. Nothing is shuffled. Defined results: empty and null texts have the ids []; special
tokens are ordinary text; texts are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how byte-level BPE of this family cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 400_000


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Replay:
    def __init__(self, path: str) -> None:
        self.ranks = ranks(path)
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.bytes[v] = k
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}

    def _rank(self, a: int, b: int) -> int:
        """The id that a pair merges to, or -1."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            got = self.pairs[a, b] = self.ranks.get(self.bytes[a] + self.bytes[b], -1)
        return got

    def learn(self, words: list[str]) -> None:
        """Replays the merges over all words at once and remembers their ids."""
        tok: list[int] = []
        starts = [0]
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            tok.extend([whole] if whole is not None else [self.single[x] for x in raw])
            tok.append(-1)
            starts.append(len(tok))
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        rank = self._rank
        for i in range(n - 1):
            if tok[i] >= 0 and tok[i + 1] >= 0 and (r := rank(tok[i], tok[i + 1])) >= 0:
                places.setdefault(r, []).append(i)
        heap = list(places)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            for i in places.pop(r):  # in the order of positions: earlier places win where a pair overlaps itself
                j = nxt[i] if tok[i] >= 0 else n
                if j >= n or tok[j] < 0 or rank(tok[i], tok[j]) != r:
                    continue
                k = nxt[j]
                tok[i], tok[j] = r, -2
                nxt[i] = k
                if k < n:
                    prv[k] = i
                    if tok[k] >= 0 and (q := rank(r, tok[k])) >= 0:
                        if q not in places:
                            places[q] = []
                            heapq.heappush(heap, q)
                        places[q].append(i)
                p = prv[i]
                if p >= 0 and tok[p] >= 0 and (q := rank(tok[p], r)) >= 0:
                    if q not in places:
                        places[q] = []
                        heapq.heappush(heap, q)
                    places[q].append(p)
            # places of a pair are added by different merges, hence out of order
            if heap:
                places[heap[0]].sort()
        for w, a, b in zip(words, starts, starts[1:]):
            self.known[w] = [t for t in tok[a:b] if t >= 0]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        cut = regex.compile(PATTERN).findall
        parts = [cut(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = sorted({w for p in parts for w in p} - self.known.keys())
        if new:
            self.learn(new)
        known = self.known
        ids = [[t for w in p for t in known[w]] for p in parts]
        ends = np.zeros(len(ids) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in ids], out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array([t for x in ids for t in x], pa.int32()))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and ids of every document."""
    path = os.path.join(folder, f"{name}.tiktoken")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Replay(path)
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                yield pa.record_batch([part.column(0), own.encode(part.column(1).to_pylist())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")
