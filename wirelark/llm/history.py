"""Problem 2: new batches against everything accepted before, without reading all of it again.

Method: a persisted inverted file of vector cells with full vectors. The vector of a text is its set of word sequences;
a cell is a locality key, and a vector lies in each of its cells. The file has three tables, each bucketed by what it is
asked for and appended to by batch: cells by key, exact keys by value, full vectors by id. What was appended before is never
rewritten, and no text of it is read again.

Probing: the keys of the batch move to the buckets of the tables, the tables do not move: a probe shuffles what the batch
has and what it meets, whatever the length of the history. The cells of a query are bounded first by the least distance to
what they hold (set sizes and the 1,024-bit rows of near.possible); vectors that cannot be near enough are not fetched, and
what remains is ranked by the exact distance. A cell that common wording fills is bounded inside a task, from its members;
its pairs are never rows. The first vector of each cell is tried first; a query that it settles probes no
further, since no nearer match can change the result. A query that exact keys settle is not probed at all.

A probe reads the narrow columns of the cells (three numbers a cell entry) and the vectors' columns that it compares, in place.
Defined results: an entry of the history counts for a query if it was appended earlier, or in the same batch with a smaller
order number; null keys match nothing; rows whose text is residue have no vector and no text keys; equal rows repeat each other.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelark.functions import url
from wirelark.llm import near, pages, sets
from wirelark.session import release, shared_dir, stage, staged

LIMIT, BUCKETS = 0.5, 48
#: Entries of a bucket; queries of a large cell that are compared in one task; pairs at a time there, or rows and columns.
ENTRIES, BLOCK, CHUNK, SIDE = 25_000, 2_048, 1 << 15, 1_024
#: Columns of an entry: a number that is unique and grows with the order of arrival, and the exact keys.
_ENTRY = ("seq", "url_key", "text_key", "print_key")
#: Characters of a text that text.fingerprint takes.
PRINTED = 3000


def url_key(c: Column) -> Column:
    """128 bits of the canonical URL."""
    return F.md5(url.canonicalize(c))


def text_keys(texts: pa.Array, titles: pa.Array) -> list[pa.Array]:
    """text_key and print_key: 128 bits of text.content_hash and text.fingerprint.

    Made in the pass that reads the texts anyway. Words are split once for both keys, but for texts of more than the characters
    that the fingerprint takes.
    """
    made: tuple[list, list] = [], []
    half = lambda words: hashlib.sha256(" ".join(words).encode()).hexdigest()[:32]
    for t, title in zip((x.as_py() for x in texts), (x.as_py() for x in titles)):
        words = None if t is None else t.lower().split()
        made[0].append(None if words is None else half(words))
        if words is not None and len(t) > PRINTED:
            words = t[:PRINTED].lower().split()
        made[1].append(None if words is None or title is None else half(title.lower().split() + words))
    return [pa.array(x, pa.string()) for x in made]


def _text_keys(text_col: str) -> pages.Made:
    return ("text_key", "print_key"), lambda b: text_keys(*(b.column(b.schema.get_field_index(c)) for c in (text_col, "title")))


class History:
    """The persisted index. buckets: files of each table a batch; so many tasks read it, so it should grow with the history
    that is expected (some ENTRIES a bucket): a probe holds the new keys of a bucket, and the ids that it fetches from it, in
    memory."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.buckets = spark, buckets
        self.name = f"wirelark_{uuid.uuid4().hex}"
        self.folder = folder or os.path.join(shared_dir(spark), f"wirelark-history-{self.name}")

    def _append(self, rows: DataFrame, kind: str, by: str) -> None:
        made = rows.repartition(self.buckets, by).write.mode("append").option("path", f"{self.folder}/{kind}").option("compression", "zstd")
        made.bucketBy(self.buckets, by).sortBy(by).format("parquet").saveAsTable(f"{self.name}_{kind}")

    def _table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    def append(self, entries: DataFrame, written: bool = False) -> None:
        """Adds a batch: entries has seq, residue, exact keys and the columns of sets.Maker. It is read once, or in place once
        for each of the three tables if it is cheap to read again (written: it comes from a staged table)."""
        keep = lambda c: F.when(~F.col("residue"), F.col(c)).alias(c)
        bits = [f"b{i}" for i in range(sets.LONGS)]
        before = staged(self.spark)
        made = entries.select(F.col("seq").alias("id"), "url_key", keep("text_key"), keep("print_key"), "n", "set_hash", "toks", *bits, "keys")
        made = made if written else stage(made, "history-batch")
        known = [F.concat(F.lit(str(i)), F.col(c)) for i, c in enumerate(_ENTRY[1:])]
        self._append(made.select("id", F.explode(F.array_compact(F.array(*known))).alias("val")), "exact", "val")
        self._append(made.filter("n > 0").select("id", "set_hash", F.explode("keys").alias("key")), "cells", "key")
        self._append(made.select("id", "n", "set_hash", "toks", *bits), "vectors", "id")
        release(self.spark, before)

    def _met(self, rows: DataFrame, by: str, first: int) -> DataFrame:
        """by, head, and the rows of what a new entry shares with an earlier one. Only new values move."""
        new = rows.filter(F.col("id") >= first).groupBy(by).agg(F.max("id").alias("last"))
        new = new.repartition(self.buckets, by).hint("shuffle_hash")
        shared = rows.join(new, by).groupBy(by).agg(F.min("id").alias("head"), F.max("last").alias("last"))
        return rows.join(shared.filter("head < last").select(by, "head").hint("shuffle_hash"), by)

    def probe(self, first: int, limit: float = LIMIT) -> DataFrame:
        """id of the entries from number first on that repeat an earlier entry."""
        same = self._met(self._table("exact"), "val", first)
        same = stage(same.filter((F.col("id") >= first) & (F.col("id") > F.col("head"))).select("id").distinct(), "history-same")
        # cells that hold a query and something earlier
        inside = stage(self._met(self._table("cells"), "key", first), "history-cells")
        asked = inside.filter((F.col("id") >= first) & (F.col("id") > F.col("head"))).join(same, "id", "left_anti")
        heads = asked.select(F.col("id").alias("x"), F.col("head").alias("y")).distinct()
        vectors = self._table("vectors")
        near_ = lambda pairs: near.compare(pairs, vectors, limit, parts=self.buckets).select(F.col("x").alias("id")).distinct()
        by_head = stage(near_(heads), "history-near")
        rest = asked.join(by_head, "id", "left_anti").select("key", "id")
        # of equal sets in a cell the first stands for all, so that a cell full of copies is one probe
        kinds = inside.groupBy("key", "set_hash", "head").agg(F.min("id").alias("id")).filter("id <> head").select("key", "id")
        can = stage(bounded(rest, kinds, vectors, limit, self.buckets), "history-can")
        by_rest = near.agreed(can, vectors, limit, parts=self.buckets).select(F.col("x").alias("id"))
        return same.unionByName(by_head).unionByName(by_rest).distinct()


def bounded(queries: DataFrame, kinds: DataFrame, vectors: DataFrame, limit: float, parts: int) -> DataFrame:
    """x, y: a query and an earlier kind of one of its cells that can be near enough by their sizes and bitmaps.

    queries, kinds: key, id. Common wording makes cells whose pairs grow with the square of the history. No pair becomes a row
    before its bound is known: a cell moves as its members, and its pairs exist only a chunk at a time within a task. The
    queries of a large cell are cut into blocks, each with all kinds of the cell.
    """
    own = queries.withColumn("query", F.lit(True)).unionByName(kinds.withColumn("query", F.lit(False)))
    ends = own.groupBy("key").agg(
        F.min(F.when(~F.col("query"), F.col("id"))).alias("low"),
        F.max(F.when(F.col("query"), F.col("id"))).alias("high"),
        F.ceil(F.count_if("query") / BLOCK).cast("int").alias("blocks"),
    )
    own = own.join(ends.filter("low < high"), "key").filter(F.when(F.col("query"), F.col("id") > F.col("low")).otherwise(F.col("id") < F.col("high")))
    of = F.when(F.col("query"), F.array(F.pmod(F.xxhash64("id"), "blocks").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = stage(own.select("key", F.explode(of).alias("block"), "id", "query"), "history-members")
    bits = [f"b{i}" for i in range(sets.LONGS)]
    rows = own.join(near.fetched(vectors, own, "id", parts, "n", *bits), "id").select("key", "block", "id", "query", "n", *bits)
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "id", F.desc("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            same = np.logical_and.reduce([(x := b.column(i).to_numpy()) == x[-1] for i in (0, 1)])
            if held and any(held[-1].column(i)[-1] != b.column(i)[0] for i in (0, 1)):
                yield from possible(pa.concat_batches(held), limit)
                held = []
            last = len(b) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last cell begins
            if last:
                yield from possible(pa.concat_batches([*held, b.slice(0, last)]), limit)
                held = []
            held.append(b.slice(last))
        if held:
            yield from possible(pa.concat_batches(held), limit)

    return rows.mapInArrow(run, "x bigint, y bigint").distinct()


def possible(cells: pa.RecordBatch, limit: float) -> Iterator[pa.RecordBatch]:
    """The pairs of whole cells that near.possible lets pass. cells: key, block, id, query, n, bits, in the order of bounded()."""
    key, block, ids, query, n = (cells.column(i).to_numpy(zero_copy_only=False) for i in range(5))
    n = n.astype(np.int64)
    bits = np.stack([cells.column(5 + i).to_numpy() for i in range(sets.LONGS)], axis=1).view(np.uint64)
    first = np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])]
    before = np.cumsum(~query) - ~query  # kinds that stand before a row
    start = before[np.flatnonzero(first)][np.cumsum(first) - 1]
    kinds, asked = np.flatnonzero(~query), np.flatnonzero(query)
    many = before[asked] - start[asked]

    def passed(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        fit = np.minimum(n[x], n[y]) >= limit * np.maximum(n[x], n[y])
        x, y = x[fit], y[fit]
        both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
        most = both + np.minimum(more[x], more[y])
        fit = most >= limit * (n[x] + n[y] - most)
        if fit.any():
            yield pa.record_batch([pa.array(ids[x[fit]]), pa.array(ids[y[fit]])], names=["x", "y"])

    more = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)  # tokens that share a bit with another
    cell = (np.cumsum(first) - 1)[asked]
    large = np.flatnonzero(np.bincount(cell, many) > CHUNK)
    for lo, hi in zip(np.searchsorted(cell, large), np.searchsorted(cell, large, side="right")):
        # all pairs of some queries and kinds at once, as a product of matrices; what passes it is asked again exactly
        whole = lambda rows: np.unpackbits(bits[rows].view(np.uint8), axis=1).astype(np.float32)
        for i in range(lo, hi, SIDE):
            x = asked[i : min(i + SIDE, hi)]
            a = whole(x)
            for j in range(start[x[0]], before[x[-1]], SIDE):
                y = kinds[j : min(j + SIDE, before[x[-1]])]
                most = a @ whole(y).T + np.minimum.outer(more[x], more[y]).astype(np.float32)
                at = np.nonzero((1 + limit) * most + 1 >= limit * np.add.outer(n[x], n[y]).astype(np.float32))
                earlier = y[at[1]] < x[at[0]]
                yield from passed(x[at[0][earlier]], y[at[1][earlier]])
        many[lo:hi] = 0
    ends = np.r_[0, np.cumsum(many)]
    for lo in range(0, int(ends[-1]), CHUNK):
        pair = np.arange(lo, min(lo + CHUNK, int(ends[-1])))
        at = np.searchsorted(ends, pair, side="right") - 1
        x = asked[at]
        yield from passed(x, kinds[start[x] + pair - ends[at]])


def article_entries(articles: DataFrame) -> DataFrame:
    """Entries of stored articles, from a staged table; their numbers are negative, so that all candidates come later."""
    keyed = articles.select("id", "url", "title", "article_text", url_key(F.col("url")).alias("url_key"))
    made, late = pages.judged_stories(keyed, ("url_key",), _text_keys("article_text"))
    made = made.join(late.select("id", F.lit(True).alias("late")), "id", "left")
    bad = F.col("residue") | F.col("late").isNotNull()
    blank = {"n": F.lit(0), "toks": F.array().cast("array<int>"), "keys": F.array().cast("array<bigint>")}
    made = made.withColumns({c: F.when(bad, v).otherwise(F.col(c)) for c, v in blank.items()}).withColumn("residue", bad)
    return made.withColumn("seq", -1 - F.col("id")).drop("id")


def candidate_seq(batch: Column, order: Column) -> Column:
    """One number that orders candidates by batch and, within it, by place."""
    return F.shiftleft(batch.cast("bigint"), 44) + order


def candidate_entries(candidates: DataFrame) -> DataFrame:
    seq = candidate_seq(F.col("batch_no"), F.col("original_index"))
    rows = candidates.select(seq.alias("seq"), "title", "full_text", url_key(F.col("url")).alias("url_key"))
    made = rows.mapInArrow(
        pages.story_runner("seq", "full_text", False, ("url_key",), _text_keys("full_text")),
        f"id bigint, url_key string, text_key string, print_key string, {sets.DDL}",
    )
    return made.withColumnRenamed("id", "seq").withColumn("residue", F.lit(False))


def repeats(articles: DataFrame, candidates: DataFrame, buckets: int | None = None) -> DataFrame:
    """original_index of the candidates that repeat an article or an earlier candidate. All batches are probed at once.

    buckets: as many as the number of rows asks for, if not given.
    """
    buckets = buckets or max(BUCKETS, -(-(articles.count() + candidates.count()) // ENTRIES))
    own = History(articles.sparkSession, buckets=buckets)
    own.append(article_entries(articles), written=True)
    own.append(candidate_entries(candidates))
    return own.probe(0).select((F.col("id").bitwiseAND(F.lit((1 << 44) - 1))).alias("original_index"))
