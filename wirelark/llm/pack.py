"""Problem 9: items of varying size in containers of one capacity.

Method: Karmarkar-Karp multiway differencing. Partial partitions into m windows are merged, largest imbalance first, the
fullest window of one with the emptiest of the other; m starts at the least number that can hold everything and rises
whenever a window exceeds the capacity.

Items are spread over shards of about SHARD items by a hash; a shard is packed in one task, so that the largest task is
bounded and nothing is gathered. At most the last container of a shard is loose. An item larger than the capacity is cut
into pieces of the capacity and a rest; full pieces are containers of their own. Defined results: items of size 0 or null
are placed too and take no space; equal sizes are ordered by id and piece, so that a run can be repeated.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY, SHARD = 2048, 3000


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """m lists of positions in sizes with near-equal sums."""
    # a partial partition: its non-empty windows, fullest first, as (sum, positions); the other windows are empty
    heap = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        heap.append((-sizes[k] if m > 1 else 0, k, [(sizes[k], [k])]))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) <= m:
            out = a + b
        else:
            # the fullest of one meets the emptiest of the other: empty windows first, then the least filled
            if len(a) < len(b):
                a, b = b, a
            free = m - len(a)
            out = a[: len(a) - (len(b) - free)] + b[len(b) - free :] if free else a[: len(a) - len(b)]
            low = a[len(a) - (len(b) - free) :] if free else a[len(a) - len(b) :]
            for (s, x), (t, y) in zip(reversed(low), b):
                out.append((s + t, x + y))
        out.sort(key=lambda w: -w[0])
        least = out[-1][0] if len(out) == m else 0
        count += 1
        heapq.heappush(heap, (-(out[0][0] - least), count, out))
    made = [x for _, x in heap[0][2]] if heap else []
    return made + [[] for _ in range(m - len(made))]


def fill(sizes: list[int], capacity: int) -> list[int]:
    """The window of each item; no window over the capacity (no item is)."""
    at = [0] * len(sizes)
    real = [k for k, s in enumerate(sizes) if s > 0]
    if not real:
        return at
    own = [sizes[k] for k in real]
    m = max(1, -(-sum(own) // capacity))
    while True:
        made = differencing(own, m)
        if max(sum(own[k] for k in w) for w in made) <= capacity:
            break
        m += 1
    for i, w in enumerate(made):
        for k in w:
            at[real[k]] = i
    return at


def packed(items: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """doc_id, piece_no, n_tokens, container of every item or piece. items: ids and sizes, read twice (count and pack)."""
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("int")
    rows = items.select(F.col(id_col).alias("doc_id"), size.alias("n"))
    pieces = rows.select(
        "doc_id",
        F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("n") / capacity).cast("int")))).alias("piece_no"),
        "n",
    ).select("doc_id", "piece_no", F.least(F.lit(capacity), F.col("n") - (F.col("piece_no") - 1) * capacity).alias("n_tokens"))
    full = F.col("n_tokens") == capacity
    n_loose, n_whole = pieces.agg(F.count_if(~full), F.count_if(full & (F.col("piece_no") == 1))).first()
    shards, wholes = (max(1, -(-n // shard)) for n in (n_loose, n_whole))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable")
        at = fill(pdf["n_tokens"].tolist(), capacity)
        pdf["container"] = pdf["shard"].astype(np.int64) * (1 << 32) + np.array(at, dtype=np.int64)
        return pdf[["doc_id", "piece_no", "n_tokens", "container"]]

    kind = dict(items.dtypes)[id_col]
    loose = (
        pieces.filter(~full)
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("int"))
        .repartition(min(shards, 64 + shards // 4), "shard")  # packing outweighs its few bytes, which the planner would merge into one task
        .groupBy("shard")
        .applyInPandas(run, f"doc_id {kind}, piece_no int, n_tokens int, container bigint")
    )
    # a full piece is a container of its own; they are counted on in each shard, as negative numbers that no loose one has
    before = Window.partitionBy("shard").orderBy("doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    whole = (
        rows.withColumn("whole", F.floor(F.col("n") / capacity))
        .filter("whole > 0")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(wholes)))
        .withColumn("before", F.coalesce(F.sum("whole").over(before), F.lit(0)))
        .select("doc_id", "shard", "before", F.explode(F.sequence(F.lit(1), F.col("whole").cast("int"))).alias("piece_no"))
        .select("doc_id", "piece_no", F.lit(capacity).alias("n_tokens"), (-F.shiftleft("shard", 32) - F.col("before") - F.col("piece_no")).alias("container"))
    )
    return loose.unionByName(whole)
