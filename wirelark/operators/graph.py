"""Connected components by contraction, with DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.session import stage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node of each component, for every node that has an edge.

    Every round each node points at its smallest neighbour or itself, pointers are doubled until they lead to roots, and
    the edges are contracted to edges between roots; a round at least halves the nodes that still have edges. A hub's
    neighbours are reduced by a partial minimum before the shuffle. Loops, repeats and null ends are ignored; no edge
    gives no row. Each round's tables are written to the shared folder, so a lost executor costs no earlier round.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null and u <> v")
    e = stage(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    found = None
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        low = (
            e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x"))
            .groupBy(F.col("x.u").alias("node"))
            .agg(F.min(F.col("x.v")).alias("to"))
            .select("node", F.least("node", "to").alias("to"))
        )
        low = stage(low, "cc-low")
        moved = True
        while moved:  # pointers are doubled until all lead to a root
            twice = low.alias("a").join(low.alias("b"), F.col("a.to") == F.col("b.node")).select("a.node", "b.to")
            last = twice.alias("a").join(low.alias("b"), F.col("a.to") == F.col("b.node"))
            low = stage(last.select("a.node", "b.to", (F.col("a.to") != F.col("b.to")).alias("moved")), "cc-parent")
            moved = not low.filter("moved").isEmpty()
            low = low.select("node", "to")
        if found is None:
            found = low.select("node", F.col("to").alias("component"))
        else:
            step = low.select(F.col("node").alias("component"), F.col("to").alias("next"))
            found = found.join(step, "component", "left").select(
                "node", F.coalesce("next", "component").alias("component")
            )
        found = stage(found, "cc-found")
        a = low.select(F.col("node").alias("u"), F.col("to").alias("a"))
        b = low.select(F.col("node").alias("v"), F.col("to").alias("b"))
        e = e.join(a, "u").join(b, "v").filter("a <> b")
        e = stage(e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc-edges")
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    if found is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found
