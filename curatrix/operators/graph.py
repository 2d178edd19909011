"""Graphs as edge tables: connected components and greedy choices along them."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators.written import cut

#: Edges of a component that one task settles at once.
LOCAL_EDGES = 1_000_000


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node that edges reach from a node; nodes without edges are absent.

    Each round links every node to the smallest of its neighbours and itself and
    follows the links once more; edges are then drawn between the nodes linked to, so
    components shrink by half or more a round. Edges never meet in one task, as
    smallest neighbours combine before the exchange.
    """
    t = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    t = cut(t.unionByName(t.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    out = None
    while t.take(1):
        link = cut(t.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to")))
        hop = link.select(F.col("x").alias("to"), F.col("to").alias("next"))
        link = cut(link.join(hop, "to", "left").select("x", F.coalesce("next", "to").alias("to")))
        out = link if out is None else cut(out.join(link.select(F.col("x").alias("to"), F.col("to").alias("next")), "to", "left").select("x", F.coalesce("next", "to").alias("to")))
        ends = t.join(link, "x").select(F.col("to").alias("p"), "y").join(link.select(F.col("x").alias("y"), F.col("to").alias("q")), "y")
        t = cut(ends.select(F.col("p").alias("x"), F.col("q").alias("y")).filter("x <> y").distinct())
    if out is None:
        return t.select(F.col("x").alias("node"), F.col("y").alias("comp"))
    return out.select(F.col("x").alias("node"), F.col("to").alias("comp"))


def dropped_in_order(pairs: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(k): the nodes that go if nodes are taken in ascending order and each that stays drops its larger neighbours; pairs are (a, b), a < b.

    A component of at most `local` edges is settled by one task. Larger ones go on in
    rounds: what has no undecided smaller neighbour stays, its neighbours go.
    """
    pairs = cut(pairs.select("a", "b").distinct())
    comp = cut(connected(pairs))
    placed = pairs.join(comp, pairs["a"] == comp["node"]).select("a", "b", "comp")
    large = cut(placed.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > local).select("comp"))
    kind = dict(pairs.dtypes)["a"]

    def settle(t: pa.Table) -> pa.Table:
        gone: set = set()
        for x, y in sorted(zip(t.column("a").to_pylist(), t.column("b").to_pylist())):
            if x not in gone:
                gone.add(y)
        return pa.table({"k": pa.array(list(gone), t.schema.field("a").type)})

    small = placed.join(large, "comp", "left_anti").groupBy("comp").applyInArrow(settle, f"k {kind}")
    if not large.take(1):
        return small
    open_, parts = cut(placed.join(large, "comp", "left_semi").select("a", "b")), [small]
    while open_.take(1):
        sure = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")), "a", "left_anti")
        gone = cut(open_.join(sure, "a", "left_semi").select(F.col("b").alias("k")).distinct())
        parts.append(gone)
        open_ = cut(open_.join(gone.withColumnRenamed("k", "a"), "a", "left_anti").join(gone.withColumnRenamed("k", "b"), "b", "left_anti"))
        if len(parts) == 20:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)
