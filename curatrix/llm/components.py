"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node that the edges (a, b) join a node to; nodes without edges are absent.

    Every round sends each node to its smallest neighbour, if that is smaller, and
    contracts the edges; the edge between a node and where it went stays as the
    edge between their new names, so nothing is lost. Rounds are few: a path
    halves at least, a star of any size takes one.
    """
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter(F.col("u") != F.col("v"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = materialize(both.distinct())
    state = None
    while True:
        parent = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        parent = materialize(parent)
        if state is None:
            if not parent.take(1):
                return parent.select(F.col("u").alias("node"), F.col("p").alias("comp"))
            state = parent.select(F.col("u").alias("node"), F.col("p").alias("comp"))  # the table of the first round stays for it
        else:
            old, state = state, materialize(state.join(parent, F.col("comp") == F.col("u"), "left").select("node", F.coalesce("p", "comp").alias("comp")))
            discard(old)
        pu, pv = parent.select("u", F.col("p").alias("pu")), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        joined = edges.join(pu, "u").join(pv, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
        old, edges = edges, materialize(joined.filter(F.col("u") != F.col("v")).distinct())
        discard(old)
        if not edges.take(1):
            return state
