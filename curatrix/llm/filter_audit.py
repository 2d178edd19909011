"""Which filter removes what, in which order: every order of the filters is replayed over every document's flags.

A document's failing filters are a bit mask. The masks meet all orders of the
filters (k! rows, broadcast: at most 5,040 as k is 7 at most), each order's steps
are exploded, the first failing step is known by comparing bits, and sums by
part, order and step combine on the map side before the only large exchange.

Null texts are empty. Repeated rows count one by one; rows of one doc_id and text
do not make each other copies, as no doc_id of them is smaller. A null doc_id is
neither smaller nor larger than another and has no label. Of several labels of a
doc_id the largest counts. Very long texts are taken whole. Empty tables give no
rows. Only the named columns are read, so further columns of any name are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import beside_groups, materialize

WORDS = r"[^\x20\x09-\x0D]+"


def text_failures(x: Column) -> dict[str, Column]:
    """The conditions A to D on a text that is not null."""
    words = F.regexp_extract_all(x, F.lit(WORDS), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 200,
        "B": F.lit(100) * distinct < F.lit(50) * n,
        "C": F.lit(100) * F.regexp_count(x, F.lit("[A-Z]")) > F.lit(2) * F.length(x),
        "D": x.rlike("[#$%&*|]"),
    }


def mask_of(failures: list[Column]) -> Column:
    """Bit i is set where failure i holds."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures)])


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document: bits 0 to 4 are the failures A to E."""
    x = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(x.cast("binary"), 256)).alias("h"), mask_of(list(text_failures(x).values())).alias("mask"))
    thin = beside_groups(materialize(thin), "h", F.min("doc_id").alias("least_id"))
    copy = F.coalesce(F.col("doc_id") > F.col("least_id"), F.lit(False))
    # Rows without an id meet no label; they are spread by their text instead of meeting in one task.
    spread = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("h", "part"), F.lit(1 << 20))).otherwise(0)
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("spread_", F.lit(0).cast("long"))
    out = thin.withColumn("spread", spread.cast("long")).join(marks, (F.col("doc_id") == F.col("l_")) & (F.col("spread") == F.col("spread_")), "left")
    mask = F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0))
    return out.select("part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def replay(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for rows (part, mask, good, toxic).

    filters has a letter for each bit of the mask, 7 at most. Each row meets each
    order; every part has a row for every order and step, as each of its rows does.
    """
    k = len(filters)
    if k > 7:
        raise ValueError("more than 7 filters have too many orders to replay")
    orders = [(i, "".join(p), [1 << filters.index(c) for c in p]) for i, p in enumerate(permutations(filters))]
    orders = F.broadcast(rows.sparkSession.createDataFrame(orders, "order_id int, filter_order string, bits array<int>"))
    failing = [F.when(F.col("mask").bitwiseAND(F.col("bits")[j]) != 0, j + 1) for j in range(k)]
    met = rows.crossJoin(orders.select("order_id", "bits")).withColumn("first", F.coalesce(*failing, F.lit(k + 1)))
    steps = met.select("part", "mask", "good", "toxic", "order_id", "first", F.posexplode("bits").alias("at", "bit"))
    step, first = F.col("at") + 1, F.col("first")
    many = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    sums = steps.groupBy("part", "order_id", "at").agg(
        many(first > step).alias("kept"),
        many(first == step).alias("removed"),
        many((first < step) & (F.col("mask").bitwiseAND(F.col("bit")) != 0)).alias("redundant"),
        many(F.col("mask") == F.col("bit")).alias("unique_fails"),
        many((first == step) & F.col("good")).alias("good_lost"),
        many((first == step) & F.col("toxic")).alias("toxic_lost"),
    )
    named = sums.join(orders.drop("bits"), "order_id").withColumn("step", step.cast("int")).withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    totals = named.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return named.join(totals, ["part", "filter"]).select("part", "filter_order", "step", "filter", *counts)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """replay of the five filters over documents, by source."""
    return replay(flagged(docs, labels))
