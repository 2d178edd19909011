"""Exact de-duplication with frequencies, weights and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.operators.written import cut


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; nulls of a key are equal. No sort of whole groups: the least order struct is kept by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("f_"))
    return first.select(*[F.col(c) if c in keys else F.col(f"f_.{c}").alias(c) for c in df.columns])


def frequencies(df: DataFrame, text: str = "text", index: str = "original_index") -> DataFrame:
    """(text, original_index of the first row, frequency)."""
    return df.groupBy(text).agg(F.min(index).alias("original_index"), F.count(F.lit(1)).alias("frequency"))


def capped(freq: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """Rows of at least `least`, frequencies clipped to `most`."""
    freq = freq.filter(F.col("frequency") >= least)
    return freq if most is None else freq.withColumn("frequency", F.least("frequency", F.lit(most)))


def smoothed(f, smoothing: str = "sqrt"):
    """Weight of a frequency before normalisation."""
    f = f.cast("double")
    if smoothing == "sqrt":
        return F.sqrt(f)
    if smoothing == "log":
        return F.ln(f + 1)
    if smoothing == "linear":
        return f
    raise ValueError(f"unknown smoothing {smoothing}")


def weights(freq: DataFrame, smoothing: str = "sqrt") -> DataFrame:
    """freq plus weight, adding up to 1 (the total is one row joined back, not a window over all rows)."""
    total = freq.agg(F.sum(smoothed(F.col("frequency"), smoothing)).alias("t_"))
    return freq.join(F.broadcast(total)).withColumn("weight", smoothed(F.col("frequency"), smoothing) / F.col("t_")).drop("t_")


def frequency_report(freq: DataFrame) -> DataFrame:
    """One row of statistics of (text, frequency)."""
    f = F.col("frequency")
    count = lambda c: F.count(F.when(c, 1))
    out = freq.agg(
        F.coalesce(F.sum(f), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n_unique"), F.min(f).alias("min_frequency"), F.max(f).alias("max_frequency"),
        F.avg(f).alias("mean_frequency"), F.stddev_pop(f).alias("std_frequency"),
        count(f >= 10).alias("n_high"), count((f >= 2) & (f < 10)).alias("n_middle"), count(f < 2).alias("n_low"),
    )
    out = out.join(F.broadcast(quantiles(freq, [], "frequency", {"median_frequency": 0.5}, empty=True)))  # one row
    ratio = F.col("n_unique") / F.col("total")
    advice = F.when(ratio < 0.5, "sqrt").when(ratio < 0.8, "log").otherwise("linear")
    return out.withColumn("unique_ratio", ratio).withColumn("smoothing_advice", advice).withColumn("cap_advised", F.col("max_frequency") > 100)


def running_total(df: DataFrame, order: list[str], amount: str | None = None, name: str = "before") -> DataFrame:
    """df plus the total of `amount` (or the number of rows) before each row in a global order.

    Rows are range-partitioned and sorted; each partition's total, a number, gives
    the offset of the next ones. So the rows never meet in one task. What part a row
    is in is written once: bounds come from samples, so a plan read twice may part
    rows differently.
    """
    x = F.lit(1) if amount is None else F.col(amount)
    placed = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("p_", F.spark_partition_id()))
    run = F.coalesce(F.sum(x).over(W.partitionBy("p_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("r_", run)
    sizes = placed.groupBy("p_").agg(F.sum(x).alias("n_"))
    before = sizes.select(F.col("p_").alias("q_"), F.coalesce(F.sum("n_").over(W.orderBy("p_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b_"))
    out = placed.join(F.broadcast(before), F.col("p_") == F.col("q_"))
    return out.withColumn(name, F.col("b_") + F.col("r_")).drop("p_", "q_", "r_", "b_")


def ranked(df: DataFrame, group: str, order: list[Column], name: str = "rank_") -> DataFrame:
    """df plus the place of each row in its group (from 1, nulls are a group) by `order`, whose columns tell all rows apart.

    Rows are range-partitioned by group and order, so a group of any size spreads
    over many tasks; places inside a task's part are moved by the counts of the
    parts before it, a table of one row for each group and part. Parts are written
    once, as in running_total.
    """
    keys = {f"o{i}_": c for i, c in enumerate(order)}
    t = df.withColumns(keys).withColumn("g_", F.col(f"`{group}`"))
    placed = cut(t.repartitionByRange("g_", *keys).withColumn("p_", F.spark_partition_id()))
    inside = placed.withColumn("inside_", F.row_number().over(W.partitionBy("p_", "g_").orderBy(*keys)))
    parts = placed.groupBy("p_", "g_").agg(F.count(F.lit(1)).alias("rows_"))
    earlier = F.coalesce(F.sum("rows_").over(W.partitionBy("g_").orderBy("p_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("p_").alias("q_"), F.col("g_").alias("h_"), earlier.alias("earlier_"))
    out = inside.join(parts, (F.col("p_") == F.col("q_")) & F.col("g_").eqNullSafe(F.col("h_")))
    return out.withColumn(name, F.col("earlier_") + F.col("inside_")).drop("p_", "g_", "inside_", "q_", "h_", "earlier_", *keys)


def quantiles(df: DataFrame, groups: list[str], col: str, probs: dict[str, float], empty: bool = False) -> DataFrame:
    """Exact quantiles by linear interpolation, one row for each group: (groups, a column for each name of probs); nulls are left out.

    Values are counted first, on the map side; the counts are range-partitioned by
    group and value, running totals tell which value stands at a rank, and the
    values at the two ranks around a quantile are picked by sums that combine. No
    task holds the values of a group. Groups without a value have no row; with
    empty=True and no groups, a table without values gives a row of nulls.
    """
    key = F.struct(*[F.col(f"`{g}`") for g in groups]) if groups else F.struct(F.lit(0))
    v = df.select(key.alias("g_"), F.col(f"`{col}`").cast("double").alias("x_")).filter("x_ IS NOT NULL").groupBy("g_", "x_").agg(F.count(F.lit(1)).alias("m_"))
    total = v.groupBy("g_").agg(F.sum("m_").alias("n_"))
    placed = running_total(v, ["g_", "x_"], "m_", "before_")
    first = placed.groupBy("g_").agg(F.min("before_").alias("start_"))
    sizes = total.join(first, "g_").withColumnRenamed("g_", "h_")
    t = placed.join(sizes, F.col("g_") == F.col("h_")).withColumn("at_", F.col("before_") - F.col("start_"))
    picks, out = [], []
    for i, (name, p) in enumerate(probs.items()):
        place = (F.col("n_") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((F.col("at_") <= rank) & (rank < F.col("at_") + F.col("m_")), F.col("x_"))).alias(f"{side}{i}_"))
        lo, hi, place = F.col(f"lo{i}_"), F.col(f"hi{i}_"), (F.col("n_") - 1) * F.lit(float(p))
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi).alias(name))
    got = t.groupBy("g_").agg(F.max("n_").alias("n_"), *picks).select(*[F.col("g_").getField(g).alias(g) for g in groups], *out)
    if empty and not groups:
        one = df.sparkSession.range(1).select(F.lit(0).alias("one_"))
        got = one.join(got.withColumn("two_", F.lit(0)), F.col("one_") == F.col("two_"), "left").drop("one_", "two_")
    return got


def chunked(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df plus chunk_id: consecutive chunks of `size` rows in the given order."""
    return running_total(df, order, None, "c_").withColumn("chunk_id", F.floor(F.col("c_") / size).cast("long")).drop("c_")
