"""Deterministic samplers: every draw is a function of a seed and a row's key, so results do not depend on partitioning.

u(key) is uniform in (0, 1); an order by -ln(u) / w is a weighted sample without
replacement (Efraimidis and Spirakis 2006), and any prefix of that order is one.
Where only a quota of a stratum is wanted, ranks are taken in salted parts first,
and global draws use orderBy().limit(). The samplers that fill up from what is left
of all strata rank keys, without the other columns, in a range-partitioned order,
so no stratum is sorted in one task; rows are met by key at the end. Keys are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.operators.frequency import ranked, running_total, smoothed
from curatrix.operators.written import cut

#: Parts that a stratum is ranked in first.
SALTS = 16
#: Rows of a part of a large sample.
SPREAD = 20_000


def draw_key(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def uniform(key: str, seed: int = 42) -> Column:
    return (F.conv(F.substring(draw_key(key, seed), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(2**48 + 1))


def weighted_key(key: str, weight: Column | None = None, seed: int = 42) -> Column:
    return -F.ln(uniform(key, seed)) / (F.lit(1.0) if weight is None else weight)


def uniform_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement (all, if fewer)."""
    return df.orderBy(draw_key(key, seed), key).limit(n)


def spread_sample(df: DataFrame, n: int, key: str, seed: int = 42, rows: int = SPREAD) -> DataFrame:
    """The rows of uniform_sample in the same order, over parts of about `rows` rows each, which follow from the draws alone.

    The draws are counted by their first four digits, so the last draw that is in is
    found among the rows of one of 65,536 bins; no task holds all rows that stay.
    """
    t = cut(df.withColumn("d_", F.coalesce(draw_key(key, seed), F.lit(""))).withColumn("b_", F.coalesce(F.conv(F.substring("d_", 1, 4), 16, 10).cast("int"), F.lit(-1))))
    bins = sorted((r["b_"], r["count"]) for r in t.groupBy("b_").count().collect())
    parts, before, edges = -(-min(n, sum(c for _, c in bins)) // rows), 0, []
    for b, c in bins:
        if before + c > n:
            last = t.filter(F.col("b_") == b).select("d_", key).orderBy("d_", key).limit(n - before).collect()
            inside = (F.col("d_") < last[-1]["d_"]) | ((F.col("d_") == last[-1]["d_"]) & (F.col(key) <= last[-1][key])) if last else F.lit(False)
            t = t.filter((F.col("b_") < b) | ((F.col("b_") == b) & inside))
            break
        before += c
        if before >= rows * (len(edges) + 1) and len(edges) + 1 < parts:
            edges.append(b)
    part = sum((F.when(F.col("b_") > e, 1).otherwise(0) for e in edges), F.lit(0))
    return t.repartitionById(max(1, parts), part).sortWithinPartitions("d_", key).drop("d_", "b_")


def weighted_sample(df: DataFrame, n: int, key: str, weight: Column, seed: int = 42) -> DataFrame:
    return df.orderBy(weighted_key(key, weight, seed), key).limit(n)


def top_k(df: DataFrame, k: int, score: str, key: str, ascending: bool = False) -> DataFrame:
    return df.orderBy(F.col(score).asc() if ascending else F.col(score).desc(), key).limit(k)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(draw_key(key, seed), key)


def allocation(sizes: DataFrame, n: int, strategy: str, least: int = 5, most: int | None = None) -> DataFrame:
    """Quota of each stratum: (stratum, size) to (stratum, size, quota).

    First min(least, size) each; then the rest R by strategy (balanced R//k;
    proportional int(R*size/N); hybrid R//k + int(size/N*R*0.3)), clipped to what is
    there and to `most`, scaled down and floored if it exceeds R; then what is
    still missing from the largest strata first, ignoring `most`. One row for each
    stratum, so the windows are over that small table.
    """
    if strategy not in ("balanced", "proportional", "hybrid"):
        raise ValueError(f"unknown strategy {strategy}")
    every = W.partitionBy()
    t = sizes.withColumn("n1", F.least(F.lit(least), F.col("size")))
    t = t.withColumns({"k": F.count(F.lit(1)).over(every), "total": F.sum("size").over(every), "rest": F.greatest(F.lit(n) - F.sum("n1").over(every), F.lit(0))})
    even = F.floor(F.col("rest") / F.col("k"))
    goal = {"balanced": even, "proportional": F.floor(F.col("rest") * F.col("size") / F.col("total")), "hybrid": even + F.floor(F.col("size") / F.col("total") * F.col("rest") * 0.3)}[strategy]
    goal = F.least(goal, F.col("size") - F.col("n1"))
    if most is not None:
        goal = F.least(goal, F.lit(most) - F.col("n1"))
    t = t.withColumn("n2", F.greatest(goal, F.lit(0)).cast("long"))
    t = t.withColumn("sum2", F.sum("n2").over(every))
    t = t.withColumn("n2", F.when(F.col("sum2") > F.col("rest"), F.floor(F.col("n2") * (F.col("rest") / F.col("sum2")))).otherwise(F.col("n2")))
    t = t.withColumn("left", F.col("rest") - F.sum("n2").over(every)).withColumn("avail", F.col("size") - F.col("n1") - F.col("n2"))
    by_size = W.orderBy(F.desc("size"), F.col("stratum").asc()).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("avail").over(by_size), F.lit(0))
    n3 = F.greatest(F.lit(0), F.least(F.col("avail"), F.col("left") - before))
    return t.select("stratum", "size", (F.col("n1") + F.col("n2") + n3).cast("long").alias("quota"))


def stratified_sample(df: DataFrame, n: int, stratum: str, key: str, strategy: str = "balanced", least: int = 5, most: int | None = None, weight: Column | None = None, seed: int = 42) -> DataFrame:
    """A sample of about n rows (never more than n plus the guaranteed rows) by `allocation`; weighted if a weight is given."""
    sizes = df.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    quota = allocation(sizes, n, strategy, least, most).select(F.col("stratum").alias("s_"), "quota")
    order = [weighted_key(key, weight, seed), F.col(key)]
    # Guaranteed rows may be more than n; which of them stay follows the draw, not the partitions.
    return _within(df, quota, stratum, order).orderBy(*order).limit(n)


def _within(df: DataFrame, quota: DataFrame, stratum: str, order: list[Column]) -> DataFrame:
    """The first `quota` rows of each stratum (s_) in the given order.

    A stratum may hold most rows, so each of SALTS parts of it first keeps its own
    best `quota` rows; only those meet.
    """
    joined = df.join(quota, df[stratum].eqNullSafe(quota["s_"])).filter("quota > 0")
    salted = joined.withColumn("t_", F.pmod(F.hash(*order), F.lit(SALTS)))
    part = salted.withColumn("r_", F.row_number().over(W.partitionBy("s_", "t_").orderBy(*order))).filter(F.col("r_") <= F.col("quota"))
    ranked = part.withColumn("r_", F.row_number().over(W.partitionBy("s_").orderBy(*order)))
    return ranked.filter(F.col("r_") <= F.col("quota")).drop("r_", "s_", "t_", "quota")


def simple_stratified(df: DataFrame, n: int, n_clusters: int, stratum: str, key: str, strategy: str = "balanced", seed: int = 42) -> DataFrame:
    """Per stratum n // n_clusters (of all configured clusters) or int(n * share); then random rows, if there are enough for all that is missing."""
    sizes = df.groupBy(F.col(stratum).alias("s_")).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    sizes = sizes.join(F.broadcast(total))
    goal = F.lit(n // n_clusters) if strategy == "balanced" else F.floor(F.lit(n) * F.col("size") / F.col("total"))
    placed = ranked(df.select(stratum, key), stratum, [draw_key(key, seed), F.col(key)], "r_")
    placed = placed.join(sizes.select("s_", F.least(goal, F.col("size")).alias("quota")), F.col(stratum).eqNullSafe(F.col("s_"))).withColumn("in_", F.col("r_") <= F.col("quota"))
    placed = cut(placed.select(key, "in_"))
    got = placed.agg(F.sum(F.col("in_").cast("int")).alias("got"), F.count(F.lit(1)).alias("all")).collect()[0]
    missing = n - (got["got"] or 0)
    fill = missing if 0 < missing <= got["all"] - (got["got"] or 0) else 0
    extra = placed.filter(~F.col("in_")).orderBy(draw_key(key, seed), key).limit(fill)
    chosen = placed.filter("in_").unionByName(extra).orderBy(draw_key(key, seed), key).limit(n)
    return df.join(chosen.select(key), key, "left_semi").select(*df.columns)


def diversity_sample(df: DataFrame, n: int, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """max(1, n // k) rows of each stratum, filled up at random, n at most."""
    k = df.select(stratum).distinct().count() or 1
    each = max(1, n // k)
    placed = ranked(df.select(stratum, key), stratum, [draw_key(key, seed), F.col(key)], "r_")
    # Rows within the quota first, all in draw order.
    chosen = placed.orderBy((F.col("r_") > each).cast("int"), draw_key(key, seed), key).limit(n)
    return df.join(chosen.select(key), key, "left_semi").select(*df.columns)


def frequency_aware_sample(freq: DataFrame, n: int, key: str, ratio: float = 0.8, smoothing: str = "sqrt", stratum: str | None = None, seed: int = 42) -> DataFrame:
    """int(n * ratio) rows weighted by frequency; the rest from what is left, by diversity over a stratum or at random."""
    first = weighted_sample(freq, int(n * ratio), key, smoothed(F.col("frequency"), smoothing), seed)
    left = freq.join(first.select(key), key, "left_anti")
    rest = n - int(n * ratio)
    other = diversity_sample(left, rest, stratum, key, seed + 1) if stratum else uniform_sample(left, rest, key, seed + 1)
    return first.unionByName(other.select(*first.columns))


def cluster_balanced_top(df: DataFrame, n: int, cluster: str, score: str, key: str, floor: int = 3, rescale: bool = True) -> DataFrame:
    """The best rows of each cluster, max(floor, int(n * share)) each (rescaled if that is over n), filled up by score; n at most, low cluster ids first."""
    sizes = df.groupBy(F.col(cluster).alias("s_")).agg(F.count(F.lit(1)).alias("size"))
    every = W.partitionBy()
    quota = sizes.withColumn("quota", F.greatest(F.lit(floor), F.floor(F.lit(n) * F.col("size") / F.sum("size").over(every))).cast("long"))
    if rescale:
        over = F.sum("quota").over(every)
        quota = quota.withColumn("o_", over).withColumn("quota", F.when(F.col("o_") > n, F.greatest(F.lit(floor), F.floor(F.col("quota") * F.lit(n) / F.col("o_")))).otherwise(F.col("quota")).cast("long"))
    placed = ranked(df.select(cluster, score, key), cluster, [-F.col(score).cast("double"), F.col(key)], "r_")
    placed = placed.join(quota.select("s_", "quota"), F.col(cluster).eqNullSafe(F.col("s_")))
    late = (F.col("r_") > F.col("quota")).cast("int")
    order = [late, F.when(late == 0, F.col(cluster)), F.when(late == 0, F.col("r_")), F.desc(score), F.col(key)]
    return df.join(placed.orderBy(*order).limit(n).select(key), key, "left_semi").select(*df.columns)


def ratio_sample(df: DataFrame, n: int, label: str, key: str, seed: int = 42) -> DataFrame:
    """floor(n * share) rows of each label; everything, if there are fewer than n rows."""
    counts = df.groupBy(F.col(label).alias("s_")).agg(F.count(F.lit(1)).alias("size"))
    quota = counts.withColumn("total", F.sum("size").over(W.partitionBy()))
    quota = quota.select("s_", F.when(F.col("total") < n, F.col("size")).otherwise(F.floor(F.lit(n) * F.col("size") / F.col("total"))).alias("quota"))
    return _within(df, quota, label, [draw_key(key, seed), F.col(key)])


def stratified_split(df: DataFrame, label: str | None, key: str, parts: dict[str, float], seed: int = 42) -> DataFrame:
    """df plus split: of each label, the first floor(share * count) rows in draw order get the first name, and so on; the last name takes the rest.

    Ranks come from a range-partitioned global order of (label, draw), so a label
    that most rows have is not sorted in one task.
    """
    t = df.withColumn("l_", F.col(label) if label else F.lit(0)).withColumn("d_", draw_key(key, seed)).withColumn("k_", F.col(key))
    t = running_total(t, ["l_", "d_", "k_"], None, "at_")
    starts = t.groupBy("l_").agg(F.min("at_").alias("s_"), F.count(F.lit(1)).alias("n_")).withColumnRenamed("l_", "m_")
    t = t.join(F.broadcast(starts), F.col("l_").eqNullSafe(F.col("m_")))  # one row for each label
    names, out, edge = list(parts), None, F.lit(0)
    for name in names[:-1]:
        edge = edge + F.floor(F.col("n_") * F.lit(parts[name]))
        inside = F.col("at_") - F.col("s_") < edge
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return t.withColumn("split", out.otherwise(names[-1])).drop("l_", "d_", "k_", "at_", "s_", "n_", "m_")
