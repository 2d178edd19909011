"""Aggregates: shares, entropy, quantile profiles, agreement, correlation and classification metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.operators.frequency import quantiles, running_total


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share): the window is over one row for each value."""
    t = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def cluster_sizes(df: DataFrame, col: str) -> DataFrame:
    """One row: clusters, min, max, mean, population deviation of sizes, entropy and its share of the largest possible; noise (-1) is not a cluster."""
    t = df.filter(F.col(col) != -1).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = t.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    t = t.join(F.broadcast(total)).withColumn("p", F.col("n") / F.col("total"))
    out = t.agg(F.max("k").alias("n_clusters"), F.min("n").alias("size_min"), F.max("n").alias("size_max"), F.avg("n").alias("size_mean"), F.stddev_pop("n").alias("size_std"), F.sum(-F.col("p") * F.ln(F.col("p") + 1e-10)).alias("entropy"))
    return out.withColumn("normalized_entropy", F.when(F.col("n_clusters") > 1, F.col("entropy") / F.ln(F.col("n_clusters").cast("double"))).otherwise(0.0))


def coverage(sample: DataFrame, full: DataFrame, col: str) -> DataFrame:
    """(covered, active, coverage): clusters of the sample among all."""
    a = sample.agg(F.countDistinct(col).alias("covered"))
    b = full.agg(F.countDistinct(col).alias("active"))
    return a.join(F.broadcast(b)).withColumn("coverage", F.col("covered") / F.col("active"))


def score_stats(df: DataFrame, col: str) -> DataFrame:
    x = F.col(col)
    some = df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    return some.join(F.broadcast(quantiles(df, [], col, {"q25": 0.25, "median": 0.5, "q75": 0.75}, empty=True)))  # one row


def quantile_profile(df: DataFrame, label: str, col: str) -> DataFrame:
    """count, mean, deviation, extremes and quantiles of a column for each label."""
    x = F.col(col)
    qs = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    some = df.groupBy(label).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantiles(df, [label], col, qs).withColumnRenamed(label, "l_")
    return some.join(q, F.col(label).eqNullSafe(F.col("l_")), "left").drop("l_")


def integrity(df: DataFrame, text: str) -> DataFrame:
    """Counts of null, empty, short and long texts and of duplicate rows."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col(text).isNull(), 1)).alias("n_null"), F.count(F.when(t == "", 1)).alias("n_empty"), F.count(F.when(F.length(text) < 3, 1)).alias("n_short"), F.count(F.when(F.length(text) > 500, 1)).alias("n_long"), F.avg(F.length(text)).alias("mean_length"))
    distinct = df.groupBy(text).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("n_duplicates"))
    return one.join(F.broadcast(distinct))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """2 x 2 counts of two flags, and the percentage on which they agree."""
    x, y = F.col(a), F.col(b)
    n = lambda c: F.count(F.when(c, 1))
    return df.agg(n(x & y).alias("both"), n(x & ~y).alias("only_a"), n(~x & y).alias("only_b"), n(~x & ~y).alias("neither"), (n(x == y) * 100.0 / F.count(F.lit(1))).alias("agree_percent"))


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman coefficients with two-sided p-values, and n. Ranks come from the counts of distinct values, which are range-partitioned."""
    t = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")

    def ranks(c: str) -> DataFrame:
        v = t.groupBy(c).agg(F.count(F.lit(1)).alias("m"))
        return running_total(v, [c], "m").select(F.col(c), (F.col("before") + (F.col("m") + 1) / 2).alias(f"r{c}"))

    r = t.join(ranks("a"), "a").join(ranks("b"), "b")
    got = r.agg(F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"), F.count(F.lit(1)).alias("n")).collect()[0]
    row = (got["pearson"], p_value(got["pearson"], got["n"]), got["spearman"], p_value(got["spearman"], got["n"]), got["n"])
    return df.sparkSession.createDataFrame([row], "pearson double, pearson_p double, spearman double, spearman_p double, n long")


def p_value(r: float | None, n: int) -> float | None:
    """Two-sided tail of Student's t for a correlation of n pairs."""
    if r is None or n < 3 or r != r:
        return None
    if abs(r) >= 1:
        return 0.0
    v = n - 2
    return _beta_tail(v / (v + r * r * v / (1 - r * r)), v / 2, 0.5)


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by a continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """precision, recall, F1 and support of each class that occurs; 0 where undefined."""
    c = confusion(df, truth, guess)
    a = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    b = c.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    hit = c.filter("truth = guess").select(F.col("truth").alias("label"), F.col("n").alias("hits"))
    t = a.join(b, "label", "full").join(hit, "label", "left").na.fill(0, ["support", "guessed", "hits"])
    p = F.when(F.col("guessed") > 0, F.col("hits") / F.col("guessed")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    t = t.withColumn("precision", p).withColumn("recall", r)
    return t.select("label", "support", "precision", "recall", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0).alias("f1"))


def summary_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, and macro and weighted means of precision, recall and F1."""
    t = class_metrics(df, truth, guess)
    names = ("precision", "recall", "f1")
    acc = df.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))
    means = t.agg(*(F.avg(n).alias(f"macro_{n}") for n in names), *((F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(f"weighted_{n}") for n in names))
    return acc.join(F.broadcast(means))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """(bin, n): equal widths from the least to the largest value; the last bin is closed."""
    x = F.col(col).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    t = df.join(F.broadcast(ends)).filter(x.isNotNull())
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((x - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(F.lit(0))
    return t.groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, label: str, col: str) -> DataFrame:
    """Quartiles and whisker ends (furthest values within 1.5 interquartile ranges) for each class."""
    x = F.col(col).cast("double")
    q = quantiles(df, [label], col, {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumnRenamed(label, "l_")
    # Whisker ends need each distinct value once, so equal values are one row in the join.
    values = df.groupBy(F.col(label).alias("label"), x.alias("x_")).agg(F.count(F.lit(1)).alias("m_"))
    t = values.join(q, F.col("label").eqNullSafe(F.col("l_")), "left")
    reach, v = 1.5 * (F.col("q3") - F.col("q1")), F.col("x_")
    return t.groupBy("label").agg(*[F.max(c).alias(c) for c in ("q1", "median", "q3")], F.min(F.when(v >= F.col("q1") - reach, v)).alias("low"), F.max(F.when(v <= F.col("q3") + reach, v)).alias("high"))


def scatter_pairs(df: DataFrame, x: str, y: str, label: str | None = None) -> DataFrame:
    """(label, x, y): the points of a scatter chart; rows without both values have none."""
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return points.select(*([F.col(label).alias("label")] if label else []), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
