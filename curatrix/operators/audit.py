"""Audits: label noise, model against model, and out-of-distribution thresholds by energy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.operators.frequency import quantiles, ranked


def label_issues(df: DataFrame, key: str, label: str = "label", probs: str = "probs", classes: int = 2) -> DataFrame:
    """(key, label, guess, quality_score, is_issue) by confident learning (Northcutt, Jiang and Chuang 2021).

    Thresholds are the mean own-class probabilities; the confident joint counts rows
    of label i whose largest probability over its threshold is class j; it is
    calibrated to the label counts. An issue is pruned by class (lowest own
    probability) and by noise rate (largest margin of j over i), and its largest
    probability is another class than its label.
    """
    t = df.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"), F.col(probs).alias("p"))
    t = t.withColumn("own", F.get("p", F.col("y"))).withColumn("top", (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    means = t.groupBy("y").agg(F.avg("own").alias("t"), F.count(F.lit(1)).alias("n"))
    row = means.agg(F.map_from_entries(F.collect_list(F.struct("y", "t"))).alias("ts"), F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("ns"))  # one entry for each class
    t = t.join(F.broadcast(row))
    options = F.filter(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.struct(F.get("p", c).alias("p"), (-c).alias("c"), F.element_at("ts", c).alias("t"))), lambda s: s["p"] >= s["t"])
    t = t.withColumn("j", -F.array_max(options)["c"])
    joint = t.filter("j IS NOT NULL").groupBy("y", "j").agg(F.count(F.lit(1)).alias("c"))
    joint = joint.withColumn("row", F.sum("c").over(W.partitionBy("y"))).join(means.select("y", "n"), "y")
    joint = joint.withColumn("est", F.col("c") / F.col("row") * F.col("n"))
    wrong = joint.filter("y <> j")
    per_class = wrong.groupBy("y").agg(F.round(F.sum("est")).cast("long").alias("n_class")).withColumnRenamed("y", "y_")
    per_pair = wrong.select(F.col("y").alias("i"), F.col("j").alias("to"), F.round("est").cast("long").alias("n_pair"))
    # Places in a class or a pair of classes come from range-partitioned order, so no class is sorted in one task.
    low = ranked(t.join(F.broadcast(per_class), F.col("y") == F.col("y_")), "y", [F.col("own"), F.col("k")], "r").filter("r <= n_class").select("k")
    pairs = t.join(F.broadcast(per_pair), F.col("y") == F.col("i")).withColumn("margin", F.get("p", F.col("to")) - F.col("own")).withColumn("pair", F.struct("y", "to"))
    far = ranked(pairs, "pair", [-F.col("margin"), F.col("k")], "r").filter("r <= n_pair").select("k").distinct()
    issue = low.join(far, "k").select("k", F.lit(True).alias("hit"))
    out = t.join(issue, "k", "left")
    return out.select(F.col("k").alias(key), F.col("y").alias("label"), F.col("top").alias("guess"), F.col("own").alias("quality_score"), (F.coalesce("hit", F.lit(False)) & (F.col("top") != F.col("y"))).alias("is_issue"))


def compare_reports(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Two quality reports by row: both flags, both guesses, whether both flag it and the smaller score."""
    from curatrix.operators.relational import paired

    t = paired(a, b, key)
    return t.select(key, F.col("label_a").alias("label"), F.col("quality_score_a"), F.col("quality_score_b"), F.col("is_issue_a"), F.col("is_issue_b"), F.col("guess_a"), F.col("guess_b"), (F.col("is_issue_a") & F.col("is_issue_b")).alias("both_issue"), F.least("quality_score_a", "quality_score_b").alias("min_quality"))


def energy_thresholds(df: DataFrame, energy: str = "energy") -> DataFrame:
    """(name, low, high): quantile pairs conservative, moderate and aggressive, and mean - 1 with mean + 2 and + 3 deviations."""
    e = F.col(energy)
    probs = {f"q{i}": p for i, p in enumerate((0.10, 0.99, 0.25, 0.95, 0.50, 0.90))}
    some = df.agg(F.avg(e).alias("m"), F.stddev_pop(e).alias("s"))
    q = some.join(F.broadcast(quantiles(df, [], energy, probs, empty=True))).withColumn("q", F.array(*probs))  # one row
    rows = [("conservative", F.col("q")[0], F.col("q")[1]), ("moderate", F.col("q")[2], F.col("q")[3]), ("aggressive", F.col("q")[4], F.col("q")[5]), ("std_2", F.col("m") - F.col("s"), F.col("m") + 2 * F.col("s")), ("std_3", F.col("m") - F.col("s"), F.col("m") + 3 * F.col("s"))]
    return q.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), lo.alias("low"), hi.alias("high")) for n, lo, hi in rows])).alias("r")).select("r.*")


def energy_search(df: DataFrame, energy: str = "energy", is_ood: str = "is_ood", steps: int = 100) -> DataFrame:
    """(step, threshold, tpr, tnr, score): of `steps` even thresholds from least to largest energy, the share of in-distribution rows below and of others at or above.

    Rows fall into the gap between two thresholds once; sums over the gaps give all
    thresholds, so rows are not multiplied by them.
    """
    e = F.col(energy)
    ends = df.agg(F.min(e).alias("lo"), F.max(e).alias("hi"), F.sum(F.when(F.col(is_ood), 0).otherwise(1)).alias("n_id"), F.sum(F.when(F.col(is_ood), 1).otherwise(0)).alias("n_ood"))
    grid = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).withColumn("threshold", F.col("lo") + (F.col("hi") - F.col("lo")) / (steps - 1) * F.col("step"))
    lookup = ends.join(F.broadcast(grid.agg(F.array_sort(F.collect_list("threshold")).alias("ts"))))
    t = df.join(F.broadcast(lookup)).withColumn("gap", F.size(F.filter("ts", lambda x: x <= e)))  # thresholds at or below the row
    gaps = t.groupBy("gap").agg(F.sum(F.when(F.col(is_ood), 0).otherwise(1)).alias("i"), F.sum(F.when(F.col(is_ood), 1).otherwise(0)).alias("o"))
    # threshold of step s is over rows of gap <= s; at most steps + 1 rows on either side
    joined = grid.join(F.broadcast(gaps))
    out = joined.groupBy("step", "threshold").agg((F.sum(F.when(F.col("gap") <= F.col("step"), F.col("i")).otherwise(0)) / F.first("n_id")).alias("tpr"), (F.sum(F.when(F.col("gap") > F.col("step"), F.col("o")).otherwise(0)) / F.first("n_ood")).alias("tnr"))
    return out.withColumn("score", F.col("tpr") + F.col("tnr"))


def best_threshold(search: DataFrame) -> DataFrame:
    return search.orderBy(F.desc("score"), "threshold").limit(1)


def predictions(df: DataFrame, logits: str = "logits", low: float | None = None, high: float | None = None, temperature: float = 1.0) -> DataFrame:
    """df plus prediction, confidence and, with thresholds, energy and reason."""
    from curatrix.functions import logits as L

    p = L.softmax(F.col(logits))
    df = df.withColumn("prediction", L.argmax(F.col(logits)).cast("string")).withColumn("confidence", F.array_max(p))
    if high is None:
        return df
    df = df.withColumn("energy", L.energy(F.col(logits), temperature))
    label, reason = L.energy_decision(F.col("energy"), F.col("prediction"), low if low is not None else float("-inf"), high)
    return df.withColumn("reason", reason).withColumn("prediction", label)


def ood_detection(val: DataFrame, test: DataFrame, logits: str = "logits", kind: str = "moderate", temperature: float = 1.0) -> DataFrame:
    """test plus prediction, energy and reason under the thresholds of `kind` from val, and detected (above the upper one)."""
    from curatrix.functions import logits as L

    e = val.withColumn("energy", L.energy(F.col(logits), temperature))
    row = energy_thresholds(e).filter(F.col("name") == kind).collect()[0]
    return predictions(test, logits, row["low"], row["high"], temperature).withColumn("detected", F.col("energy") > row["high"])
