"""Validators and reports: sampling checks, recommendations, statistics documents and annotation quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators.stats import cluster_sizes, integrity, score_stats

# Thresholds of the sampling checks.
THRESHOLDS = {"coverage": 0.95, "entropy": 0.80, "quality": 0.50, "size": 15000, "per_cluster": 3, "share": 0.10}


def sampling_checks(sample: DataFrame, n_clusters: int | None = None, text: str = "text", score: str = "quality_score", cluster: str = "cluster_id") -> DataFrame:
    """(name, value, threshold, status) of size, coverage, diversity, quality, balance and integrity. Only coverage can FAIL; it is 1 if the number of clusters isn't known."""
    c = cluster_sizes(sample, cluster)
    row = c.join(F.broadcast(sample.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(score).alias("quality")))).join(F.broadcast(integrity(sample, text)))
    cover = F.col("n_clusters") / F.lit(float(n_clusters)) if n_clusters else F.lit(1.0)
    bad = (F.col("n_null") + F.col("n_empty") + F.col("n_duplicates")).cast("double")
    t = {k: F.lit(float(v)) for k, v in THRESHOLDS.items()}

    def check(name, value, limit, ok, otherwise="WARN"):
        return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), limit.alias("threshold"), F.when(ok, "PASS").otherwise(otherwise).alias("status"))

    checks = F.array(
        check("sample_size", F.col("n"), t["size"], F.col("n") >= t["size"]), check("cluster_coverage", cover, t["coverage"], cover >= t["coverage"], "FAIL"),
        check("diversity", F.col("normalized_entropy"), t["entropy"], F.col("normalized_entropy") >= t["entropy"]), check("mean_quality", F.col("quality"), t["quality"], F.col("quality") >= t["quality"]),
        check("cluster_balance", F.col("size_max") / F.col("n"), t["share"], (F.col("size_min") >= t["per_cluster"]) & (F.col("size_max") / F.col("n") <= t["share"])), check("integrity", bad, F.lit(0.0), bad == 0),
    )
    return row.select(F.explode(checks).alias("c")).select("c.*")


def overall(checks: DataFrame) -> DataFrame:
    """(passed, failed, warnings, overall_status)."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    t = checks.agg(n("PASS").alias("passed"), n("FAIL").alias("failed"), n("WARN").alias("warnings"))
    status = F.when((F.col("failed") == 0) & (F.col("warnings") == 0), "EXCELLENT").when(F.col("failed") == 0, "GOOD").when(F.col("failed") <= 2, "ACCEPTABLE").otherwise("NEEDS_IMPROVEMENT")
    return t.withColumn("overall_status", status)


def recommendations(stats: DataFrame) -> DataFrame:
    """(code): advice for one row of coverage, entropy, quality and n, in a fixed order."""
    c, e, q, n = (F.col(x) for x in ("coverage", "entropy", "quality", "n"))
    codes = [
        F.when(c < 0.90, "coverage_low").when(c >= 0.95, "coverage_good"), F.when(e < 0.7, "diversity_low").when(e >= 0.85, "diversity_good"),
        F.when(q < 0.4, "quality_low").when(q >= 0.6, "quality_good"), F.when(n < 10000, "size_small").when(n >= 15000, "size_good").otherwise("size_fair"),
        F.when((c >= 0.95) & (e >= 0.8) & (q >= 0.5), "ready_to_label"), F.lit("enough_labels_per_class"), F.lit("label_borderline_cases"), F.lit("use_active_learning"), F.lit("augment_data"),
    ]
    return stats.select(F.posexplode(F.array(*codes)).alias("pos", "code")).filter("code IS NOT NULL")


def statistics_document(raw: DataFrame, cleaned: DataFrame, unique: DataFrame, sample: DataFrame, score: str = "quality_score", cluster: str = "cluster_id") -> DataFrame:
    """One row of nested statistics with its JSON text; both true counts, after cleaning and after de-duplication, are given."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = n(raw, "raw")
    for df, name in ((cleaned, "after_cleaning"), (unique, "after_dedup"), (sample, "sampled")):
        row = row.join(F.broadcast(n(df, name)))
    q, c = score_stats(sample, score), cluster_sizes(sample, cluster)
    row = row.select(F.struct("*").alias("pipeline_stats")).join(F.broadcast(q.select(F.struct("*").alias("quality_stats")))).join(F.broadcast(c.select(F.struct("*").alias("clustering_stats"))))
    return row.withColumn("document", F.to_json(F.struct("pipeline_stats", "quality_stats", "clustering_stats")))


def annotation_quality(df: DataFrame, text: str = "text", label: str = "label", score: str | None = None, positive: str = "寿险相关") -> DataFrame:
    """One row: completeness and largest share of labels with their flags, and counts of suspicious rows (very short or low-scored positives)."""
    lab = F.nullif(F.col(label).cast("string"), F.lit(""))
    pos = lab == positive
    low = F.count(F.when(pos & (F.col(score) < 0.3), 1)) if score else F.lit(0).cast("long")
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count(lab).alias("labelled"), F.count(F.when(pos & (F.length(text) < 5), 1)).alias("short_positive"), low.alias("low_score_positive"))
    shares = df.filter(lab.isNotNull()).groupBy(lab.alias("l")).agg(F.count(F.lit(1)).alias("m")).agg(F.min("m").alias("least"), F.max("m").alias("most"))
    t = one.join(F.broadcast(shares)).withColumn("completeness", F.col("labelled") / F.col("n"))
    return t.select("n", "labelled", "completeness", (F.col("completeness") >= 0.95).alias("complete"), (F.col("least") / F.col("labelled") < 0.1).alias("rare_label"), (F.col("most") / F.col("labelled") > 0.9).alias("dominant_label"), "short_positive", "low_score_positive")


def split_advice(df: DataFrame, label: str, positive) -> DataFrame:
    """(n_train, n_val, ratio, balance): an 85/15 split and how balanced two labels are."""
    r = F.col("ratio")
    t = df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == positive).cast("double")).alias("ratio"))
    return t.select(F.floor(F.col("n") * 0.85).cast("long").alias("n_train"), (F.col("n") - F.floor(F.col("n") * 0.85)).cast("long").alias("n_val"), "ratio", F.when(r.between(0.3, 0.7), "balanced").when(r.between(0.2, 0.8), "acceptable").otherwise("unbalanced").alias("balance"))


def text_report(sample: DataFrame, text: str = "text", score: str = "quality_score") -> str:
    """A short report from one aggregate row."""
    s, i = score_stats(sample, score).collect()[0], integrity(sample, text).collect()[0]
    return "\n".join([f"rows: {i['n_rows']}", f"duplicates: {i['n_duplicates']}", f"mean length: {i['mean_length']:.1f}", *(f"{score} {k}: {s[k]:.3f}" for k in s.__fields__ if s[k] is not None)])
