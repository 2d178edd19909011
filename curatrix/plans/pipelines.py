"""Curation pipelines: full, simple and secondary sampling, training format, and splits. Lazy until a clustering is fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as X
from curatrix.functions.parse import mapped_label
from curatrix.operators import sampling as S
from curatrix.operators.frequency import frequencies, keep_first, smoothed
from curatrix.operators.vectors import cut, fit_predict, hashed_ngrams


def cleaned(df: DataFrame, text: str, index: str = "original_index", **rules) -> DataFrame:
    """(original_index, text): cleaned texts that pass all tests."""
    return df.select(F.col(index).alias("original_index"), F.explode(X.cleaned(F.col(text), **rules)).alias("text"))


def scored(df: DataFrame, words=X.DOMAIN, script: str = r"[\x{4e00}-\x{9fff}]") -> DataFrame:
    return df.withColumn("quality_score", X.quality_score(F.col("text"), words, script))


def full(df: DataFrame, n: int, k: int, text: str = "text", index: str = "original_index", cap: int = 1_000_000, rules: dict | None = None, words=X.DOMAIN, script: str = r"[\x{4e00}-\x{9fff}]", method: str = "kmeans", vectors=hashed_ngrams) -> DataFrame:
    """Clean, cap, de-duplicate with frequency, embed, cluster, oversample by strata, score, and take the best of each cluster. Columns: text, frequency, quality_score, cluster_id, original_index, importance, label."""
    t = S.spread_sample(cleaned(df, text, index, **(rules or {})), cap, "original_index")
    unique = cut(vectors(frequencies(t)))  # the fit reads it again and again
    labels = fit_predict(unique, "original_index", method, k).withColumnRenamed("cluster", "cluster_id")
    unique = unique.drop("v").join(labels, "original_index")
    over = S.stratified_sample(unique, 3 * n, "cluster_id", "original_index", "hybrid", 5, 3 * n // k * 3, smoothed(F.col("frequency")))
    best = S.cluster_balanced_top(scored(over, words, script), n, "cluster_id", "quality_score", "original_index")
    return best.select("text", "frequency", "quality_score", "cluster_id", "original_index", X.importance(F.col("frequency")).alias("importance"), F.lit("").alias("label"))


def simple(df: DataFrame, n: int, k: int, text: str = "text", index: str = "original_index", cap: int = 500_000, rules: dict | None = None, words=X.DOMAIN, script: str = r"[\x{4e00}-\x{9fff}]", vectors=hashed_ngrams) -> DataFrame:
    """Clean, de-duplicate, cap, cluster, sample evenly and take the best by score. Columns: text, quality_score, label."""
    t = keep_first(cleaned(df, text, index, **(rules or {})), ["text"], ["original_index"])
    t = cut(vectors(S.spread_sample(t, cap, "original_index")))
    t = t.drop("v").join(fit_predict(t, "original_index", "kmeans", k), "original_index")
    over = scored(S.simple_stratified(t, 2 * n, k, "cluster", "original_index"), words, script)
    return S.top_k(over, n, "quality_score", "original_index").select("text", "quality_score", F.lit("").alias("label"))


def secondary(df: DataFrame, n: int, k: int, text: str = "text", index: str = "original_index", clean: bool = False, rules: dict | None = None, words=X.DOMAIN, script: str = r"[\x{4e00}-\x{9fff}]", vectors=hashed_ngrams) -> DataFrame:
    """As full, without caps, with optional cleaning, at least max(5, n // k // 5) rows of each cluster and no rescaling."""
    t = cleaned(df, text, index, **(rules or {})) if clean else df.select(F.col(index).alias("original_index"), F.col(text).alias("text")).filter("text IS NOT NULL")
    unique = cut(vectors(frequencies(t)))  # the fit reads it again and again
    unique = unique.drop("v").join(fit_predict(unique, "original_index", "kmeans", k).withColumnRenamed("cluster", "cluster_id"), "original_index")
    over = S.stratified_sample(unique, 3 * n, "cluster_id", "original_index", "hybrid", max(5, n // k // 5), None, smoothed(F.col("frequency")))
    best = S.cluster_balanced_top(scored(over, words, script), n, "cluster_id", "quality_score", "original_index", rescale=False)
    return best.select("text", "frequency", "quality_score", "cluster_id", "original_index", X.importance(F.col("frequency")).alias("importance"), F.lit("").alias("label"))


def training_format(df: DataFrame, text: str = "text", label: str = "label", order: str = "original_index", names: dict | None = None) -> DataFrame:
    """(question, answer): labelled rows, label names mapped, unmapped ones dropped, first row of each question."""
    kind = mapped_label(F.col(label), names) if names else mapped_label(F.col(label))
    t = df.filter(F.nullif(F.col(label), F.lit("")).isNotNull()).select(F.col(text).alias("question"), kind.alias("answer"), order).filter("answer IS NOT NULL")
    return keep_first(t, ["question"], [order]).select("question", "answer")
