"""Row-wise operators on streams: cleaning, tests and scores need no state and run as they are; exact de-duplication needs a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as X


def curated(stream: DataFrame, text: str = "text", **rules) -> DataFrame:
    """Cleaned, accepted and scored rows of a stream (or of a table)."""
    t = stream.withColumn(text, F.explode(X.cleaned(F.col(text), **rules)))
    return t.withColumn("quality_score", X.quality_score(F.col(text)))


def deduplicated(stream: DataFrame, time: str, text: str = "text", delay: str = "1 hour") -> DataFrame:
    """First rows of equal texts within the watermark; state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([text])


def windowed_frequencies(stream: DataFrame, time: str, text: str = "text", width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """(window, text, frequency) with late rows up to the delay."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), text).agg(F.count(F.lit(1)).alias("frequency"))
