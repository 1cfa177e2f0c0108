"""Streams of claims and of verdicts (beyond the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.operators.matching import contains_exactly


def exact_in_evidence(stream: DataFrame, sources: DataFrame, group: str = "group_id") -> DataFrame:
    """Claims of a stream that a static text of their group holds word for word; stateless."""
    return stream.join(sources.select(group, "source_index", F.col("text").alias("_t")), group).filter(contains_exactly("claim", "_t")).drop("_t")


def once(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once, as far as repeats come within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def verdict_counts(stream: DataFrame, time: str, verdict: str, size: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts of verdicts by tumbling or sliding window with a watermark."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), verdict).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), verdict, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Number and span of the events of each key's sessions."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
