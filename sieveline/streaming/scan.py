"""Streams: the scan is stateless per fragment, so a streaming DataFrame takes the same transform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Scanner


def scan_stream(fragments: DataFrame, scanner: Scanner) -> DataFrame:
    """Findings of a streaming DataFrame of fragments, for append mode."""
    return scanner.scan(fragments)


def new_findings(findings: DataFrame, time: str = "seen_at", within: str = "1 hour") -> DataFrame:
    """A fingerprint is reported once within the watermark."""
    named = findings.withColumn("fingerprint", F.col("match.fingerprint"))
    return named.withWatermark(time, within).dropDuplicatesWithinWatermark(["fingerprint"])


def rate(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by time window and key (an extension: the scan itself knows no event time)."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), by, "n")
