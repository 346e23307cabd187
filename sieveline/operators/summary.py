"""Aggregates over findings: counts, breakdowns, roll-ups, severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = ("none", "error", "invalid", "unknown", "revoked", "needs_validation", "valid")
HIGH = ("admin", "create_credentials", "manage_users", "read_secrets", "write")


def status_rank(status: Column) -> Column:
    """valid over needs_validation over revoked over unknown over invalid over error over none."""
    return F.array_position(F.array(*map(F.lit, STATUS)), F.coalesce(F.nullif(status, F.lit("")), F.lit("none")))


def rolled_up(df: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """The most telling status of each group."""
    return df.groupBy(*keys).agg(F.max_by(status, status_rank(F.col(status))).alias("status"))


def best_analysis(df: DataFrame, keys: list[str]) -> DataFrame:
    """The best analysis of each group: by status, severity, no reason, capabilities, identity; the first wins ties.

    df: keys, ordinal, status, severity, reason, capabilities, identity.
    """
    severity = F.array_position(F.array(F.lit("unknown"), F.lit("medium"), F.lit("high")), F.coalesce("severity", F.lit("")))
    rank = F.struct(status_rank(F.col("status")), severity, F.coalesce("reason", F.lit("")) == "", F.size(F.coalesce("capabilities", F.array())), F.col("identity").isNotNull(), -F.col("ordinal"))
    fields = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*fields), rank).alias("a")).select(*keys, "a.*")


def severity(capabilities: Column) -> Column:
    """high for capabilities that change or give access, medium for reading, else unknown."""
    return F.when(F.arrays_overlap(capabilities, F.array(*map(F.lit, HIGH))), "high").when(F.array_contains(capabilities, "read"), "medium").otherwise("unknown")


def scan_summary(findings: DataFrame) -> DataFrame:
    """One row: number of findings and the breakdown of confidence."""
    level = F.col("confidence")
    return findings.agg(
        F.count(F.lit(1)).alias("num_findings"),
        F.count_if(level == "high").alias("confidence_high"),
        F.count_if(level == "medium").alias("confidence_medium"),
        F.count_if(level == "low").alias("confidence_low"),
        F.count_if(F.coalesce(level, F.lit("")) == "").alias("confidence_none"),
        F.count_if(~F.coalesce(level, F.lit("")).isin("high", "medium", "low", "")).alias("confidence_other"),
    )


def analysis_summary(findings: DataFrame) -> DataFrame:
    """One row: breakdowns of status and severity of validated findings."""
    status = F.coalesce(F.nullif(F.col("analysis.status"), F.lit("")), F.lit("none"))
    level = F.coalesce(F.nullif(F.col("analysis.severity"), F.lit("")), F.lit("none"))
    counts = [F.count_if(status == s).alias(f"status_{s}") for s in STATUS] + [F.count_if(level == s).alias(f"severity_{s}") for s in ("high", "medium", "unknown", "none")]
    return findings.agg(*counts)


def merged_summaries(summaries: DataFrame) -> DataFrame:
    """Summaries of several targets added up."""
    return summaries.agg(*[F.sum(c).alias(c) for c in summaries.columns])


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


def bytes_scanned(fragments: DataFrame) -> DataFrame:
    return fragments.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes_scanned"))
