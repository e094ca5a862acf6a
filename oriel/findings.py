"""Findings: the one result table of all checks, and what is done with it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "check_id string, category string, title string, severity string, focus_node string, path string, value string, message string, remediation string, sources array<string>"
RANK = {"Violation": 0, "Warning": 1, "Info": 2}
KEY = ["check_id", "focus_node", "path", "value"]


def joined(values: Column) -> Column:
    """Distinct values in order, with commas; null for none."""
    kept = F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull())))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", "))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def make(rows: DataFrame, check, source: str) -> DataFrame:
    """Findings of one check from rows of focus, path, value and message; a missing value is the focus."""
    return rows.select(
        F.lit(check.id).alias("check_id"),
        F.lit(check.category).alias("category"),
        F.lit(check.title).alias("title"),
        F.lit(check.severity).alias("severity"),
        F.col("focus").alias("focus_node"),
        F.col("path").cast("string").alias("path"),
        F.coalesce(F.col("value").cast("string"), F.col("focus")).alias("value"),
        F.coalesce(F.col("message"), F.lit("")).alias("message"),
        F.lit(check.remediation).alias("remediation"),
        F.array(F.lit(source)).alias("sources"),
    )


def union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else empty(spark)


def merge(findings: DataFrame) -> DataFrame:
    """One row for each check, focus, path and value; the least message; all sources."""
    rest = [c for c in ("category", "title", "severity", "message", "remediation")]
    first = F.min(F.struct(F.col("message").alias("message"), *[c for c in rest if c != "message"]))
    merged = findings.groupBy(*KEY).agg(first.alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"))
    return merged.select("check_id", "first.category", "first.title", "first.severity", "focus_node", "path", "value", "first.message", "first.remediation", "sources")


def keys_of(findings: DataFrame, check) -> DataFrame:
    """The distinct keys of one check's findings, with what is the same for all of them."""
    keys = findings.select("focus_node", "path", "value").distinct()
    return keys.select(F.lit(check.id).alias("check_id"), F.lit(check.category).alias("category"), F.lit(check.title).alias("title"), F.lit(check.severity).alias("severity"), "focus_node", "path", "value", F.lit(check.remediation).alias("remediation"))


def rank(severity: Column) -> Column:
    out = F.lit(9)
    for name, value in RANK.items():
        out = F.when(severity == name, value).otherwise(out)
    return out


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(rank(F.col("severity")), "category", "check_id", "focus_node", "path", "value")


def in_namespace(findings: DataFrame, namespace: str) -> DataFrame:
    return findings.where(F.col("focus_node").startswith(namespace))


def gate(findings: DataFrame, level: str) -> int:
    """1 where a finding is at or above the severity, else 0."""
    return int(not findings.where(rank(F.col("severity")) <= RANK[level]).isEmpty())


def category_pivot(findings: DataFrame) -> DataFrame:
    """Counts by category and severity."""
    return findings.groupBy("category").pivot("severity", list(RANK)).count().na.fill(0)


def by_check(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """A count for every registered check, those without findings included."""
    counts = findings.groupBy("check_id").agg(F.count("*").alias("n_findings"))
    return registry.join(counts, "check_id", "left").select("check_id", "category", "title", "severity", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def top_offenders(findings: DataFrame, n: int = 15) -> DataFrame:
    """The nodes with most findings."""
    return findings.groupBy("focus_node").agg(F.count("*").alias("n_findings")).orderBy(F.desc("n_findings"), "focus_node").limit(n)
