"""Schemas of files, lines and findings, and the small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "path string, name string, ext string, dir string, size_bytes bigint, content string"
EVIDENCE = "array<struct<type:string,description:string,confidence:double,details:string>>"
FIX = "array<struct<type:string,description:string,prompt:string,auto_fix:string>>"
FINDING = (
    "id string, title string, description string, severity string, type string, path string, line_start int, line_end int, "
    f"column_start int, column_end int, checker string, evidence {EVIDENCE}, fixes {FIX}, snippet string, metadata string"
)

# Severities from least to most severe, finding types, categories and their checkers.
SEVERITIES = ("info", "low", "medium", "high", "critical")
FINDING_TYPES = ("ai_generated", "bad_practice", "code_smell", "security_issue", "performance_issue", "style_issue")
CATEGORIES = {
    "Security Issues": ("hardcoded_secrets", "sql_injection", "dangerous_ai_logic", "contextual_sqli_audit"),
    "Code Quality": ("vibe_naming", "comment_quality", "edge_cases"),
    "Package & Dependencies": ("package_check", "dependency_validation"),
    "Best Practices": ("boilerplate",),
}
OTHER_CATEGORY = "Other Issues"


def severity_rank(severity: Column) -> Column:
    """critical 4 ... info 0; null for anything else."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def category_dim(spark: SparkSession) -> DataFrame:
    """checker, category, priority: ten rows."""
    rows = [(c, name, p) for p, (name, checkers) in enumerate(CATEGORIES.items()) for c in checkers]
    return spark.createDataFrame(rows, "checker string, category string, priority int")


def severity_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, severity_rank int")


def confidence(evidence: Column) -> Column:
    """Mean confidence of the evidence; 0.5 without any."""
    total = F.aggregate(evidence, F.lit(0.0), lambda a, e: a + e["confidence"])
    return F.coalesce(total / F.nullif(F.size(evidence), F.lit(0)), F.lit(0.5))


def location_text(path: Column, start: Column, end: Column) -> Column:
    """path:line N, path:lines A-B, or the path alone where there is no line."""
    one = F.concat(path, F.lit(":line "), start)
    many = F.concat(path, F.lit(":lines "), start, F.lit("-"), end)
    return F.when(F.coalesce(start, F.lit(0)) <= 0, path).when(end.isNotNull() & (end != start), many).otherwise(one)


def finding_id(*parts: Column) -> Column:
    """Stable id of a natural key."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def auto_fixes(fixes: Column) -> Column:
    return F.filter(fixes, lambda f: (f["type"] == "auto_fix") & f["auto_fix"].isNotNull())
