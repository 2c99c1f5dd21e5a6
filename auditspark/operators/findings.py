"""Findings as one table: rule outputs in one shape, removal of repeats, checkers that ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EVIDENCE, FINDING, FIX, finding_id, severity_rank

SQL_CHECKERS = ("sql_injection", "contextual_sqli_audit")


def as_findings(hits: DataFrame, checker: Column, title: Column, severity: Column, kind: Column, confidence: Column, line: Column | None = None, snippet: Column | None = None, description: Column | None = None, advice: Column | None = None) -> DataFrame:
    """hits with a path as rows of the findings schema."""
    line = F.col("line") if line is None else line
    null = lambda t: F.lit(None).cast(t)
    evidence = F.array(F.struct(F.lit("rule").alias("type"), title.alias("description"), confidence.cast("double").alias("confidence"), null("string").alias("details")))
    fixes = F.array(F.struct(F.lit("prompt").alias("type"), F.concat(F.lit("Address: "), title).alias("description"), (null("string") if advice is None else advice).alias("prompt"), null("string").alias("auto_fix")))
    return hits.select(
        finding_id(checker, F.col("path"), line, title).alias("id"), title.alias("title"), (title if description is None else description).alias("description"), severity.alias("severity"), kind.alias("type"),
        F.col("path"), line.cast("int").alias("line_start"), null("int").alias("line_end"), null("int").alias("column_start"), null("int").alias("column_end"),
        checker.alias("checker"), evidence.cast(EVIDENCE).alias("evidence"), fixes.cast(FIX).alias("fixes"),
        (null("string") if snippet is None else snippet).alias("snippet"), null("string").alias("metadata"),
    )


def union(spark: SparkSession, *parts: DataFrame) -> DataFrame:
    out = spark.createDataFrame([], FINDING)
    for p in parts:
        out = out.unionByName(p)
    return out


def drop_repeats(findings: DataFrame, path: str = "path", line: str = "line_start", checker: str = "checker", severity: str = "severity", confidence: Column | None = None, literal: bool = False) -> DataFrame:
    """Of several SQL findings at one place the most severe stays (ties: sql_injection, then confidence, then title).

    Findings of other checkers all stay. `literal` breaks ties the other way round, by the larger checker name.
    """
    sql = F.col(checker).isin(*SQL_CHECKERS)
    tie = F.col(checker).desc() if not literal else F.col(checker).asc()
    order = Window.partitionBy(path, F.coalesce(F.col(line), F.lit(0)), sql).orderBy(
        severity_rank(F.col(severity)).desc(), tie, (confidence if confidence is not None else F.lit(0)).desc(), F.col("title")
    )
    return findings.withColumn("__rn", F.row_number().over(order)).where(~sql | (F.col("__rn") == 1)).drop("__rn")


def checker_status(spark: SparkSession, registered: list[str], ran: DataFrame) -> DataFrame:
    """(checker, status) for registered checkers: ran if it is among ran (checker), else skipped."""
    all_ = spark.createDataFrame([(c,) for c in registered], "checker string")
    both = all_.join(ran.select("checker").distinct().withColumn("ran", F.lit(True)), "checker", "left")
    return both.select("checker", F.when(F.col("ran"), "ran").otherwise("skipped").alias("status"))


def errors(results: DataFrame) -> DataFrame:
    """Rows that carry an error, with whether it is the model service's."""
    from .regex_rules import llm_error

    return results.where(F.col("error").isNotNull()).withColumn("is_llm_error", llm_error(F.col("error")))
