"""Summaries, orders and renderings of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.text import lines
from ..schema import OTHER_CATEGORY, SEVERITIES, category_dim, confidence, location_text, severity_dim, severity_rank


def summary_counts(findings: DataFrame) -> DataFrame:
    """(kind, value, n): counts by severity, type and checker, and the total, from one pass (grouping sets)."""
    cube = findings.groupingSets([["severity"], ["type"], ["checker"], []], "severity", "type", "checker").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "type").when(F.col("g") == 6, "checker").otherwise("total")
    return cube.select(kind.alias("kind"), F.coalesce("severity", "type", "checker", F.lit("all")).alias("value"), "n")


def select(findings: DataFrame, severity: str | None = None, kind: str | None = None, checker: str | None = None, path: str | None = None) -> DataFrame:
    for name, value in (("severity", severity), ("type", kind), ("checker", checker), ("path", path)):
        if value is not None:
            findings = findings.where(F.col(name) == value)
    return findings


def triage(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """(severity, n): all five severities, zero where there is none."""
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return severity_dim(spark).join(counts, "severity", "left").select("severity", "severity_rank", F.coalesce("n", F.lit(0)).alias("n"))


def recommendations(findings: DataFrame) -> DataFrame:
    """(topic) that the mix of types calls for."""
    mix = findings.agg(
        F.count_if(F.col("type") == "security_issue").alias("s"), F.count_if(F.col("type") == "performance_issue").alias("p"),
        F.count_if(F.col("type") == "bad_practice").alias("b"), F.count("*").alias("n"),
    )
    topics = F.array_compact(
        F.array(F.when(F.col("s") > 0, "security"), F.when(F.col("p") > 0, "performance"), F.when(F.col("b") > 0.2 * F.col("n"), "practices"))
    )
    return mix.select(F.explode(topics).alias("topic"))


def with_category(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """Adds category and priority; the dimension has ten rows, so it is broadcast."""
    out = findings.join(F.broadcast(category_dim(spark)), "checker", "left")
    return out.withColumns({"category": F.coalesce("category", F.lit(OTHER_CATEGORY)), "priority": F.coalesce("priority", F.lit(4))})


def ranked(findings: DataFrame, by_file: bool, confidence_col: Column) -> DataFrame:
    """Adds `rank`, the place in a plain report (category, severity, confidence) or one by file (category, path, ...).

    Rows are sorted in ranges; a row's rank is its place in its range and the sizes of the ranges before, so no task
    sees all of them.
    """
    order = [F.col("priority"), F.col("category"), *([F.col("path")] if by_file else []), severity_rank(F.col("severity")).desc(), confidence_col.desc(), F.col("path"), F.col("line_start"), F.col("id")]
    dealt = durable(findings.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each range
    offsets = dealt.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return numbered.join(F.broadcast(offsets), "__part").withColumn("rank", (F.col("__at") + F.col("__before")).cast("int")).drop("__part", "__at", "__before")


def category_rollup(findings: DataFrame) -> DataFrame:
    """(category, path, n): counts by category, and by file in each."""
    return findings.rollup("category", "path").agg(F.count("*").alias("n")).where("category IS NOT NULL")


def severity_columns(findings: DataFrame, key: str) -> DataFrame:
    """Counts of each severity as columns, by key."""
    wide = findings.groupBy(key).pivot("severity", list(reversed(SEVERITIES))).agg(F.count(F.lit(1)))
    return wide.select(key, *[F.coalesce(s, F.lit(0)).alias(s) for s in reversed(SEVERITIES)])


def to_json(findings: DataFrame) -> DataFrame:
    """Adds `json`, one document for each finding."""
    location = F.struct(F.col("path").alias("file"), "line_start", "line_end", "column_start", "column_end")
    shape = F.struct("id", "title", "description", "severity", "type", location.alias("location"), F.col("checker").alias("checker_name"), confidence(F.col("evidence")).alias("confidence"), "fixes")
    return findings.withColumn("json", F.to_json(shape, {"ignoreNullFields": "false"}))


def plain_line(findings: DataFrame, snippet_lines: int = 15) -> DataFrame:
    """Adds `rendered`: severity, title, place, and at most so many lines of the snippet."""
    rows = lines(F.coalesce("snippet", F.lit("")))
    shown = F.when(F.size(rows) > snippet_lines, F.concat(F.slice(rows, 1, snippet_lines - 1), F.array(F.lit("...")))).otherwise(rows)
    place = location_text(F.col("path"), F.col("line_start"), F.col("line_end"))
    head = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "title", F.lit(" - "), place)
    return findings.withColumn("rendered", F.array_join(F.concat(F.array(head), shown), "\n"))


def has_issues(findings: DataFrame) -> bool:
    return not findings.isEmpty()
