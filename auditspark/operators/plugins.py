"""Checkers of one's own: a column rule over lines, or a Python function over a file, registered by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import explode_lines
from .findings import as_findings, union

HITS = "path string, line int, title string, severity string, type string, confidence double"


@dataclass(frozen=True)
class Checker:
    """`rule` maps a line's column to a boolean; `check` maps (path, content) to (line, title, severity, type, confidence).

    Give one or both: both together run as one checker, rule first.
    """

    name: str
    description: str = ""
    extensions: tuple[str, ...] = (".py",)
    rule: Callable[[Column], Column] | None = None
    check: Callable[[str, str], Iterable[tuple[int, str, str, str, float]]] | None = None
    severity: str = "medium"
    type: str = "bad_practice"
    confidence: float = 0.7


def run_checker(files: DataFrame, checker: Checker) -> list[DataFrame]:
    mine, parts = files.where(F.col("ext").isin(list(checker.extensions))), []
    if checker.rule is not None:
        hits = explode_lines(mine).where(checker.rule(F.col("text")))
        parts.append(hits.select("path", "line", F.lit(checker.description or checker.name).alias("title"), F.lit(checker.severity).alias("severity"), F.lit(checker.type).alias("type"), F.lit(checker.confidence).alias("confidence")))
    if checker.check is not None:
        check = checker.check

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(p, *hit) for p, c in zip(batch["path"], batch["content"], strict=True) for hit in check(p, c or "")]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in HITS.split(", ")])

        parts.append(mine.select("path", "content").mapInPandas(run, HITS))
    return [as_findings(p, F.lit(checker.name), F.col("title"), F.col("severity"), F.col("type"), F.col("confidence")) for p in parts]


def run_checkers(spark: SparkSession, files: DataFrame, checkers: Iterable[Checker]) -> DataFrame:
    return union(spark, *[part for c in checkers for part in run_checker(files, c)])


def describe(spark: SparkSession, checkers: Iterable[Checker]) -> DataFrame:
    rows = [(c.name, c.description, c.check is None, list(c.extensions)) for c in checkers]
    return spark.createDataFrame(rows, "name string, description string, columns_only boolean, extensions array<string>")
