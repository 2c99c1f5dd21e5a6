"""An extension: line rules over files as they arrive. The rules hold no state, so every batch stands for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.regex_rules import secret_lines
from ..sources.files import decode_lenient


def watch_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """New files below root as a stream of (path, content)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return raw.select("path", decode_lenient("content").alias("content"))


def stream_secrets(files: DataFrame) -> DataFrame:
    """Secret lines of streamed files."""
    return secret_lines(files)


def windowed_counts(findings: DataFrame, time_col: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings by severity in event-time windows; later rows than the watermark are not counted."""
    return findings.withWatermark(time_col, late).groupBy(F.window(time_col, size), "severity").agg(F.count("*").alias("n"))
