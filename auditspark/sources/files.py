"""Files as rows: discovery, selection by size and globs, decoding; and tables read as files."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lines


def glob_regex(glob: str) -> str:
    """An anchored expression of a shell pattern; * and ? also stand for slashes."""
    out = []
    for ch in glob:
        out.append(".*" if ch == "*" else "." if ch == "?" else re.escape(ch))
    return f"(?s)^{''.join(out)}$" if "[" not in glob else fnmatch.translate(glob).replace("\\Z", "$").replace("\\z", "$")


def any_glob(path: Column, globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | F.rlike(path, F.lit(glob_regex(g)))
    return out


def in_excluded_dir(path: Column, globs: Sequence[str]) -> Column:
    """Some directory above the file matches a pattern: with a final slash by its name, else by name or whole path."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    out = F.lit(False)
    for pattern in (glob_regex(g.rstrip("/")) for g in globs):
        out = out | F.exists(parts, _matching(pattern))
    return out


def _matching(pattern: str):
    return lambda part: F.rlike(part, F.lit(pattern))


def with_names(files: DataFrame) -> DataFrame:
    """Adds name, ext (lower case, with its dot) and dir of `path`."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns(
        {
            "name": name,
            "ext": F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)),
            "dir": F.regexp_replace(F.regexp_replace(F.col("path"), r"[^/]*$", ""), r"/$", ""),
        }
    )


def select_files(files: DataFrame, include: Sequence[str], exclude: Sequence[str], max_file_size: int, max_files: int | None = None) -> DataFrame:
    """Rows that a scan takes. With a limit the first paths in order are taken, so the choice is repeatable."""
    chosen = files.where(F.col("size_bytes") <= max_file_size).where(any_glob(F.col("path"), include))
    chosen = chosen.where(~any_glob(F.col("path"), exclude)).where(~in_excluded_dir(F.col("path"), exclude))
    return chosen.orderBy("path").limit(max_files) if max_files is not None else chosen


@F.pandas_udf(T.StringType())
def decode_lenient(content: pd.Series) -> pd.Series:
    """UTF-8 without the bytes that are not."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def read_files(spark: SparkSession, root: str, include: Sequence[str], exclude: Sequence[str], max_file_size: int, max_files: int | None = None) -> DataFrame:
    """The files below a directory (or one file) as path, name, ext, dir, size_bytes, content.

    Size reaches the scan as a filter; bytes are decoded only for chosen files. With a limit the paths are chosen first,
    from the listing alone: at most `max_files` of them, which then prune what is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    raw = raw.where(F.col("length") <= max_file_size).withColumn("url", F.col("_metadata.file_path"))
    named = raw.select(F.regexp_replace("path", "^file:(?://)?", "").alias("path"), F.col("length").alias("size_bytes"), "content", "url")
    chosen = select_files(named.drop("content"), include, exclude, max_file_size, max_files)
    if max_files is None:
        kept = select_files(named, include, exclude, max_file_size)
    else:
        kept = named.where(F.col("url").isin([r.url for r in chosen.select("url").collect()]))
    return with_names(kept.drop("url").withColumn("content", decode_lenient("content")))


def from_documents(docs: DataFrame) -> DataFrame:
    """documents as files source/lang/doc_id.txt."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return with_names(docs.select(path.alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("text").alias("content")))


def route(files: DataFrame, max_chunk_lines: int, stack_threshold: float) -> DataFrame:
    """Adds n_lines and route: batch for small Python files, single for the others."""
    n = F.size(lines(F.col("content")))
    small = (F.col("ext") == ".py") & (F.col("n_lines") <= int(max_chunk_lines * stack_threshold))
    return files.withColumn("n_lines", n).withColumn("route", F.when(small, "batch").otherwise("single"))
