"""Dependency manifests: package references, name checks, and packages that no registry list knows."""

from __future__ import annotations

import configparser
import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import explode_lines

REFERENCE = "path string, name string, package string, version string, line int, error string"


def ecosystem(name: Column) -> Column:
    out = None
    for k, v in P.MANIFESTS.items():
        out = F.when(name == k, F.lit(v)) if out is None else out.when(name == k, F.lit(v))
    return out


def manifests(files: DataFrame) -> DataFrame:
    return files.where(F.col("name").isin(list(P.MANIFESTS)))


def requirement_refs(files: DataFrame) -> DataFrame:
    """References of requirements files: built-in expressions over lines."""
    rows = explode_lines(files.where(F.rlike("name", F.lit(r"^requirements(-dev|-prod)?\.txt$"))), ("path", "name"))
    body = F.trim("text")
    hit = rows.where((body != "") & ~F.startswith(body, F.lit("#")) & F.rlike(body, F.lit(P.REQUIREMENT)))
    return hit.select(
        "path", "name", F.regexp_extract(body, P.REQUIREMENT, 1).alias("package"), F.trim(F.regexp_extract(body, P.REQUIREMENT, 2)).alias("version"), "line", F.lit(None).cast("string").alias("error")
    )


def setup_refs(files: DataFrame) -> DataFrame:
    """References in the first install_requires list of setup.py."""
    found = F.regexp_extract_all(F.regexp_extract("content", "(?s)" + P.INSTALL_REQUIRES, 1), F.lit(P.QUOTED), 1)
    rows = files.where(F.col("name") == "setup.py").select("path", "name", F.explode(found).alias("dep")).where(F.rlike("dep", F.lit(P.REQUIREMENT)))
    return rows.select(
        "path", "name", F.regexp_extract("dep", P.REQUIREMENT, 1).alias("package"), F.trim(F.regexp_extract("dep", P.REQUIREMENT, 2)).alias("version"), F.lit(0).alias("line"), F.lit(None).cast("string").alias("error")
    )


def package_json_refs(files: DataFrame) -> DataFrame:
    """References of package.json (four maps) and package-lock.json (versions of dependencies), from JSON columns.

    A file that is no JSON is an error row.
    """
    text_map = "map<string,string>"
    kinds = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    plain = files.where(F.col("name") == "package.json").withColumn("j", F.from_json("content", ", ".join(f"{k} {text_map}" for k in kinds)))
    maps = [F.coalesce(F.map_entries(F.col(f"j.{k}")), F.array().cast("array<struct<key:string,value:string>>")) for k in kinds]
    a = plain.select("path", "name", F.explode(F.concat(*maps)).alias("e")).select("path", "name", F.col("e.key").alias("package"), F.col("e.value").alias("version"))
    lock = files.where(F.col("name") == "package-lock.json").withColumn("j", F.from_json("content", "dependencies map<string,struct<version:string>>"))
    b = lock.select("path", "name", F.explode("j.dependencies").alias("package", "v")).where("v.version IS NOT NULL").select("path", "name", "package", F.col("v.version").alias("version"))
    read = a.unionByName(b).select("*", F.lit(0).alias("line"), F.lit(None).cast("string").alias("error"))
    bad = files.where(F.col("name").isin("package.json", "package-lock.json") & F.try_parse_json("content").isNull())
    null = F.lit(None).cast("string")
    return read.unionByName(bad.select("path", "name", null.alias("package"), null.alias("version"), F.lit(1).alias("line"), F.lit("JSONDecodeError").alias("error")))


def yarn_refs(files: DataFrame) -> DataFrame:
    """References of yarn.lock: the last unindented name above an indented version line, by a window over the lines."""
    rows = explode_lines(files.where(F.col("name") == "yarn.lock"), ("path", "name"))
    head = F.when(F.rlike("text", F.lit(r"^[^\s#].*:\s*$")), F.regexp_extract("text", r"""^["']?(@?[^@"',]+)@""", 1))
    order = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("package", F.last(head, ignorenulls=True).over(order))
    version = F.regexp_extract("text", r"""^\s{2}version\s+["']?([^"'\s]+)""", 1)
    return rows.where((version != "") & (F.col("package") != "")).select("path", "name", "package", version.alias("version"), "line", F.lit(None).cast("string").alias("error"))


def _split(dep: str) -> tuple[str, str] | None:
    m = re.match(P.REQUIREMENT, dep.strip())
    return (m[1], m[2].strip()) if m else None


def _toml_refs(name: str, content: str) -> list[tuple[str, str]]:
    data = tomllib.loads(content)
    if name == "Pipfile":
        return [(k, str(v)) for part in ("packages", "dev-packages") for k, v in data.get(part, {}).items()]
    listed = [x for d in data.get("project", {}).get("dependencies", []) if (x := _split(d))]
    poetry = data.get("tool", {}).get("poetry", {}).get("dependencies", {})
    return listed + [(k, str(v)) for k, v in poetry.items() if k != "python"]


def _lock_refs(content: str) -> list[tuple[str, str]]:
    data = json.loads(content)
    if "_meta" not in data:
        return []
    return [(k, v["version"]) for part in ("develop", "default") for k, v in data.get(part, {}).items() if isinstance(v, dict) and "version" in v]


def _cfg_refs(content: str) -> list[tuple[str, str]]:
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    parser.read_string(content)
    return [x for d in parser.get("options", "install_requires", fallback="").splitlines() if d.strip() and (x := _split(d))]


def structured_refs(files: DataFrame) -> DataFrame:
    """References of TOML, Pipfile.lock and setup.cfg files, which need parsers; an unreadable one is an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, name, content in zip(batch["path"], batch["name"], batch["content"], strict=True):
                try:
                    found = _lock_refs(content) if name == "Pipfile.lock" else _cfg_refs(content) if name == "setup.cfg" else _toml_refs(name, content)
                    rows += [(path, name, p, v, 0, None) for p, v in found]
                except (ValueError, configparser.Error, AttributeError, TypeError) as e:
                    rows.append((path, name, None, None, 1, f"{type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "name", "package", "version", "line", "error"])

    wanted = files.where(F.col("name").isin("pyproject.toml", "Pipfile", "Pipfile.lock", "setup.cfg"))
    return wanted.select("path", "name", "content").mapInPandas(run, REFERENCE)


def package_refs(files: DataFrame) -> DataFrame:
    """All references of all manifests."""
    out = requirement_refs(files)
    for part in (setup_refs, package_json_refs, yarn_refs, structured_refs):
        out = out.unionByName(part(files))
    return out


def _valid() -> Column:
    kind = ecosystem(F.col("name"))
    return F.when(kind == "python", F.rlike("package", F.lit(P.PYTHON_NAME))).otherwise(F.rlike("package", F.lit(P.SCRIPT_NAME)))


def invalid_names(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("package").isNotNull() & ~_valid())


def unknown_packages(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References whose package is not among known (ecosystem, package): names are checked once, by an anti join.

    Names that are none of their ecosystem are left to invalid_names.
    """
    rows = refs.where(F.col("package").isNotNull() & _valid()).withColumn("ecosystem", ecosystem(F.col("name")))
    names = rows.select("ecosystem", "package").distinct().join(known, ["ecosystem", "package"], "left_anti")
    return rows.join(names, ["ecosystem", "package"], "left_semi")
