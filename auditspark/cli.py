"""Command line: scan a directory, write a configuration, show the version."""

from __future__ import annotations

import argparse
import dataclasses
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as C
from .operators import model_calls, report
from .plans.scan import scan_all

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="auditspark")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="audit the files below a path")
    s.add_argument("path")
    s.add_argument("--config")
    s.add_argument("--format", choices=("plain", "json"))
    s.add_argument("--include", action="append")
    s.add_argument("--exclude", action="append")
    s.add_argument("--classical-only", action="store_true")
    s.add_argument("--llm-only", action="store_true")
    s.add_argument("--verbose", action="store_true", help="say which checkers ran")
    s.add_argument("--debug", action="store_true", help="say which calls failed, and why")
    i = sub.add_parser("init", help="write a configuration file")
    i.add_argument("--output", default=C.FILE_NAME)
    i.add_argument("--global", dest="everywhere", action="store_true", help="write the user's own configuration")
    sub.add_parser("version")
    return p


def messages(done, verbose: bool, debug: bool) -> list[str]:
    """What the reader should know beside the findings: failed calls above all."""
    counts = done.errors.groupBy("checker", "is_llm_error").agg(F.count("*").alias("n"), F.min("error").alias("error")).orderBy("checker").collect()
    out = []
    if any(r.is_llm_error for r in counts):
        out.append("The model could not be reached: check the API key, the model's name and the network.")
    out += [f"{r.checker}: {r.n} calls failed" + (f" ({r.error})" if debug else "") for r in counts]
    if verbose:
        out += [f"{r.checker}: {r.status}" for r in done.checkers.orderBy("checker").collect()]
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    args, out = parser().parse_args(argv), out or sys.stdout
    if args.command == "version":
        print(VERSION, file=out)
        return 0
    if args.command == "init":
        target = C.global_path(dict(os.environ)) if args.everywhere else Path(args.output)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(C.to_toml(C.Config()), encoding="utf-8")
        return 0
    config = C.load(args.path, args.config)
    over = {"include": tuple(args.include or config.scan.include), "exclude": tuple(args.exclude or config.scan.exclude)}
    checkers = dataclasses.replace(config.checkers, classical_only=args.classical_only or config.checkers.classical_only, llm_only=args.llm_only or config.checkers.llm_only)
    config = dataclasses.replace(config, scan=dataclasses.replace(config.scan, **over), checkers=checkers)
    spark = spark or SparkSession.builder.appName("auditspark").getOrCreate()
    provider = None
    if model_calls.usable_key(config.llm.api_key):
        provider = model_calls.make_provider(config.llm.provider, config.llm.model, config.llm.api_key, config.llm.base_url, temperature=config.llm.temperature, max_tokens=config.llm.max_tokens, timeout=config.llm.timeout)
    done = scan_all(spark, args.path, config, provider)
    for message in messages(done, args.verbose or config.output.verbose, args.debug or config.output.debug):
        print(message, file=sys.stderr)
    rows = report.with_category(spark, done.findings)
    rows = report.ranked(rows, False, report.confidence(F.col("evidence"))).orderBy("rank")
    as_json = (args.format or config.output.format) == "json"
    rows = report.to_json(rows).select("json") if as_json else report.plain_line(rows).select("rendered")
    lines = [r[0] for r in rows.collect()]
    if as_json:
        print('{"has_issues": %s, "findings": [%s]}' % ("true" if lines else "false", ", ".join(lines)), file=out)
    else:
        for line in lines:
            print(line, file=out)
    return int(bool(lines))


if __name__ == "__main__":
    sys.exit(main())
