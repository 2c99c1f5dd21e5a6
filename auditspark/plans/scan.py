"""A whole scan as one lazy plan: files in, findings out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CHECKERS, CLASSICAL, Config, selected_checkers
from ..functions.durable import durable
from ..functions.text import lines, numbered, quoted_key, sized_snippet, snippet
from ..operators import ast_rules, chunking, findings, manifests, model_calls, regex_rules
from ..operators.model_calls import prompt_for
from ..operators.plugins import Checker, run_checkers
from ..schema import confidence
from ..sources.files import read_files, route


def classical_findings(spark: SparkSession, files: DataFrame, checkers: list[str], known_packages: DataFrame | None = None) -> DataFrame:
    """Findings of the rule-based checkers that are enabled."""
    lit, col = F.lit, F.col
    parts, tree = [], None
    if "hardcoded_secrets" in checkers:
        parts.append(findings.as_findings(regex_rules.secret_lines(files), lit("hardcoded_secrets"), F.concat(lit("Hard-coded secret: "), "kind"), col("severity"), lit("security_issue"), col("confidence")))
    if "dangerous_ai_logic" in checkers:
        python = files.where(col("ext") == ".py").where(regex_rules.uses_ai(col("content")))
        parts.append(findings.as_findings(regex_rules.dangerous_ai(python), lit("dangerous_ai_logic"), col("kind"), col("severity"), lit("security_issue"), lit(0.9)))
    if "boilerplate" in checkers:
        names = regex_rules.generic_names(files.where(col("ext") == ".py"))
        parts.append(findings.as_findings(names, lit("boilerplate"), F.concat(lit("Generic name: "), "match"), lit("low"), lit("ai_generated"), lit(0.7)))
    wanted = [c for c in checkers if c in {v[0] for v in ast_rules.CHECKER.values()}]
    if wanted:
        # every file is parsed once, here; what follows reads the hits that were written
        tree = durable(ast_rules.ast_findings(files, audit="contextual_sqli_audit" in checkers))
        mine = tree.where(col("checker").isin(wanted))
        parts.append(findings.as_findings(mine, col("checker"), col("rule"), col("severity"), col("type"), col("confidence"), advice=ast_rules.advice(col("rule"))))
    if "sql_injection" in checkers:
        # files that do not parse are read line by line
        broken = tree.where(col("rule").isin("syntax_error", "parse_failure")).select("path").distinct()
        python = files.where(col("ext") == ".py").where(regex_rules.imports_sql(col("content"))).join(broken, "path", "left_semi")
        parts.append(findings.as_findings(regex_rules.sql_line_findings(python), lit("sql_injection"), lit("SQL built from strings"), col("severity"), lit("security_issue"), col("confidence")))
    if "package_check" in checkers:
        bare = ast_rules.missing_init(files).withColumn("line", lit(1))
        parts.append(findings.as_findings(bare, lit("package_check"), lit("Missing __init__.py"), lit("low"), lit("bad_practice"), lit(0.8)))
    if "dependency_validation" in checkers:
        refs = manifests.package_refs(files)
        bad = manifests.invalid_names(refs)
        parts.append(findings.as_findings(bad, lit("dependency_validation"), F.concat(lit("Invalid package name: "), "package"), lit("medium"), lit("security_issue"), lit(0.9)))
        failed = refs.where("error IS NOT NULL")
        parts.append(findings.as_findings(failed, lit("dependency_validation"), F.concat(lit("Unreadable manifest: "), "error"), lit("medium"), lit("bad_practice"), lit(1.0)))
        if known_packages is None:
            unchecked = refs.where("package IS NOT NULL")
            title = F.concat(lit("Cannot validate package without a table of known ones: "), "package")
            parts.append(findings.as_findings(unchecked, lit("dependency_validation"), title, lit("low"), lit("bad_practice"), lit(1.0)))
        else:
            unknown = manifests.unknown_packages(refs, known_packages)
            parts.append(findings.as_findings(unknown, lit("dependency_validation"), F.concat(lit("Unknown package: "), "package"), lit("critical"), lit("security_issue"), lit(0.95)))
    return findings.union(spark, *parts)


def _prompts(files: DataFrame, checker: str, config: Config) -> DataFrame:
    """(key, prompt, line_map) for the chunks of large files and the stacks of small ones.

    line_map gives the file line of each line of the chunk: answers speak of lines as they were shown.
    """
    c, place = config.chunking, "array<struct<path:string,line:int>>"
    routed = route(files, c.max_chunk_lines, c.stack_threshold)
    single = routed.where("route = 'single'") if c.stack_small_files else routed
    cut = chunking.file_chunks if c.use_ast_boundaries else chunking.line_chunks
    chunks = cut(single, c.max_chunk_lines)
    several = F.count("*").over(Window.partitionBy("path")) > 1
    shown = F.when(several, numbered(lines(F.col("content")), F.col("start_line"))).otherwise(F.col("content"))
    # the numbers shown are the file's own, so the map is the file's lines from the first
    own = F.transform(F.sequence(F.lit(1), F.greatest(F.col("end_line"), F.lit(1))), lambda i: F.struct(F.col("path").alias("path"), i.alias("line")))
    out = chunks.select(prompt_for(checker, F.col("path"), shown).alias("prompt"), own.cast(place).alias("line_map"))
    if c.stack_small_files:
        stacks = chunking.stack_files(routed.where("route = 'batch'"), c.max_chunk_lines, c.stack_threshold)
        body = prompt_for(checker, F.lit(""), numbered(lines(F.col("content"))), stacked=True)
        out = out.unionByName(stacks.select(body.alias("prompt"), F.col("line_map").cast(place).alias("line_map")))
    return out.withColumn("key", F.sha2(F.concat_ws(":", F.lit(checker), F.to_json("line_map"), "prompt"), 256))


def _placed(issues: DataFrame, prompts: DataFrame) -> DataFrame:
    """issues (key, line, file) with the path and line that the chunk's map gives; a named file must be in the chunk."""
    rows = issues.join(prompts.select("key", "line_map"), "key")
    name = lambda x: F.element_at(F.split(x["path"], "/"), -1)
    at = F.get("line_map", F.col("line") - 1)
    fits = F.col("file").isNull() | (F.element_at(F.split(at["path"], "/"), -1) == F.col("file"))
    by_name = F.get(F.filter("line_map", lambda x: (x["line"] > 0) & (name(x) == F.col("file"))), F.lit(0))
    nearest = F.get(F.filter("line_map", lambda x: x["line"] > 0), F.lit(0))
    place = F.when(fits & (at["line"] > 0), at).when(F.col("file").isNotNull(), by_name).otherwise(nearest)
    return rows.withColumn("place", place).where("place IS NOT NULL").withColumn("path", F.col("place.path")).withColumn("line", F.col("place.line")).drop("place", "line_map")


@dataclass(frozen=True)
class Audit:
    """What an audit gives: findings, failed calls (checker, key, error, is_llm_error), checkers (ran or skipped)."""

    findings: DataFrame
    errors: DataFrame
    checkers: DataFrame


_ERRORS = "checker string, key string, error string"


def _with_context(checker: str) -> Column:
    """Code around a finding: as much as its kind of line calls for."""
    kind = {"edge_cases": "code", "comment_quality": "comment"}.get(checker, "around")
    return sized_snippet(kind, 2)(F.col("content"), F.col("line"))


def model_findings(spark: SparkSession, files: DataFrame, checkers: list[str], provider: model_calls.Provider, config: Config, classical: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of the model-backed checkers: one call for each chunk or stack of files that pass the gate.

    Answers are written once, so no call is paid for again. An answer that is no JSON is read as sections of text, or,
    for dangerous_ai_logic, replaced by the line rules. `classical` SQL findings get a second opinion.
    """
    gates = {
        "edge_cases": regex_rules.has_code(F.col("content")), "comment_quality": regex_rules.has_comments(F.col("content")),
        "dangerous_ai_logic": regex_rules.uses_ai(F.col("content")), "vibe_naming": F.lit(True),
    }
    parts, failed = [], []
    for checker in (c for c in checkers if c in gates and provider.available()):
        passing = files.where(F.col("ext") == ".py").where(gates[checker])
        prompts = durable(_prompts(passing, checker, config))
        answers = durable(model_calls.call_model(prompts, provider, config.chunking.max_parallel_requests).withColumn("checker", F.lit(checker)))
        failed.append(answers.where("error IS NOT NULL").select("checker", "key", "error"))
        answers = answers.where("response IS NOT NULL")
        issues = model_calls.issue_findings(model_calls.parse_issues(answers))
        columns = ["key", "checker", "pos", "title", "description", "severity", "finding_type", "line", "confidence", "file", "advice"]
        issues = issues.select(columns)
        unread = answers.where(~model_calls.is_json(F.col("response")))
        if checker in model_calls.P.TEXT_OPENERS:
            text = model_calls.text_sections(unread.select(F.col("key").alias("path"), "response"), checker).select(
                F.col("path").alias("key"), F.lit(checker).alias("checker"), F.col("section").alias("pos"), "title", "description",
                F.lit(model_calls.DEFAULT_SEVERITY[checker]).alias("severity"), F.lit(model_calls.DEFAULT_TYPE[checker]).alias("finding_type"), "line",
                F.lit(0.6).alias("confidence"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("advice"),
            )
            issues = issues.unionByName(text)
        elif checker == "dangerous_ai_logic":
            shown = unread.join(prompts, "key").select(F.explode("line_map.path").alias("path")).distinct()
            rules = regex_rules.dangerous_ai(passing.join(shown, "path", "left_semi"))
            parts.append(findings.as_findings(rules, F.lit(checker), F.col("kind"), F.col("severity"), F.lit("security_issue"), F.lit(0.9)))
        found = _placed(issues, prompts).withColumn("fid", F.concat_ws(":", "key", "pos", "title"))
        moved = regex_rules.nearest_lines(found.select("path", "fid", "line", quoted_key(F.col("title")).alias("key")), files)
        found = found.drop("line").join(moved, ["path", "fid"])
        once = model_calls.first_per_line(found).join(files.select("path", "content"), "path")
        parts.append(
            findings.as_findings(
                once, F.col("checker"), F.col("title"), F.col("severity"), F.col("finding_type"), F.col("confidence"),
                snippet=_with_context(checker), description=F.col("description"), advice=F.col("advice"),
            )
        )
    if classical is not None and "sql_injection" in checkers and provider.available():
        places = classical.where(F.col("checker").isin(*findings.SQL_CHECKERS)).select("path", F.col("line_start").alias("line")).distinct()
        asked = durable(model_calls.second_opinion_prompts(places, files))
        answers = durable(model_calls.call_model(asked, provider, config.chunking.max_parallel_requests))
        failed.append(answers.where("error IS NOT NULL").select(F.lit("sql_injection").alias("checker"), "key", "error"))
        opinions = model_calls.second_opinions(answers.where("response IS NOT NULL")).join(asked.select("key", "path"), "key")
        parts.append(
            findings.as_findings(
                opinions, F.lit("sql_injection"), F.col("title"), F.col("severity"), F.lit("security_issue"), F.col("confidence"), description=F.col("description"), advice=F.col("advice")
            )
        )
    errors = spark.createDataFrame([], _ERRORS)
    for f in failed:
        errors = errors.unionByName(f)
    return findings.union(spark, *parts), errors


def audit(spark: SparkSession, files: DataFrame, config: Config | None = None, provider: model_calls.Provider | None = None, known_packages: DataFrame | None = None, plugins: tuple[Checker, ...] = ()) -> Audit:
    """Findings of files (path, name, ext, dir, content), repeats removed, each with its code around it; and how it went."""
    config = config or Config()
    checkers = selected_checkers(config)
    classical = classical_findings(spark, files, checkers, known_packages)
    rows = classical.unionByName(run_checkers(spark, files, plugins))
    errors, ran = spark.createDataFrame([], _ERRORS), {c for c in checkers if c in CLASSICAL} | {p.name for p in plugins}
    if provider is not None and not config.checkers.classical_only:
        asked, errors = model_findings(spark, files, checkers, provider, config, classical)
        rows = rows.unionByName(asked)
        ran |= set(checkers) if provider.available() else set()
    kept = findings.drop_repeats(rows, confidence=confidence(F.col("evidence")))
    shown = files.select("path", lines(F.col("content")).alias("__l"))
    kept = kept.join(shown, "path").withColumn("snippet", F.coalesce("snippet", snippet(F.col("__l"), F.col("line_start")))).drop("__l")
    names = spark.createDataFrame([(c,) for c in sorted(ran)], "checker string")
    status = findings.checker_status(spark, list(dict.fromkeys([*CHECKERS, *(p.name for p in plugins)])), names)
    return Audit(kept, findings.errors(errors), status)


def scan(spark: SparkSession, root: str, config: Config | None = None, provider: model_calls.Provider | None = None, known_packages: DataFrame | None = None) -> DataFrame:
    """Findings below a directory."""
    return scan_all(spark, root, config, provider, known_packages).findings


def scan_all(spark: SparkSession, root: str, config: Config | None = None, provider: model_calls.Provider | None = None, known_packages: DataFrame | None = None) -> Audit:
    """The whole audit of a directory; its files are read and decoded once."""
    config = config or Config()
    s = config.scan
    return audit(spark, durable(read_files(spark, root, s.include, s.exclude, s.max_file_size, s.max_files)), config, provider, known_packages)
