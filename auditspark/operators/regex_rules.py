"""Line and text rules as column expressions: no Python runs on any row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import contains_any, explode_lines, first_match, lines, matches_any, shortened


def generic_names(files: DataFrame) -> DataFrame:
    """(path, line, match) for every name such as tmp_1."""
    rows = explode_lines(files)
    return rows.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(P.GENERIC_NAME), 0)).alias("match"))


def secret_lines(files: DataFrame) -> DataFrame:
    """(path, line, kind, severity, confidence, match): the first secret rule that holds in a line."""
    rows = explode_lines(files)
    kind = first_match(F.col("text"), [(k, p) for k, _, _, p in P.SECRETS])
    pick = lambda values: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in values])
    found = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    return found.select(
        "path",
        "line",
        "kind",
        pick([(k, s) for k, s, _, _ in P.SECRETS]).alias("severity"),
        pick([(k, c) for k, _, c, _ in P.SECRETS]).alias("confidence"),
        shortened(F.coalesce(*[F.when(F.col("kind") == k, F.regexp_extract("text", p, 0)) for k, _, _, p in P.SECRETS])).alias("match"),
    )


def dangerous_ai(files: DataFrame) -> DataFrame:
    """(path, line, kind, severity): the first dangerous-call rule of each line, without regard to case."""
    kind = first_match(F.col("text"), [(k, p) for k, _, p in P.DANGEROUS_AI], "(?i)")
    found = explode_lines(files).withColumn("kind", kind).where("kind IS NOT NULL")
    critical = [k for k, s, _ in P.DANGEROUS_AI if s == "critical"]
    return found.select("path", "line", "kind", F.when(F.col("kind").isin(critical), "critical").otherwise("high").alias("severity"))


def uses_ai(content: Column) -> Column:
    return contains_any(F.lower(content), P.AI_FRAMEWORKS + P.AI_CALLS)


def has_code(content: Column) -> Column:
    """Fewer than five lines: no; more than a thousand: yes; else three lines with a mark of code."""
    rows = lines(content)
    marked = F.size(F.filter(rows, lambda x: contains_any(x, P.CODE_MARKS)))
    return F.when(F.size(rows) < 5, False).when(F.size(rows) > 1000, True).otherwise(marked >= 3)


def has_comments(content: Column) -> Column:
    return contains_any(content, P.COMMENT_MARKS)


def imports_sql(content: Column) -> Column:
    """Some import line names a database driver."""
    begins = lambda x: F.startswith(F.trim(x), F.lit("import ")) | F.startswith(F.trim(x), F.lit("from "))
    return F.exists(lines(content), lambda x: begins(x) & contains_any(x, P.SQL_DRIVERS))


def user_name(name: Column) -> Column:
    return contains_any(F.lower(name), P.USER_NAMES)


def user_value(value: Column) -> Column:
    return contains_any(F.lower(value), P.USER_VALUES)


def parameter_clause(text: Column) -> Column:
    return contains_any(F.lower(text), P.PARAMETER_CLAUSES)


def dangerous_literal(text: Column) -> Column:
    """A statement with interpolation left once well-formed placeholders are taken out."""
    rest = F.regexp_replace(F.regexp_replace(text, P.NAMED_PLACEHOLDERS, ""), P.PLAIN_PLACEHOLDERS, "")
    marks = F.contains(rest, F.lit("%")) | (F.contains(text, F.lit("{")) & F.contains(text, F.lit("}"))) | F.contains(text, F.lit("+"))
    return contains_any(F.lower(text), P.DML_WORDS) & marks


def contextual_pattern(text: Column) -> Column:
    """Number (from 1) of the first contextual pattern found, or null."""
    return first_match(text, [(str(i), p) for i, p in enumerate(P.CONTEXTUAL, 1)], "(?is)").cast("int")


def clause_label(text: Column) -> Column:
    low = F.lower(text)
    inter = F.contains(text, F.lit("{")) | F.contains(text, F.lit("+"))
    out = None
    for word, label in P.CLAUSES:
        hit = F.contains(low, F.lit(word)) & inter
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    braces = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    return out.when(braces >= 2, F.lit("multiple")).otherwise(F.lit("other"))


def has_sql_word(text: Column) -> Column:
    return contains_any(F.upper(text), P.SQL_WORDS)


def hard_predicate(text: Column) -> Column:
    return matches_any(text, P.HARD_PREDICATES, "(?i)")


def llm_error(message: Column) -> Column:
    return contains_any(F.lower(message), P.LLM_ERROR_WORDS)


def sql_context(files: DataFrame, before: int = 9, after: int = 5) -> DataFrame:
    """(path, line, text, users): SQL lines that interpolate, with the user-like names assigned around them.

    The names come from a window frame over a file's lines; nothing is joined. Only files that have such a line are
    put in order at all.
    """
    sql = contains_any(F.lower("text"), P.DML_WORDS) & matches_any(F.col("text"), P.INTERPOLATIONS)
    has_sql = F.exists(lines(F.col("content")), lambda x: contains_any(F.lower(x), P.DML_WORDS) & matches_any(x, P.INTERPOLATIONS))
    rows = explode_lines(files.where(has_sql)).withColumn("sql", sql)
    body = F.trim("text")
    name, value = F.regexp_extract(body, P.ASSIGNMENT, 1), F.trim(F.regexp_extract(body, P.ASSIGNMENT, 2))
    assigned = F.rlike(body, F.lit(P.ASSIGNMENT)) & (user_name(name) | user_value(value))
    rows = rows.withColumn("user", F.when(assigned, name))
    order = Window.partitionBy("path").orderBy("line")
    above, below = order.rowsBetween(-before, -1), order.rowsBetween(1, after)
    users = F.array_sort(F.array_union(F.collect_set("user").over(above), F.collect_set("user").over(below)))
    return rows.withColumn("users", users).where("sql").select("path", "line", "text", "users")


def sql_line_findings(files: DataFrame) -> DataFrame:
    """(path, line, severity, confidence, users) by what surrounds an interpolating SQL line."""
    rows = sql_context(files).withColumn("some", F.size("users") > 0).withColumn("clause", parameter_clause(F.col("text")))
    severity = F.when(F.col("some") & F.col("clause"), "high").otherwise("medium")
    sure = F.when(F.col("some") & F.col("clause"), F.lit(0.85)).when(F.col("some"), F.lit(0.7)).otherwise(F.lit(0.6))
    return rows.select("path", "line", severity.alias("severity"), sure.alias("confidence"), "users")


def nearest_lines(findings: DataFrame, files: DataFrame, reach: int = 3) -> DataFrame:
    """findings (path, fid, line, key) with `line` moved to the nearest line within reach that contains the key.

    Of two equally near lines the earlier is taken; where there is none, the line is put within the file. A distance
    join on (path, line): each finding looks at 2 * reach + 1 places, so the join stays an equi-join.
    """
    text = explode_lines(files)
    sizes = files.select("path", F.size(lines(F.col("content"))).alias("n"))
    probes = findings.withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("probe", F.col("line") + F.col("d"))
    hits = probes.join(text.withColumnRenamed("line", "probe"), ["path", "probe"]).where((F.length("key") > 0) & F.contains(F.col("text"), F.col("key")))
    best = hits.groupBy("path", "fid").agg(F.min(F.struct(F.abs("d").alias("far"), F.col("probe"))).alias("b")).select("path", "fid", F.col("b.probe").alias("found"))
    out = findings.join(best, ["path", "fid"], "left").join(sizes, "path", "left")
    clamped = F.greatest(F.lit(1), F.least("line", F.coalesce("n", F.lit(1))))
    return out.select("path", "fid", F.coalesce("found", clamped).cast("int").alias("line"))
