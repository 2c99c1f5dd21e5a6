"""The engine's own queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHECKERS
from ..functions import patterns as P
from ..functions import text as X
from ..operators import ast_rules, chunking, manifests, model_calls, regex_rules, report
from ..operators import findings as found
from ..sources import files as S
from . import corpus

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(w)})" for w in words) + ")"


def _match(column: str, patterns, flags: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_q(flags + p)})" for p in patterns) + ")"


def _first(column: str, rules, flags: str = "") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {_q(flags + p)}) THEN {_q(k)}" for k, p in rules) + " END"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


DOC_PATH = "source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt'"
#: Lines of documents: one final line feed ends the last line. (The tables hold no other terminators.)
DOC_LINES = f"""d AS (SELECT {DOC_PATH} AS path, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS l FROM documents WHERE text <> ''),
dl AS (SELECT path, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line, unnest(l) AS text FROM d)"""
CODE = f"WITH {corpus.CTE}"


# -- sources --------------------------------------------------------------------------------------------------------


@query("line_explode", f"WITH {DOC_LINES} SELECT path, line, CAST(length(text) AS INTEGER) AS chars FROM dl")
def line_explode(spark, d):
    return X.explode_lines(_docs(spark, d)).select("path", "line", F.length("text").alias("chars"))


INCLUDE, EXCLUDE = ("*.py", "*9.txt", "src1*"), ("*/de/*", "src2/", "f?/")


@query(
    "glob_select",
    f"""WITH p AS (SELECT {DOC_PATH} AS path, source, lang FROM documents)
SELECT path FROM p WHERE (path LIKE '%.py' OR path LIKE '%9.txt' OR path LIKE 'src1%') AND NOT path LIKE '%/de/%' AND source <> 'src2' AND NOT (source LIKE 'f_' OR lang LIKE 'f_')""",
)
def glob_select(spark, d):
    return S.select_files(_docs(spark, d), INCLUDE, EXCLUDE, 1 << 30).select("path")


@query(
    "size_limit_topn",
    f"SELECT {DOC_PATH} AS path, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents WHERE strlen(text) <= 2000 ORDER BY path LIMIT 50",
)
def size_limit_topn(spark, d):
    return S.select_files(_docs(spark, d), ("*",), (), 2000, 50).select("path", "size_bytes")


@query("route_small_files", f"{CODE} SELECT path, CAST(count(*) AS INTEGER) AS n_lines, CASE WHEN count(*) <= 5 THEN 'batch' ELSE 'single' END AS route FROM corpus GROUP BY path")
def route_small_files(spark, d):
    return S.route(corpus.code_files(spark, d), 10, 0.5).select("path", "n_lines", "route")


# -- text -----------------------------------------------------------------------------------------------------------


@query("numbered_text", f"{CODE} SELECT path, string_agg(lpad(CAST(line AS VARCHAR), 4, ' ') || '| ' || text, chr(10) ORDER BY line) AS shown FROM corpus GROUP BY path")
def numbered_text(spark, d):
    return corpus.code_files(spark, d).select("path", X.numbered(X.lines(F.col("content"))).alias("shown"))


@query(
    "snippet",
    f"""{CODE} SELECT a.path, a.line, string_agg(CASE WHEN b.line = a.line THEN '>' ELSE ' ' END || ' ' || lpad(CAST(b.line AS VARCHAR), 3, ' ') || '| ' || b.text, chr(10) ORDER BY b.line) AS shown
FROM corpus a JOIN corpus b ON a.path = b.path AND b.line BETWEEN a.line - 1 AND a.line + 1 WHERE contains(a.text, 'pickle') GROUP BY a.path, a.line""",
)
def snippet(spark, d):
    files = corpus.code_files(spark, d)
    hits = regex_rules.dangerous_ai(files).where("kind = 'unsafe_pickle_load'").select("path", "line")
    rows = hits.join(files.select("path", X.lines(F.col("content")).alias("l")), "path")
    return rows.select("path", "line", X.snippet(F.col("l"), F.col("line")).alias("shown"))


@query("shortened_text", f"SELECT {DOC_PATH} AS path, CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END AS shown FROM documents")
def shortened_text(spark, d):
    return _docs(spark, d).select("path", X.shortened(F.col("content")).alias("shown"))


@query(
    "nearest_line",
    f"""WITH {corpus.CTE}, fi AS (SELECT ok AS fid, path, CAST(line + ok % 5 - 2 AS INTEGER) AS line, 'cursor' AS key FROM corpus),
n AS (SELECT path, max(line) AS n FROM corpus GROUP BY path),
h AS (SELECT fi.fid, c.line AS probe, row_number() OVER (PARTITION BY fi.fid ORDER BY abs(c.line - fi.line), c.line) AS rn FROM fi JOIN corpus c ON c.path = fi.path AND abs(c.line - fi.line) <= 3 AND contains(c.text, fi.key))
SELECT fi.path, fi.fid, CAST(coalesce(h.probe, greatest(1, least(fi.line, n.n))) AS INTEGER) AS line FROM fi JOIN n USING (path) LEFT JOIN h ON h.fid = fi.fid AND h.rn = 1""",
)
def nearest_line(spark, d):
    files = corpus.code_files(spark, d)
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.expr(corpus.PATH).alias("path"), F.col("o_orderkey").alias("fid"))
    ranks = X.explode_lines(files)
    # the place of an order in its file, from the file's own sorted keys
    keyed = orders.groupBy("path").agg(F.array_sort(F.collect_list("fid")).alias("k")).select("path", F.posexplode("k").alias("pos", "fid"))
    reported = keyed.join(ranks.select("path", F.col("line")), (keyed["path"] == ranks["path"]) & (F.col("line") == F.col("pos") + 1)).select(keyed["path"], "fid", "line")
    asked = reported.select("path", "fid", (F.col("line") + F.col("fid") % 5 - 2).cast("int").alias("line"), F.lit("cursor").alias("key"))
    return regex_rules.nearest_lines(asked, files)


@query("quoted_titles", "SELECT doc_id, regexp_extract('Name ''' || source || ''' in ''' || lang || '''', '(?s)''(.*)''', 1) AS key FROM documents")
def quoted_titles(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", X.quoted_key(F.concat(F.lit("Name '"), "source", F.lit("' in '"), "lang", F.lit("'"))).alias("key"))


@query("display_paths", f"SELECT CASE WHEN p LIKE 'src1/%' THEN substr(p, 6) ELSE p END AS shown FROM (SELECT {DOC_PATH} AS p FROM documents)")
def display_paths(spark, d):
    return _docs(spark, d).select(X.display_path(F.col("path"), "src1").alias("shown"))


@query("percent_format", f"WITH {corpus.FINDING_CTE} SELECT fid, CASE WHEN confidence = 0 THEN '' ELSE printf('%.1f%%', confidence * 100) END AS shown FROM f")
def percent_format(spark, d):
    return corpus.findings(spark, d).select("fid", X.percent(F.col("confidence")).alias("shown"))


# -- line rules -----------------------------------------------------------------------------------------------------

_SECRET_RULES = [(k, p) for k, _, _, p in P.SECRETS]


@query(
    "secret_lines",
    f"""WITH {DOC_LINES}, {corpus.CTE}, al AS (SELECT path, line, text FROM dl UNION ALL SELECT path, line, text FROM corpus),
k AS (SELECT path, line, {_first('text', _SECRET_RULES)} AS kind FROM al)
SELECT path, line, kind, CASE kind {' '.join(f"WHEN '{k}' THEN '{s}'" for k, s, _, _ in P.SECRETS)} END AS severity, CAST(CASE kind {' '.join(f"WHEN '{k}' THEN {c}" for k, _, c, _ in P.SECRETS)} END AS DOUBLE) AS confidence FROM k WHERE kind IS NOT NULL""",
)
def secret_lines(spark, d):
    both = _docs(spark, d).select("path", "content").unionByName(corpus.code_files(spark, d).select("path", "content"))
    return regex_rules.secret_lines(both).drop("match")


@query("generic_names", f"{CODE} SELECT path, line, unnest(regexp_extract_all(text, {_q(P.GENERIC_NAME)})) AS match FROM corpus")
def generic_names(spark, d):
    return regex_rules.generic_names(corpus.code_files(spark, d))


@query(
    "danger_patterns",
    f"""{CODE}, k AS (SELECT path, line, {_first('text', [(k, p) for k, _, p in P.DANGEROUS_AI], '(?i)')} AS kind FROM corpus)
SELECT path, line, kind, CASE WHEN kind IN ('unsafe_torch_load', 'unsafe_pickle_load') THEN 'high' ELSE 'critical' END AS severity FROM k WHERE kind IS NOT NULL""",
)
def danger_patterns(spark, d):
    return regex_rules.dangerous_ai(corpus.code_files(spark, d))


_CONTENT = "c AS (SELECT path, string_agg(text, chr(10) ORDER BY line) AS content FROM corpus GROUP BY path)"


@query("framework_gate", f"{CODE}, {_CONTENT} SELECT path, {_any('lower(content)', P.AI_FRAMEWORKS + P.AI_CALLS)} AS uses_ai, {_any('content', P.COMMENT_MARKS)} AS comments FROM c")
def framework_gate(spark, d):
    c = F.col("content")
    return corpus.code_files(spark, d).select("path", regex_rules.uses_ai(c).alias("uses_ai"), regex_rules.has_comments(c).alias("comments"))


@query("code_gate", f"{CODE} SELECT path, CASE WHEN count(*) < 5 THEN false WHEN count(*) > 1000 THEN true ELSE count(*) FILTER (WHERE {_any('text', P.CODE_MARKS)}) >= 3 END AS has_code FROM corpus GROUP BY path")
def code_gate(spark, d):
    return corpus.code_files(spark, d).select("path", regex_rules.has_code(F.col("content")).alias("has_code"))


@query("sql_import_gate", f"{CODE} SELECT path, bool_or((text LIKE 'import %' OR text LIKE 'from %') AND {_any('text', P.SQL_DRIVERS)}) AS imports_sql FROM corpus GROUP BY path")
def sql_import_gate(spark, d):
    return corpus.code_files(spark, d).select("path", regex_rules.imports_sql(F.col("content")).alias("imports_sql"))


_SQL_LINE = f"({_any('lower(text)', P.DML_WORDS)} AND {_match('text', P.INTERPOLATIONS)})"
_NAME, _VALUE = f"regexp_extract(text, {_q(P.ASSIGNMENT)}, 1)", f"trim(regexp_extract(text, {_q(P.ASSIGNMENT)}, 2))"
_USERS = f"""u AS (SELECT path, line, {_NAME} AS name FROM corpus WHERE regexp_matches(text, {_q(P.ASSIGNMENT)}) AND ({_any(f'lower({_NAME})', P.USER_NAMES)} OR {_any(f'lower({_VALUE})', P.USER_VALUES)})),
s AS (SELECT path, line, text FROM corpus WHERE {_SQL_LINE}),
j AS (SELECT s.path, s.line, s.text, array_to_string(list_sort(list_distinct(list(u.name) FILTER (WHERE u.name IS NOT NULL))), ',') AS users FROM s LEFT JOIN u ON u.path = s.path AND u.line BETWEEN s.line - 9 AND s.line + 5 AND u.line <> s.line GROUP BY s.path, s.line, s.text)"""


@query("sql_context_window", f"{CODE}, {_USERS} SELECT path, line, coalesce(users, '') AS users FROM j")
def sql_context_window(spark, d):
    return regex_rules.sql_context(corpus.code_files(spark, d)).select("path", "line", F.array_join("users", ",").alias("users"))


@query(
    "sql_line_rules",
    f"""{CODE}, {_USERS}, k AS (SELECT path, line, coalesce(users, '') <> '' AS has_users, {_any('lower(text)', P.PARAMETER_CLAUSES)} AS cl FROM j)
SELECT path, line, CASE WHEN has_users AND cl THEN 'high' ELSE 'medium' END AS severity, CAST(CASE WHEN has_users AND cl THEN 0.85 WHEN has_users THEN 0.7 ELSE 0.6 END AS DOUBLE) AS confidence FROM k""",
)
def sql_line_rules(spark, d):
    return regex_rules.sql_line_findings(corpus.code_files(spark, d)).drop("users")


@query(
    "user_input_names",
    f"{CODE} SELECT path, line, {_any(f'lower({_NAME})', P.USER_NAMES)} AS by_name, {_any(f'lower({_VALUE})', P.USER_VALUES)} AS by_value, {_any('lower(text)', P.PARAMETER_CLAUSES)} AS clause FROM corpus",
)
def user_input_names(spark, d):
    name, value = F.regexp_extract("text", P.ASSIGNMENT, 1), F.trim(F.regexp_extract("text", P.ASSIGNMENT, 2))
    rows = X.explode_lines(corpus.code_files(spark, d))
    return rows.select("path", "line", regex_rules.user_name(name).alias("by_name"), regex_rules.user_value(value).alias("by_value"), regex_rules.parameter_clause(F.col("text")).alias("clause"))


_REST = f"regexp_replace(regexp_replace(text, {_q(P.NAMED_PLACEHOLDERS)}, '', 'g'), {_q(P.PLAIN_PLACEHOLDERS)}, '', 'g')"


@query(
    "dangerous_literal",
    f"""{CODE} SELECT path, line, {_any('lower(text)', P.DML_WORDS)} AND (contains({_REST}, '%') OR (contains(text, '{{') AND contains(text, '}}')) OR contains(text, '+')) AS dangerous FROM corpus""",
)
def dangerous_literal(spark, d):
    return X.explode_lines(corpus.code_files(spark, d)).select("path", "line", regex_rules.dangerous_literal(F.col("text")).alias("dangerous"))


@query(
    "contextual_patterns",
    f"""{CODE}, k AS (SELECT path, line, text, CAST({_first('text', [(str(i), p) for i, p in enumerate(P.CONTEXTUAL, 1)], '(?is)')} AS INTEGER) AS pattern, contains(text, '{{') OR contains(text, '+') AS inter, lower(text) AS low FROM corpus)
SELECT path, line, pattern, CASE WHEN contains(low, 'where') AND inter THEN 'where' WHEN contains(low, 'like') AND inter THEN 'like' WHEN contains(low, 'in') AND inter THEN 'in' WHEN contains(low, 'order by') AND inter THEN 'order by'
WHEN contains(low, 'values') AND inter THEN 'values' WHEN length(text) - length(replace(text, '{{', '')) >= 2 THEN 'multiple' ELSE 'other' END AS clause FROM k WHERE pattern IS NOT NULL""",
)
def contextual_patterns(spark, d):
    rows = X.explode_lines(corpus.code_files(spark, d)).withColumn("pattern", regex_rules.contextual_pattern(F.col("text"))).where("pattern IS NOT NULL")
    return rows.select("path", "line", "pattern", regex_rules.clause_label(F.col("text")).alias("clause"))


@query(
    "placeholder_vars",
    rf"""{CODE} SELECT path, line, coalesce(array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '\{{(\w+)\}}', 1), regexp_extract_all(text, '%\((\w+)\)', 1)))), ','), '') AS names FROM corpus""",
)
def placeholder_vars(spark, d):
    return X.explode_lines(corpus.code_files(spark, d)).select("path", "line", F.array_join(X.placeholder_names(F.col("text")), ",").alias("names"))


@query("hardcoded_predicate", f"{CODE} SELECT path, line, {_any('upper(text)', P.SQL_WORDS)} AS sql_word, {_match('text', P.HARD_PREDICATES, '(?i)')} AS hard FROM corpus")
def hardcoded_predicate(spark, d):
    t = F.col("text")
    return X.explode_lines(corpus.code_files(spark, d)).select("path", "line", regex_rules.has_sql_word(t).alias("sql_word"), regex_rules.hard_predicate(t).alias("hard"))


# -- syntax trees ---------------------------------------------------------------------------------------------------

# Every line of the corpus is a statement of its own, so a file's hits follow from its lines' kinds. Rules on SQL need
# the import of a driver somewhere in the file.
_AST_SQL = """WITH {cte}, i AS (SELECT path, bool_or(ok % 17 = 9) AS drv FROM corpus GROUP BY path), t(k, need, rule, severity, confidence) AS (VALUES
(0, true, 'sql_fstring', 'critical', 0.95), (0, true, 'cursor_interpolation', 'critical', 0.9), (2, true, 'cursor_interpolation', 'critical', 0.9),
(6, false, 'print_call', 'low', 0.7), (12, false, 'needless_lambda', 'low', 0.6), (13, true, 'cursor_hard_predicate', 'medium', 0.7),
(15, false, 'star_import', 'medium', 1.0))
SELECT c.path, c.line, t.rule, t.severity, CAST(t.confidence AS DOUBLE) AS confidence FROM corpus c JOIN i USING (path) JOIN t ON t.k = c.ok % 17 AND (i.drv OR NOT t.need) WHERE {which}"""


@query("ast_sql", _AST_SQL.format(cte=corpus.CTE, which="t.need"))
def ast_sql(spark, d):
    rows = ast_rules.ast_findings(corpus.code_files(spark, d))
    return rows.where("type = 'security_issue'").select("path", "line", "rule", "severity", "confidence")


@query("ast_lint", _AST_SQL.format(cte=corpus.CTE, which="NOT t.need"))
def ast_lint(spark, d):
    rows = ast_rules.ast_findings(corpus.code_files(spark, d))
    return rows.where("type <> 'security_issue'").select("path", "line", "rule", "severity", "confidence")


# A line of the second corpus for each part, by its key; one file for each fortieth of the parts.
_RULE_LINES = """CASE p_partkey % 9 WHEN 0 THEN 'import sqlite3' WHEN 1 THEN 'from ...pkg import a' WHEN 2 THEN 'cursor.execute("SELECT a FROM t WHERE b = {x}")'
WHEN 3 THEN 'conn.execute("SELECT a FROM t WHERE b = " + total)' WHEN 4 THEN 'c.execute("SELECT a FROM t".format())' WHEN 5 THEN 'c.execute(f"SELECT a FROM t WHERE b = {q1}", (1,))'
WHEN 6 THEN 'c.execute("DELETE FROM t WHERE a LIKE {p}")' WHEN 7 THEN 'c.execute("SELECT a FROM t WHERE b = ?")' ELSE 'import a.b as c' END"""


@query(
    "ast_rules",
    """WITH l AS (SELECT 'g' || CAST(p_partkey % 40 AS VARCHAR) || '.py' AS path, p_partkey AS k, CAST(row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS INTEGER) AS line FROM part),
i AS (SELECT path, bool_or(k % 9 = 0) AS drv FROM l GROUP BY path), t(kind, need, rule, severity, confidence) AS (VALUES (1, false, 'deep_relative_import', 'low', 0.9), (2, true, 'sql_literal', 'medium', 0.7),
(3, true, 'sql_concat', 'high', 0.9), (3, true, 'cursor_interpolation', 'critical', 0.9), (4, true, 'sql_format', 'high', 0.8), (4, true, 'cursor_interpolation', 'critical', 0.9),
(5, true, 'sql_fstring', 'medium', 0.8), (5, true, 'sql_mixed', 'high', 0.9), (5, true, 'cursor_interpolation', 'critical', 0.9), (6, true, 'sql_literal', 'medium', 0.7), (6, true, 'sql_contextual', 'high', 0.9),
(7, true, 'cursor_missing_params', 'high', 0.85))
SELECT l.path, l.line, t.rule, t.severity, CAST(t.confidence AS DOUBLE) AS confidence FROM l JOIN i USING (path) JOIN t ON t.kind = l.k % 9 AND (i.drv OR NOT t.need)""",
)
def ast_rule_lines(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.expr("'g' || CAST(p_partkey % 40 AS STRING) || '.py'").alias("path"), "p_partkey", F.expr(_RULE_LINES).alias("t"))
    whole = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "t"))), lambda x: x["t"]), "\n").alias("content"))
    return ast_rules.ast_findings(S.with_names(whole)).select("path", "line", "rule", "severity", "confidence")


def _supplier_files(spark, d, content):
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.expr("'s' || CAST(s_suppkey AS STRING) || '.py'").alias("path"), F.expr(content).alias("content"))
    return S.with_names(rows)


@query("syntax_errors", "SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.py' AS path, CAST(2 AS INTEGER) AS line, 'syntax_error' AS rule, 'high' AS severity FROM supplier")
def syntax_errors(spark, d):
    files = _supplier_files(spark, d, "'x = ' || CAST(s_suppkey AS STRING) || '\\ndef f(:\\n    pass'")
    return ast_rules.ast_findings(files).select("path", "line", "rule", "severity")


@query(
    "text_rules",
    "SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.py' AS path, CAST(line AS INTEGER) AS line, rule FROM supplier, (VALUES (2, 'empty_class'), (5, 'lambda_text'), (6, 'needless_lambda')) AS r(line, rule)",
)
def text_rules(spark, d):
    files = _supplier_files(spark, d, "'a = 1\\nclass C' || CAST(s_suppkey AS STRING) || ':\\n    def __init__(self):\\n        pass\\nf = lambda x: x\\ng = lambda x: x.y'")
    return ast_rules.ast_findings(files).select("path", "line", "rule")


@query("missing_init", f"{CODE}, p AS (SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM corpus) SELECT path FROM p WHERE dir IN (SELECT dir FROM p GROUP BY dir HAVING count(*) > 1)")
def missing_init(spark, d):
    return ast_rules.missing_init(corpus.code_files(spark, d))


# -- manifests ------------------------------------------------------------------------------------------------------

_REFS = f"""WITH {corpus.REQUIREMENT_CTE}, r AS (SELECT path, line, regexp_extract(trim(text), {_q(P.REQUIREMENT)}, 1) AS package, trim(regexp_extract(trim(text), {_q(P.REQUIREMENT)}, 2)) AS version FROM reqs
WHERE trim(text) <> '' AND trim(text) NOT LIKE '#%' AND regexp_matches(trim(text), {_q(P.REQUIREMENT)}))"""


@query("package_refs", f"{_REFS} SELECT path, line, package, version FROM r")
def package_refs(spark, d):
    return manifests.package_refs(corpus.requirement_files(spark, d)).select("path", "line", "package", "version")


# Manifests of other kinds: a file for each fifth of the suppliers, a reference for each of them.
_NAMED = "(SELECT s_suppkey AS k, 'd' || CAST(s_suppkey % 5 AS VARCHAR) AS dir, 'pkg' || CAST(s_suppkey AS VARCHAR) AS package FROM supplier)"


def _manifest(spark, d, name, head, line, foot, between="\n"):
    """`line` is an expression over k and package."""
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"), F.expr("'d' || CAST(s_suppkey % 5 AS STRING)").alias("dir"), F.expr("'pkg' || CAST(s_suppkey AS STRING)").alias("package"))
    whole = rows.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("k", F.expr(line).alias("t")))).alias("l"))
    content = F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["t"]), between), F.lit(foot))
    return S.with_names(whole.select(F.concat("dir", F.lit("/" + name)).alias("path"), content.alias("content")).withColumn("size_bytes", F.octet_length("content").cast("long")))


@query("setup_refs", f"SELECT dir || '/setup.py' AS path, package, '>=' || CAST(k AS VARCHAR) AS version FROM {_NAMED} AS n")
def setup_refs(spark, d):
    files = _manifest(spark, d, "setup.py", "from setuptools import setup\nsetup(name='x', install_requires=[\n", "'    \\'' || package || '>=' || CAST(k AS STRING) || '\\','", "\n])\n")
    return manifests.package_refs(files).select("path", "package", "version")


@query("package_json_refs", f"SELECT dir || '/package.json' AS path, package, '^' || CAST(k AS VARCHAR) AS version FROM {_NAMED} AS n")
def package_json_refs(spark, d):
    files = _manifest(spark, d, "package.json", '{"name": "x", "dependencies": {"left": "1"}, "devDependencies": {', """'"' || package || '": "^' || CAST(k AS STRING) || '"'""", "}}", ", ")
    return manifests.package_refs(files).where("package <> 'left'").select("path", "package", "version")


@query("package_lock_refs", f"SELECT dir || '/package-lock.json' AS path, package, CAST(k AS VARCHAR) || '.0' AS version FROM {_NAMED} AS n")
def package_lock_refs(spark, d):
    files = _manifest(spark, d, "package-lock.json", '{"dependencies": {', """'"' || package || '": {"version": "' || CAST(k AS STRING) || '.0", "dev": true}'""", "}}", ", ")
    return manifests.package_refs(files).select("path", "package", "version")


@query("yarn_refs", f"SELECT dir || '/yarn.lock' AS path, package, CAST(k AS VARCHAR) || '.1' AS version, CAST(4 * row_number() OVER (PARTITION BY dir ORDER BY k) - 1 AS INTEGER) AS line FROM {_NAMED} AS n")
def yarn_refs(spark, d):
    files = _manifest(spark, d, "yarn.lock", "# yarn lockfile v1\n", """package || '@^' || CAST(k AS STRING) || ':\\n  version "' || CAST(k AS STRING) || '.1"\\n  resolved "x"\\n'""", "\n")
    return manifests.package_refs(files).select("path", "package", "version", "line")


@query("pyproject_refs", f"SELECT dir || '/pyproject.toml' AS path, package, '==' || CAST(k AS VARCHAR) AS version FROM {_NAMED} AS n")
def pyproject_refs(spark, d):
    files = _manifest(spark, d, "pyproject.toml", "[project]\ndependencies = [\n", """'  "' || package || '==' || CAST(k AS STRING) || '",'""", "\n]\n")
    return manifests.package_refs(files).select("path", "package", "version")


@query("setup_cfg_refs", f"SELECT dir || '/setup.cfg' AS path, package, '~=' || CAST(k AS VARCHAR) AS version FROM {_NAMED} AS n")
def setup_cfg_refs(spark, d):
    files = _manifest(spark, d, "setup.cfg", "[options]\ninstall_requires =\n", "'    ' || package || '~=' || CAST(k AS STRING)", "\n")
    return manifests.package_refs(files).select("path", "package", "version")


@query("pipfile_refs", f"SELECT dir || '/Pipfile' AS path, package, '>' || CAST(k AS VARCHAR) AS version FROM {_NAMED} AS n UNION ALL SELECT dir || '/Pipfile.lock', package, '==' || CAST(k AS VARCHAR) FROM {_NAMED} AS n")
def pipfile_refs(spark, d):
    plain = _manifest(spark, d, "Pipfile", "[packages]\n", """package || ' = ">' || CAST(k AS STRING) || '"'""", "\n")
    lock = _manifest(spark, d, "Pipfile.lock", '{"_meta": {}, "default": {', """'"' || package || '": {"version": "==' || CAST(k AS STRING) || '"}'""", "}}", ", ")
    return manifests.package_refs(plain.unionByName(lock)).select("path", "package", "version")


@query("manifest_errors", f"SELECT dir || '/' || name AS path, error, CAST(1 AS INTEGER) AS line FROM (SELECT DISTINCT dir FROM {_NAMED} AS n) AS x, (VALUES ('package.json', 'JSONDecodeError'), ('pyproject.toml', 'TOMLDecodeError')) AS e(name, error)")
def manifest_errors(spark, d):
    bad = _manifest(spark, d, "package.json", '{"dependencies": ', "package", "").unionByName(_manifest(spark, d, "pyproject.toml", "[project\n", "package", ""))
    return manifests.package_refs(bad).where("error IS NOT NULL").select("path", "error", "line")


@query("invalid_names", f"SELECT p_partkey AS k FROM part WHERE NOT regexp_matches(p_name, {_q(P.PYTHON_NAME)})")
def invalid_names(spark, d):
    refs = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("package"), F.lit("requirements.txt").alias("name"))
    return manifests.invalid_names(refs).select("k")


@query("unknown_packages", f"{_REFS} SELECT path, line, package FROM r WHERE package NOT IN (SELECT 'pkg' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 4 = 0)")
def unknown_packages(spark, d):
    known = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 4 = 0")
    known = known.select(F.lit("python").alias("ecosystem"), F.concat(F.lit("pkg"), F.col("s_suppkey").cast("string")).alias("package"))
    return manifests.unknown_packages(manifests.package_refs(corpus.requirement_files(spark, d)), known).select("path", "line", "package")


# -- chunks ---------------------------------------------------------------------------------------------------------


@query(
    "line_chunks",
    f"""{CODE} SELECT path, CAST((line - 1) // 4 AS INTEGER) AS chunk, CAST(min(line) AS INTEGER) AS start_line, CAST(max(line) AS INTEGER) AS end_line, string_agg(text, chr(10) ORDER BY line) AS content FROM corpus GROUP BY path, (line - 1) // 4""",
)
def line_chunks(spark, d):
    return chunking.line_chunks(corpus.code_files(spark, d), 4)


# A file of functions of two lines for each customer, below one import.
_FUNCTIONS = "(SELECT 'c' || CAST(o_custkey AS VARCHAR) || '.py' AS path, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS j, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders)"


@query(
    "block_chunks",
    f"""WITH f AS {_FUNCTIONS}, c AS (SELECT path, m, CASE WHEN 1 + 2 * m <= 5 OR j < 2 THEN 0 ELSE 1 + (j - 2) // 2 END AS chunk, min(2 + 2 * j) AS s, max(3 + 2 * j) AS e FROM f GROUP BY path, m, CASE WHEN 1 + 2 * m <= 5 OR j < 2 THEN 0 ELSE 1 + (j - 2) // 2 END)
SELECT path, CAST(chunk AS INTEGER) AS chunk, CAST(CASE WHEN chunk = 0 OR s <= 11 THEN 1 ELSE s END AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line FROM c""",
)
def block_chunks(spark, d):
    text = F.expr("'def f' || CAST(o_orderkey AS STRING) || '(x):\\n    return x'")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.expr("'c' || CAST(o_custkey AS STRING) || '.py'").alias("path"), "o_orderkey", text.alias("t"))
    whole = rows.groupBy("path").agg(F.concat(F.lit("import os\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "t"))), lambda x: x["t"]), "\n")).alias("content"))
    return chunking.file_chunks(whole, 5).select("path", "chunk", "start_line", "end_line")


@query("fallback_chunks", f"{CODE} SELECT c.path, CAST((c.line - 1) // 4 AS INTEGER) AS chunk, CAST(min(c.line) AS INTEGER) AS start_line, CAST(max(c.line) AS INTEGER) AS end_line FROM corpus c GROUP BY c.path, (c.line - 1) // 4")
def fallback_chunks(spark, d):
    broken = corpus.code_files(spark, d).withColumn("content", F.concat(F.lit("(("), "content"))
    return chunking.file_chunks(broken, 4).select("path", "chunk", "start_line", "end_line")


_AROUND = "string_agg(CASE WHEN b.line = a.line THEN '>' ELSE ' ' END || ' ' || lpad(CAST(b.line AS VARCHAR), 3, ' ') || '| ' || b.text, chr(10) ORDER BY b.line)"
_WIDE = "(contains(a.text, '+') OR contains(a.text, '-') OR contains(a.text, '*') OR contains(a.text, '/') OR contains(a.text, 'open(') OR contains(a.text, 'eval(') OR contains(a.text, 'exec('))"


@query(
    "sized_snippets",
    f"""{CODE} SELECT a.path, a.line, {_AROUND} FILTER (WHERE b.line BETWEEN a.line - 1 AND a.line + 1) AS total,
{_AROUND} FILTER (WHERE b.line BETWEEN a.line - CASE WHEN {_WIDE} THEN 2 ELSE 1 END AND a.line + CASE WHEN {_WIDE} THEN 3 ELSE 2 END) AS code,
{_AROUND} FILTER (WHERE b.line BETWEEN a.line - 1 AND a.line + 2) AS comment, {_AROUND} FILTER (WHERE b.line BETWEEN a.line - 2 AND a.line + 2) AS around
FROM corpus a JOIN corpus b ON a.path = b.path AND b.line BETWEEN a.line - 3 AND a.line + 3 GROUP BY a.path, a.line, a.text""",
)
def sized_snippets(spark, d):
    files = corpus.code_files(spark, d)
    rows = X.explode_lines(files).select("path", "line").join(files.select("path", "content"), "path")
    return rows.select("path", "line", *[X.sized_snippet(k, n)(F.col("content"), F.col("line")).alias(k) for k, n in (("total", 3), ("code", 1), ("comment", 1), ("around", 2))])


# blocks of an order: lines as many as a line item's quantity
_BLOCKS = """b AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS i, CAST(l_quantity AS BIGINT) AS n FROM lineitem)"""


@query(
    "greedy_chunks",
    f"""WITH RECURSIVE {_BLOCKS}, r AS (SELECT o, i, n, n AS held, 0 AS chunk FROM b WHERE i = 1
UNION ALL SELECT b.o, b.i, b.n, CASE WHEN r.held + b.n > 60 THEN b.n ELSE r.held + b.n END, CASE WHEN r.held > 0 AND r.held + b.n > 60 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN b ON b.o = r.o AND b.i = r.i + 1)
SELECT o, CAST(i AS INTEGER) AS i, n, CAST(chunk AS INTEGER) AS chunk FROM r""",
)
def greedy_chunks(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    entry = F.struct("l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    per = rows.groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    sizes = F.transform("e", lambda x: x["l_quantity"].cast("long"))
    both = per.select("o", F.posexplode(F.arrays_zip(sizes.alias("n"), chunking.packed(sizes, 60).alias("c"))).alias("pos", "z"))
    return both.select("o", (F.col("pos") + 1).alias("i"), F.col("z.n").alias("n"), F.col("z.c").alias("chunk"))


@query(
    "stack_files",
    f"""WITH RECURSIVE {corpus.CTE}, c AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_replace(path, '^.*/', '') AS name, count(*) AS n, string_agg(text, chr(10) ORDER BY line) AS content FROM corpus GROUP BY path),
o AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY path) AS i, CASE WHEN n > 40 THEN 21 ELSE n END AS w FROM c),
r AS (SELECT dir, i, path, w AS held, 0 AS s FROM o WHERE i = 1 UNION ALL SELECT o.dir, o.i, o.path, CASE WHEN r.held + o.w > 20 THEN o.w ELSE r.held + o.w END, CASE WHEN r.held > 0 AND r.held + o.w > 20 THEN r.s + 1 ELSE r.s END FROM r JOIN o ON o.dir = r.dir AND o.i = r.i + 1)
SELECT o.dir AS stack_group, CAST(r.s AS INTEGER) AS stack, CAST(count(*) AS INTEGER) AS members, CAST(sum(o.n) AS INTEGER) AS n_lines,
CASE WHEN count(*) > 1 THEN string_agg('# === FILE: ' || o.name || ' ===' || chr(10) || o.content, chr(10) || chr(10) ORDER BY o.path) ELSE min(o.content) END AS content
FROM r JOIN o ON o.path = r.path WHERE o.n <= 40 GROUP BY o.dir, r.s""",
)
def stack_files(spark, d):
    stacks = chunking.stack_files(corpus.code_files(spark, d), 40, 0.5)
    return stacks.select("stack_group", "stack", F.size("members").alias("members"), "n_lines", "content")


# -- model responses ------------------------------------------------------------------------------------------------


@query(
    "llm_issues",
    """WITH r AS (SELECT CAST(event_id AS BIGINT) AS key, event_id AS e, event_id % 4 AS c, pos FROM events, (VALUES (0), (1)) AS p(pos) WHERE event_id % 11 <> 0),
t(c, kind, named, finding_type, other, title, severity, confidence) AS (VALUES (0, 'security', true, 'security_issue', 'bad_practice', 'Potential Issue', 'medium', 0.7), (0, 'performance', false, 'performance_issue', 'bad_practice', 'Potential Issue', 'medium', 0.7),
(1, 'misleading', true, 'bad_practice', 'style_issue', 'Naming/Style Issue', 'low', 0.7), (1, 'ai_pattern', false, 'ai_generated', 'style_issue', 'Naming/Style Issue', 'low', 0.7),
(2, 'ai_generated_comment', true, 'ai_generated', 'style_issue', 'Comment/Docstring Quality Issue', 'low', 0.7), (2, 'generic_docstring', false, 'style_issue', 'style_issue', 'Comment/Docstring Quality Issue', 'low', 0.7),
(3, 'resource_exhaustion', true, 'performance_issue', 'security_issue', 'Dangerous AI/ML Pattern', 'medium', 0.8), (3, 'data_poisoning', false, 'security_issue', 'security_issue', 'Dangerous AI/ML Pattern', 'medium', 0.8))
SELECT r.key, CASE WHEN pos = 0 THEN 'E' || CAST(e AS VARCHAR) ELSE t.title END AS title, CASE WHEN pos = 0 AND e % 3 = 0 THEN 'high' WHEN pos = 0 AND e % 3 = 2 THEN 'low' ELSE t.severity END AS severity,
CASE WHEN pos = 0 THEN t.finding_type ELSE t.other END AS finding_type, CAST(CASE WHEN pos = 0 THEN greatest(1, e % 30 - 2) ELSE 1 END AS INTEGER) AS line, CAST(t.confidence AS DOUBLE) AS confidence,
CASE WHEN pos = 0 THEN 'what is wrong' WHEN r.c = 0 THEN 'LLM detected a potential issue' WHEN r.c = 1 THEN 'LLM detected a naming or style issue' WHEN r.c = 2 THEN 'LLM detected a comment/docstring quality issue' ELSE 'Potential AI/ML security vulnerability detected' END AS description,
CASE WHEN r.c = 1 THEN CASE WHEN pos = 0 THEN 'Rename ''a'' to ''b''' ELSE 'Review and improve the naming' END WHEN r.c = 2 THEN 'Review this comment for quality' WHEN pos = 0 THEN 'do this' WHEN r.c = 3 THEN 'Review and address this security concern' ELSE 'Review and address this potential issue' END AS advice
FROM r JOIN t ON t.c = r.c AND t.named = (e % 5 < 3)""",
)
def llm_issues(spark, d):
    rows = model_calls.issue_findings(model_calls.parse_issues(corpus.responses(spark, d)))
    return rows.select("key", "title", "severity", "finding_type", "line", "confidence", "description", "advice")


@query(
    "llm_prompts",
    """SELECT CAST(doc_id AS VARCHAR) AS key, sha256('Look for names that say nothing or mislead, and naming that breaks the file''s own conventions. Kinds: naming, style, convention. Lines are numbered. Answer with JSON of this form only: {"issues": [{"type": "...", "title": "...", "description": "...", "severity": "low|medium|high|critical", "line_number": 1, "confidence": 0.8, "suggestion": "..."}]}'
|| chr(10) || 'File: ' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' || chr(10) || text) AS prompt_sha, sha256('Look for names that say nothing or mislead, and naming that breaks the file''s own conventions. Kinds: naming, style, convention. Lines are numbered. Answer with JSON of this form only: {"issues": [{"type": "...", "title": "...", "description": "...", "severity": "low|medium|high|critical", "line_number": 1, "confidence": 0.8, "suggestion": "...", "file": "name.py"}]}'
|| chr(10) || 'Several files follow, each under its own header.' || chr(10) || text) AS stacked_sha FROM documents""",
)
def llm_prompts(spark, d):
    rows, ask = _docs(spark, d), model_calls.prompt_for
    path, content = F.col("path"), F.col("content")
    return rows.select(
        F.regexp_extract("name", r"^(\d+)", 1).alias("key"), F.sha2(ask("vibe_naming", path, content), 256).alias("prompt_sha"),
        F.sha2(ask("vibe_naming", F.lit(""), content, stacked=True), 256).alias("stacked_sha"),
    )


@query(
    "llm_second_opinions",
    """SELECT CAST(event_id AS BIGINT) AS key, CAST(event_id % 50 AS INTEGER) AS line, 'LLM-detected SQL injection: ' || CASE WHEN event_id % 2 = 0 THEN 'contextual_sqli' ELSE 'sql_injection' END AS title,
CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, 'bind ' || event_type AS advice FROM events WHERE event_id % 7 <> 0""",
)
def llm_second_opinions(spark, d):
    answer = F.expr("""CASE WHEN event_id % 7 = 0 THEN 'I see none' ELSE 'Here: {"vulnerabilities": [{"line": ' || CAST(event_id % 50 AS STRING) || CASE WHEN event_id % 2 = 0 THEN ', "type": "contextual_sqli"' ELSE '' END
|| ', "severity": "' || CASE event_id % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'odd' ELSE 'low' END || '", "recommendation": "bind ' || event_type || '"}], "overall_assessment": "x"} Regards' END""")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("long").alias("key"), answer.alias("response"))
    return model_calls.second_opinions(rows).select("key", "line", "title", "severity", "advice")


_MESSAGES = ("HTTP 404", "Invalid API key given", "model_not_found", "Rate limit reached", "disk is full", "Permission denied", "status 429", "access denied", "apikey missing", "no such file", "502 Bad Gateway", "Connection error.", "not found", "socket unavailable")
_MESSAGE = "CASE o_orderkey % 14 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MESSAGES)) + " END"


@query("llm_error_words", f"SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderkey % 14 NOT IN (4, 6, 9, 12, 13) AS is_llm_error FROM orders")
def llm_error_words(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"), F.expr(_MESSAGE).alias("error"))
    return found.errors(rows).select("k", "is_llm_error")


@query("provider_keys", "SELECT CAST(c_custkey AS BIGINT) AS k, c_custkey % 6 NOT IN (0, 3) AS usable FROM customer")
def provider_keys(spark, d):
    key = F.expr("CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'sk-' || c_name WHEN 2 THEN 'AIza' || c_name WHEN 3 THEN 'your-openai-api-key-here' WHEN 4 THEN 'my own example key' ELSE 'xxx-your-' || c_name END")
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"), model_calls.key_is_usable(key).alias("usable"))


@query("llm_stub_calls", "SELECT CAST(doc_id AS VARCHAR) AS key, 'ok' AS response FROM documents")
def llm_stub_calls(spark, d):
    prompts = _docs(spark, d).select(F.regexp_extract("name", r"^(\d+)", 1).alias("key"), model_calls.prompt_for("edge_cases", F.col("path"), F.col("content")).alias("prompt"))
    return model_calls.call_model(prompts, model_calls.StubProvider("ok")).select("key", "response")



@query(
    "llm_text_fallback",
    """WITH t AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Issue: bad ' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'see line ' || CAST(o_orderkey % 90 AS VARCHAR) WHEN 2 THEN 'more' END AS body FROM orders),
s AS (SELECT *, sum(CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY k) AS section FROM t WHERE body IS NOT NULL)
SELECT path, CAST(section AS INTEGER) AS section, arg_min(body, k) AS title, CAST(coalesce(arg_max(CASE WHEN k % 4 = 1 THEN k % 90 END, CASE WHEN k % 4 = 1 THEN k END), 1) AS INTEGER) AS line, string_agg(body, ' ' ORDER BY k) AS description FROM s WHERE section > 0 GROUP BY path, section""",
)
def llm_text_fallback(spark, d):
    body = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'Issue: bad ' || CAST(o_orderkey AS STRING) WHEN 1 THEN 'see line ' || CAST(o_orderkey % 90 AS STRING) WHEN 2 THEN '  more ' ELSE '' END")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"), "o_orderkey", body.alias("b"))
    texts = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "b"))), lambda x: x["b"]), "\n").alias("response"))
    return model_calls.text_sections(texts, "edge_cases")


@query("llm_dedup", f"WITH {corpus.FINDING_CTE} SELECT checker, path, line, min(fid) AS pos FROM f GROUP BY checker, path, line")
def llm_dedup(spark, d):
    rows = corpus.findings(spark, d).withColumn("pos", F.col("fid"))
    return model_calls.first_per_line(rows).select("checker", "path", "line", "pos")


@query("llm_route_stacked", "SELECT o.o_orderkey AS k, c.c_custkey AS member FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderkey % 3 = c.c_custkey % 3")
def llm_route_stacked(spark, d):
    name = lambda c: F.concat(F.lit("m"), (F.col(c) % 3).cast("string"))
    issues = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("key"), name("o_orderkey").alias("file"))
    members = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"), name("c_custkey").alias("name"), F.col("c_custkey").alias("member"))
    return model_calls.route_stacked(issues, members).select("k", "member")


# -- findings and reports -------------------------------------------------------------------------------------------

_RANK = "list_position(['info','low','medium','high','critical'], severity)"


@query(
    "dedup_findings",
    f"""WITH {corpus.FINDING_CTE}, r AS (SELECT *, checker IN ('sql_injection', 'contextual_sqli_audit') AS sq, row_number() OVER (PARTITION BY path, line, checker IN ('sql_injection', 'contextual_sqli_audit') ORDER BY {_RANK} DESC, checker DESC, confidence DESC, title) AS rn FROM f)
SELECT fid, path, line, checker FROM r WHERE NOT sq OR rn = 1""",
)
def dedup_findings(spark, d):
    rows = found.drop_repeats(corpus.findings(spark, d), line="line", confidence=F.col("confidence"))
    return rows.select("fid", "path", "line", "checker")


@query("checker_status", f"WITH {corpus.FINDING_CTE}, c(checker) AS (VALUES {', '.join(f'({_q(c)})' for c in CHECKERS)}) SELECT checker, CASE WHEN checker IN (SELECT checker FROM f) THEN 'ran' ELSE 'skipped' END AS status FROM c")
def checker_status(spark, d):
    return found.checker_status(spark, list(CHECKERS), corpus.findings(spark, d))


@query(
    "summary_counts",
    f"""WITH {corpus.FINDING_CTE} SELECT 'severity' AS kind, severity AS value, count(*) AS n FROM f GROUP BY severity UNION ALL SELECT 'type', type, count(*) FROM f GROUP BY type
UNION ALL SELECT 'checker', checker, count(*) FROM f GROUP BY checker UNION ALL SELECT 'total', 'all', count(*) FROM f""",
)
def summary_counts(spark, d):
    return report.summary_counts(corpus.findings(spark, d))


@query("filter_findings", f"WITH {corpus.FINDING_CTE} SELECT fid FROM f WHERE severity = 'high' AND checker = 'edge_cases'")
def filter_findings(spark, d):
    return report.select(corpus.findings(spark, d), severity="high", checker="edge_cases").select("fid")


@query("triage", f"WITH {corpus.FINDING_CTE}, s(severity) AS (VALUES ('info'), ('low'), ('medium'), ('high'), ('critical')) SELECT s.severity, count(f.fid) AS n FROM s LEFT JOIN f ON f.severity = s.severity GROUP BY s.severity")
def triage(spark, d):
    return report.triage(spark, corpus.findings(spark, d)).select("severity", "n")


@query("recommendations", f"WITH {corpus.FINDING_CTE}, m AS (SELECT count(*) FILTER (WHERE type = 'security_issue') AS s, count(*) FILTER (WHERE type = 'performance_issue') AS p, count(*) FILTER (WHERE type = 'bad_practice') AS b, count(*) AS n FROM f) SELECT 'security' AS topic FROM m WHERE s > 0 UNION ALL SELECT 'performance' FROM m WHERE p > 0 UNION ALL SELECT 'practices' FROM m WHERE b > 0.2 * n")
def recommendations(spark, d):
    return report.recommendations(corpus.findings(spark, d))


_CATEGORY = "CASE WHEN checker IN ('sql_injection', 'contextual_sqli_audit') THEN 'Security Issues' WHEN checker = 'edge_cases' THEN 'Code Quality' WHEN checker = 'boilerplate' THEN 'Best Practices' ELSE 'Other Issues' END"
_PRIORITY = "CASE WHEN checker IN ('sql_injection', 'contextual_sqli_audit') THEN 0 WHEN checker = 'edge_cases' THEN 1 WHEN checker = 'boilerplate' THEN 3 ELSE 4 END"


def _report_rows(spark, d):
    rows = corpus.findings(spark, d).select(F.format_string("%09d", "fid").alias("id"), "path", F.col("line").alias("line_start"), "checker", "severity", "type", "confidence", "title")
    return report.with_category(spark, rows)


@query("report_plain_order", f"WITH {corpus.FINDING_CTE} SELECT printf('%09d', fid) AS id, {_CATEGORY} AS category, CAST(row_number() OVER (ORDER BY {_PRIORITY}, {_CATEGORY}, {_RANK} DESC, confidence DESC, path, line, printf('%09d', fid)) AS INTEGER) AS rank FROM f")
def report_plain_order(spark, d):
    return report.ranked(_report_rows(spark, d), False, F.col("confidence")).select("id", "category", "rank")


@query("report_file_order", f"WITH {corpus.FINDING_CTE} SELECT printf('%09d', fid) AS id, CAST(row_number() OVER (ORDER BY {_PRIORITY}, {_CATEGORY}, path, {_RANK} DESC, confidence DESC, path, line, printf('%09d', fid)) AS INTEGER) AS rank FROM f")
def report_file_order(spark, d):
    return report.ranked(_report_rows(spark, d), True, F.col("confidence")).select("id", "rank")


@query("category_rollup", f"WITH {corpus.FINDING_CTE}, c AS (SELECT {_CATEGORY} AS category, path FROM f) SELECT category, path, count(*) AS n FROM c GROUP BY category, path UNION ALL SELECT category, NULL, count(*) FROM c GROUP BY category")
def category_rollup(spark, d):
    return report.category_rollup(_report_rows(spark, d))


@query("severity_pivot", f"WITH {corpus.FINDING_CTE} SELECT checker, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info")) + " FROM f GROUP BY checker")
def severity_pivot(spark, d):
    return report.severity_columns(corpus.findings(spark, d), "checker")


def _as_findings(spark, d):
    rows = corpus.findings(spark, d)
    return found.as_findings(rows, F.col("checker"), F.col("title"), F.col("severity"), F.col("type"), F.col("confidence"), snippet=F.concat(F.lit("code of "), "title", F.when(F.col("fid") % 3 == 0, F.repeat(F.lit("\nx"), F.lit(19))).otherwise(F.lit(""))))


@query("findings_json", f"""WITH {corpus.FINDING_CTE} SELECT title, path, checker AS checker_name, CAST(line AS VARCHAR) AS line_start, confidence FROM f""")
def findings_json(spark, d):
    rows = report.to_json(_as_findings(spark, d))
    get = lambda p: F.get_json_object("json", p)
    return rows.select(get("$.title").alias("title"), get("$.location.file").alias("path"), get("$.checker_name").alias("checker_name"), get("$.location.line_start").alias("line_start"), get("$.confidence").cast("double").alias("confidence"))


@query("plain_lines", f"WITH {corpus.FINDING_CTE} SELECT fid, '[' || upper(severity) || '] ' || title || ' - ' || path || CASE WHEN line > 0 THEN ':line ' || CAST(line AS VARCHAR) ELSE '' END || chr(10) || 'code of ' || title || CASE WHEN fid % 3 = 0 THEN repeat(chr(10) || 'x', 13) || chr(10) || '...' ELSE '' END AS rendered FROM f")
def plain_lines(spark, d):
    rows = report.plain_line(_as_findings(spark, d))
    return rows.select(F.substring("title", 2, 20).cast("long").alias("fid"), "rendered")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret findings by source, language, rule and severity."""
    rows = secret_lines(spark, sf_dir)
    return rows.groupBy(F.split("path", "/")[0].alias("source"), "kind", "severity").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))
