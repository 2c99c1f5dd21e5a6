import io
import json

import pytest
from pyspark.sql import functions as F

from auditspark import cli, config
from auditspark.functions import text as X
from auditspark.operators import ast_rules, chunking, findings, manifests, model_calls, regex_rules, report
from auditspark.plans import scan
from auditspark.schema import confidence, location_text, severity_rank
from auditspark.sources import files as S


def frame(spark, *rows):
    return S.with_names(spark.createDataFrame([(p, len(c.encode()), c) for p, c in rows], "path string, size_bytes long, content string"))


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_lines_as_python_splits(spark):
    texts = ["", "a", "a\n", "a\n\n", "a\r\nb\rc", "x\u2028y\x85z\x0bq\x1c", "\n", "é\n\nb "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", X.lines(F.col("t")).alias("l")).collect():
        assert r.l == texts[r.i].splitlines()


def test_globs_and_directories(spark):
    df = spark.createDataFrame([(p,) for p in ("a/b.py", "build/x.py", "a/build/y.py", "requirements.txt", "a/n.js", "b[1].py")], "path string")
    df = df.withColumn("size_bytes", F.lit(5))
    got = rows(S.select_files(df, ("*.py", "*requirements*.txt"), ("build/", "*n.py"), 10), "path")
    assert got == [("a/b.py",), ("b[1].py",), ("requirements.txt",)]
    assert rows(S.select_files(df, ("*",), (), 10, 2), "path") == [("a/b.py",), ("a/build/y.py",)]
    assert rows(S.select_files(df, ("*",), (), 4), "path") == []


def test_reads_files_leniently(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes(b"ok = 1\xff\n")
    (tmp_path / "a" / "big.py").write_bytes(b"#" * 200)
    (tmp_path / "note.md").write_text("no")
    got = S.read_files(spark, str(tmp_path), ("*.py",), (), 100).collect()
    assert [(r.name, r.ext, r.content) for r in got] == [("x.py", ".py", "ok = 1\n")]


SOURCE = '''import sqlite3
from ...deep import x
from m import *
def f(cur, user_id, name, a):
    cur.execute(f"SELECT * FROM t WHERE id = {user_id}")
    cur.execute("SELECT a FROM t WHERE n = '" + name + "'")
    cur.execute("SELECT {} FROM t WHERE x = {}".format(a, name))
    cur.execute("SELECT * FROM t WHERE id = ?", (user_id,))
    cur.execute("SELECT * FROM t WHERE id = ?")
    cur.execute("SELECT * FROM t WHERE n = 'bob'", ())
    cur.execute(f"UPDATE t SET a = {a}", (user_id,))
    print(a)
    return sorted(a, key=lambda r: r.id)
'''


def test_tree_rules():
    got = {(h.line, h.rule, h.severity) for h in ast_rules.analyse(SOURCE)}
    assert {
        (2, "deep_relative_import", "low"), (3, "star_import", "medium"), (5, "sql_fstring", "critical"), (5, "cursor_interpolation", "critical"),
        (6, "sql_concat", "high"), (7, "sql_format", "high"), (7, "sql_contextual", "high"), (9, "cursor_missing_params", "high"),
        (10, "cursor_hard_predicate", "medium"), (11, "sql_mixed", "high"), (12, "print_call", "low"), (13, "needless_lambda", "low"),
    } <= got
    assert not [h for h in got if h[0] == 8]
    assert [h.rule for h in ast_rules.analyse("def f(:\n")] == ["syntax_error"]
    assert [h.rule for h in ast_rules.analyse("x = '\0'")] in (["parse_failure"], ["syntax_error"])
    assert [(h.line, h.rule) for h in ast_rules.analyse("x = 1\nclass A:\n    def __init__(self):\n        pass\n")] == [(2, "empty_class")]


def test_missing_init(spark):
    df = frame(spark, ("p/a.py", ""), ("p/b.py", ""), ("q/a.py", ""), ("r/a.py", ""), ("r/__init__.py", ""), (".h/a.py", ""), (".h/b.py", ""))
    assert rows(ast_rules.missing_init(df)) == [("p/a.py",), ("p/b.py",)]


def test_manifests(spark):
    df = frame(
        spark,
        ("requirements.txt", "a==1\n# no\n\nb-c >= 2\n"),
        ("setup.py", "setup(install_requires=['x>1', \"y\"])"),
        ("package.json", '{"dependencies": {"@s/p": "^1"}, "devDependencies": {"q": "2"}}'),
        ("package-lock.json", '{"dependencies": {"l": {"version": "3"}}}'),
        ("yarn.lock", '# c\n"@t/u@^1":\n  version "1.2"\nv@2:\n  version "2.0"\n'),
        ("pyproject.toml", '[project]\ndependencies = ["m>=1"]\n[tool.poetry.dependencies]\npython = "3"\nn = "1"\n'),
        ("Pipfile", '[packages]\no = "*"\n'),
        ("Pipfile.lock", '{"_meta": {}, "default": {"r": {"version": "==1"}}}'),
        ("setup.cfg", "[options]\ninstall_requires =\n    s>1\n[other]\nk = v\n"),
        ("sub/pyproject.toml", "not toml ["),
    )
    refs = manifests.package_refs(df)
    got = rows(refs.where("error IS NULL"), "name", "package", "version", "line")
    assert got == sorted(
        [
            ("requirements.txt", "a", "==1", 1), ("requirements.txt", "b-c", ">= 2", 4), ("setup.py", "x", ">1", 0), ("setup.py", "y", "", 0),
            ("package.json", "@s/p", "^1", 0), ("package.json", "q", "2", 0), ("package-lock.json", "l", "3", 0), ("yarn.lock", "@t/u", "1.2", 3),
            ("yarn.lock", "v", "2.0", 5), ("pyproject.toml", "m", ">=1", 0), ("pyproject.toml", "n", "1", 0), ("Pipfile", "o", "*", 0),
            ("Pipfile.lock", "r", "==1", 0), ("setup.cfg", "s", ">1", 0),
        ],
        key=str,
    )
    assert refs.where("error IS NOT NULL").count() == 1
    known = spark.createDataFrame([("python", p) for p in "abxymnors"] + [("javascript", "q")], "ecosystem string, package string")
    assert {r[0] for r in rows(manifests.unknown_packages(refs, known), "package")} == {"b-c", "@s/p", "@t/u"}  # l and v are no names of scripts


def test_chunks(spark):
    code = "x = 1\n\ndef a():\n    return 1\n\n\ndef b():\n    return 2\n\nclass C:\n    pass\n"
    assert [b[:3] for b in chunking.find_blocks(code)] == [(1, 2, "module_code"), (3, 4, "function"), (7, 8, "function"), (10, 11, "class")]
    df = frame(spark, ("a.py", code), ("bad.py", "(\n" * 9), ("s.py", "y = 2\n"), ("e.py", ""))
    got = rows(chunking.file_chunks(df, 4), "path", "chunk", "start_line", "end_line")
    assert got == sorted([("a.py", 0, 1, 4), ("a.py", 1, 1, 11), ("bad.py", 0, 1, 4), ("bad.py", 1, 5, 8), ("bad.py", 2, 9, 9), ("s.py", 0, 1, 1), ("e.py", 0, 1, 0)], key=str)
    stacked = chunking.stack_files(frame(spark, ("d/a.py", "1\n2"), ("d/b.py", "3"), ("d/c.py", "4\n5\n6")), 8, 0.5).collect()
    by = {tuple(r.members): r for r in stacked}
    two = by["d/a.py", "d/b.py"]
    assert two.content == "# === FILE: a.py ===\n1\n2\n\n# === FILE: b.py ===\n3"
    assert [(m.path, m.line) for m in two.line_map] == [("d/a.py", 0), ("d/a.py", 1), ("d/a.py", 2), (None, 0), ("d/b.py", 0), ("d/b.py", 1)]
    assert by[("d/c.py",)].content == "4\n5\n6"


def test_model_responses(spark):
    answers = spark.createDataFrame(
        [("k1", "edge_cases", '```json\n{"issues": [{"title": "T", "severity": "weird", "line_number": 0}, {"severity": "low"}]}\n```'), ("k2", "vibe_naming", "nothing"), ("k3", "comment_quality", None)],
        "key string, checker string, response string",
    )
    got = rows(model_calls.issue_findings(model_calls.parse_issues(answers)), "key", "title", "severity", "line", "confidence")
    assert got == [("k1", "Potential Issue", "low", 1, 0.7), ("k1", "T", "medium", 1, 0.7)]
    text = spark.createDataFrame([("p", "intro\nIssue: one\nat line 7\nBug: two\n\nmore\n")], "path string, response string")
    assert rows(model_calls.text_sections(text, "edge_cases")) == [("p", 1, "Issue: one", 7, "Issue: one at line 7"), ("p", 2, "Bug: two", 1, "Bug: two more")]

    class Broken:
        def available(self):
            return True

        def analyze(self, prompt):
            raise TimeoutError("timed out")

    calls = model_calls.call_model(spark.createDataFrame([("k", "p")], "key string, prompt string"), Broken())
    assert findings.errors(calls).select("is_llm_error").collect()[0][0]
    assert not model_calls.usable_key("your-openai-api-key-here") and not model_calls.usable_key("") and model_calls.usable_key("sk-xxx-of-yourself") and model_calls.usable_key("k-93jd83")
    with pytest.raises(ValueError):
        model_calls.make_provider("nobody", "m", "k")


def test_repeats_keep_the_worst_sql_finding(spark):
    data = [("a", 1, "sql_injection", "high", 0.9), ("a", 1, "contextual_sqli_audit", "high", 0.95), ("a", 1, "boilerplate", "low", 0.5), ("a", 2, "sql_injection", "low", 0.5)]
    df = spark.createDataFrame([(*r, str(i)) for i, r in enumerate(data)], "path string, line_start int, checker string, severity string, c double, title string")
    assert rows(findings.drop_repeats(df, confidence=F.col("c")), "title") == [("0",), ("2",), ("3",)]
    assert rows(findings.drop_repeats(df, confidence=F.col("c"), literal=True), "title") == [("1",), ("2",), ("3",)]


def test_small_columns(spark):
    df = spark.range(1)
    empty = F.array().cast("array<struct<confidence:double>>")
    r = df.select(
        confidence(empty).alias("none"), location_text(F.lit("f"), F.lit(3), F.lit(5)).alias("many"), location_text(F.lit("f"), F.lit(0), F.lit(None).cast("int")).alias("bare"),
        severity_rank(F.lit("critical")).alias("top"), F.round(X.entropy(F.lit("aabb")), 6).alias("bits"), X.percent(F.lit(0.256)).alias("p"),
    ).first()
    assert (r.none, r.many, r["bare"], r.top, r.bits, r.p) == (0.5, "f:lines 3-5", "f", 4, 1.0, "25.6%")
    code = "\n".join(["def f():", "    if a:", "        b()", "", "x = 1", "# note", "y"])
    shown = spark.createDataFrame([(code, i) for i in (1, 2, 6, 9)], "c string, n int")
    for kind in ("total", "code", "comment", "around"):
        got = [r[0] for r in shown.select(X.sized_snippet(kind, 3)("c", "n")).collect()]
        assert got[-1] == "" and all(f"> {n:3d}| " in g for n, g in zip((1, 2, 6), got, strict=False))


def test_config(tmp_path):
    (tmp_path / config.FILE_NAME).write_text('[chunking]\nmax_chunk_lines = 80\n[llm]\nmodel = "m"\n')
    c = config.load(tmp_path, environ={"HOME": str(tmp_path / "h"), "AUDITSPARK_LLM__TIMEOUT": "5", "AUDITSPARK_CHECKERS__ENABLED": "boilerplate,edge_cases", "AUDITSPARK_LLM__MODEL": ""})
    assert (c.chunking.max_chunk_lines, c.llm.timeout, c.llm.model, c.checkers.enabled) == (80, 5, "m", ("boilerplate", "edge_cases"))
    for bad in ({"chunking": {"max_chunk_lines": 2}}, {"output": {"format": "x"}}, {"nope": {}}, {"llm": {"nope": 1}}):
        with pytest.raises(ValueError):
            config.build(bad)
    import tomllib

    assert config.build(tomllib.loads(config.to_toml(config.Config()))) == config.Config()
    assert config.selected_checkers(config.build({"checkers": {"classical_only": True}})) == [c for c in config.CHECKERS if c in config.CLASSICAL]


def test_scan_and_command_line(spark, tmp_path):
    (tmp_path / "app.py").write_text('import sqlite3\ntoken = "abcdef123456"\ndef f(cur, user_id):\n    cur.execute(f"SELECT * FROM t WHERE id = {user_id}")\n')
    (tmp_path / "requirements.txt").write_text("fine\n")
    got = rows(scan.scan(spark, str(tmp_path)), "checker", "line_start", "severity")
    assert got == [("dependency_validation", 1, "low"), ("hardcoded_secrets", 2, "high"), ("sql_injection", 4, "critical")]
    assert [r.line_start for r in scan.scan(spark, str(tmp_path), known_packages=spark.createDataFrame([("python", "fine")], "ecosystem string, package string")).collect()] == [2, 4]
    stub = model_calls.StubProvider('{"issues": [{"title": "T", "line_number": 2}]}')
    assert ("vibe_naming", 2, "low") in rows(scan.scan(spark, str(tmp_path), provider=stub), "checker", "line_start", "severity")
    out = io.StringIO()
    assert cli.main(["scan", str(tmp_path), "--format", "json"], spark, out) == 1
    data = json.loads(out.getvalue())
    assert data["has_issues"] and data["findings"][0]["location"]["line_start"] in (2, 4)
    out = io.StringIO()
    assert cli.main(["scan", str(tmp_path), "--include", "*.nothing", "--verbose"], spark, out) == 0
    assert cli.main(["version"], spark, out) == 0


def test_context_window_and_nearest(spark):
    code = "\n".join(["user_id = request.args.get('u')"] + ["pass"] * 8 + ['q = "SELECT * FROM t WHERE id = " + user_id'])
    df = frame(spark, ("a.py", code), ("b.py", "x = 1"))
    assert rows(regex_rules.sql_line_findings(df)) == [("a.py", 10, "high", 0.85, ["user_id"])]
    asked = spark.createDataFrame([("a.py", 1, 8, "SELECT"), ("a.py", 2, 90, "nowhere"), ("b.py", 3, 0, "x")], "path string, fid int, line int, key string")
    assert rows(regex_rules.nearest_lines(asked, df)) == [("a.py", 1, 10), ("a.py", 2, 10), ("b.py", 3, 1)]


def test_stream_of_files(spark, tmp_path):
    from auditspark.streaming import incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('x\npassword = "hunter22"\n')
    q = incremental.stream_secrets(incremental.watch_files(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("secrets").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("secrets"), "line", "kind") == [(2, "assigned_secret")]


def test_report_rows(spark):
    df = spark.createDataFrame([("sql_injection", "a", "high", "security_issue"), ("unknown", "b", "low", "bad_practice")], "checker string, path string, severity string, type string")
    assert ("total", "all", 2) in rows(report.summary_counts(df))
    assert ("Other Issues", 4) in rows(report.with_category(spark, df), "category", "priority")
    assert dict(rows(report.triage(spark, df), "severity", "n"))["critical"] == 0
    assert report.has_issues(df) and not report.has_issues(df.where("false"))


def test_model_checks_of_stacked_and_chunked_files(spark):
    large = "\n".join(f"name_{i} = {i}" for i in range(300))
    df = frame(spark, ("d/a.py", "x = 1\ny = 2\n"), ("d/b.py", "z = 3\n"), ("d/big.py", large))

    class Answers:
        def available(self):
            return True

        def analyze(self, prompt):
            if "Several files" in prompt:  # a.py's header is line 1, a gap line 4, b.py's header line 5
                return '{"issues": [{"title": "in a", "line_number": 3, "file": "a.py"}, {"title": "in b", "line_number": 6}, {"title": "lost", "line_number": 2, "file": "none.py"}]}'
            return "Name: poor 'name_280'\nsee line 279\n"

    rows_, _ = scan.model_findings(spark, df, ["vibe_naming"], Answers(), config.Config())
    assert rows(rows_, "path", "line_start", "title") == [("d/a.py", 2, "in a"), ("d/b.py", 1, "in b"), ("d/big.py", 281, "Name: poor 'name_280'")]


def test_plugins(spark):
    from auditspark.operators import plugins

    mine = plugins.Checker("own", "a tab", rule=lambda t: F.contains(t, F.lit("\t")), check=lambda p, c: [(1, "long", "low", "code_smell", 0.5)] if len(c) > 5 else [])
    df = frame(spark, ("a.py", "x\n\ty = 1"), ("b.txt", "\t"))
    got = rows(scan.audit(spark, df, plugins=(mine,)).findings.where("checker = 'own'"), "path", "line_start", "title", "severity")
    assert got == [("a.py", 1, "long", "low"), ("a.py", 2, "a tab", "medium")]
    assert plugins.describe(spark, [mine]).count() == 1


def test_failed_calls_second_opinions_and_rule_fallback(spark):
    code = "import torch\nimport sqlite3\nimport pickle\nmodel = pickle.load(handle)\ndef f(cur, user_id):\n    cur.execute(f'SELECT * FROM t WHERE id = {user_id}')\n"
    df = frame(spark, ("a.py", code))

    class Odd:
        def available(self):
            return True

        def analyze(self, prompt):
            if "open to injection" in prompt:
                return 'Yes: {"vulnerabilities": [{"line": 6, "severity": "high", "recommendation": "bind"}]}'
            if "unsafe use of models" in prompt:
                return "I cannot say."
            raise ConnectionError("rate limit")

    model_calls.call_model.__defaults__, kept = (None, 2, 0.0), model_calls.call_model.__defaults__
    try:
        done = scan.audit(spark, df, provider=Odd())
        found = rows(done.findings, "checker", "title", "line_start")
        assert ("dangerous_ai_logic", "unsafe_pickle_load", 4) in found
        assert [r for r in found if r[0] == "sql_injection"] == [("sql_injection", "sql_fstring", 6)]  # the more severe of two at one place
        failed = {(r.checker, r.error, r.is_llm_error) for r in done.errors.collect()}
        assert ("vibe_naming", "ConnectionError: rate limit", True) in failed and not any(c == "dangerous_ai_logic" for c, _, _ in failed)
        assert {r.checker for r in done.checkers.where("status = 'ran'").collect()} >= {"vibe_naming", "boilerplate"}
        assert cli.messages(done, True, True)[0].startswith("The model could not be reached")
    finally:
        model_calls.call_model.__defaults__ = kept


def test_ranks_are_places_in_the_whole_order(spark):
    import random

    rng = random.Random(2)
    data = [(f"id{i}", f"p{rng.randrange(9)}", rng.randrange(50), rng.choice(["boilerplate", "edge_cases"]), rng.choice(["low", "high"]), rng.random()) for i in range(500)]
    df = spark.createDataFrame(data, "id string, path string, line_start int, checker string, severity string, c double")
    out = report.ranked(report.with_category(spark, df), False, F.col("c")).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 501))
    key = lambda r: (r.priority, r.category, {"high": 0, "low": 1}[r.severity], -r.c, r.path, r.line_start, r.id)
    assert [r.id for r in out] == [r.id for r in sorted(out, key=key)]


def test_limit_is_taken_from_the_listing(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f {i}#[x].py").write_text(f"x = {i}")
    got = S.read_files(spark, str(tmp_path), ("*.py",), (), 100, 4).collect()
    assert sorted(r.content for r in got) == [f"x = {i}" for i in range(4)]
