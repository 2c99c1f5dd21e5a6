"""Rules over Python syntax trees: each file is parsed once, in Arrow batches, and all rules walk the one tree.

A file that does not parse gives a syntax-error row; any other failure of the parser (too deep, null bytes) gives a
row of kind parse_failure. Text rules that cross lines are evaluated here as well, since they need whole contents.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

SCHEMA = "path string, line int, column int, rule string, checker string, severity string, type string, confidence double, detail string"


@dataclass(frozen=True)
class Hit:
    line: int
    rule: str
    severity: str
    confidence: float
    detail: str = ""
    column: int = 0


CHECKER = {
    "syntax_error": ("package_check", "bad_practice"),
    "parse_failure": ("package_check", "bad_practice"),
    "deep_relative_import": ("package_check", "bad_practice"),
    "star_import": ("package_check", "bad_practice"),
    "print_call": ("package_check", "bad_practice"),
    "needless_lambda": ("boilerplate", "ai_generated"),
    "lambda_text": ("boilerplate", "ai_generated"),
    "empty_class": ("boilerplate", "ai_generated"),
    "sql_literal": ("sql_injection", "security_issue"),
    "sql_concat": ("sql_injection", "security_issue"),
    "sql_fstring": ("sql_injection", "security_issue"),
    "sql_format": ("sql_injection", "security_issue"),
    "sql_mixed": ("sql_injection", "security_issue"),
    "sql_contextual": ("sql_injection", "security_issue"),
    "cursor_interpolation": ("contextual_sqli_audit", "security_issue"),
    "cursor_missing_params": ("contextual_sqli_audit", "security_issue"),
    "cursor_hard_predicate": ("contextual_sqli_audit", "security_issue"),
}
_CONTEXTUAL = [re.compile(p, re.I | re.S) for p in P.CONTEXTUAL]
_HARD = [re.compile(p, re.I) for p in P.HARD_PREDICATES]


def _named(node: ast.AST) -> str:
    """Dotted name of a call target, as far as it is made of names."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    parts.append(node.id if isinstance(node, ast.Name) else "")
    return ".".join(reversed(parts))


def _text(node: ast.AST) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _template(node: ast.JoinedStr) -> str:
    """The f-string with {name} where a name stands and {expr} for anything else."""
    show = lambda v: v.value if isinstance(v, ast.Constant) else "{" + (v.value.id if isinstance(v.value, ast.Name) else "expr") + "}"
    return "".join(str(show(v)) for v in node.values)


def _is_format(node: ast.AST) -> bool:
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format"


def _is_op(node: ast.AST, *ops: type) -> bool:
    return isinstance(node, ast.BinOp) and isinstance(node.op, ops)


def _has(text: str, words) -> bool:
    return any(w in text for w in words)


def _sql_text(node: ast.AST) -> str:
    """What is known of the statement: placeholders stand for what is put in."""
    if (s := _text(node)) is not None:
        return s
    if isinstance(node, ast.JoinedStr):
        return _template(node)
    if _is_op(node, ast.Add):
        right = node.right
        return (_text(node.left) or "") + ("{" + right.id + "}" if isinstance(right, ast.Name) else _text(right) or "")
    if _is_format(node) and (s := _text(node.func.value)) is not None:
        for i, a in enumerate(node.args):
            s = s.replace("{%d}" % i, "{" + (a.id if isinstance(a, ast.Name) else "expr") + "}")
        return s
    return ""


def _dangerous(text: str) -> bool:
    if not _has(text.lower(), P.DML_WORDS):
        return False
    rest = re.sub(P.PLAIN_PLACEHOLDERS, "", re.sub(P.NAMED_PLACEHOLDERS, "", text))
    return "%" in rest or ("{" in text and "}" in text) or "+" in text


def _looks_like_params(node: ast.AST) -> bool:
    if isinstance(node, (ast.Tuple, ast.List)):
        return bool(node.elts)
    if isinstance(node, ast.Dict):
        return bool(node.keys)
    return isinstance(node, ast.Name) and _has(node.id.lower(), P.USER_NAMES)


def sql_call_hits(node: ast.Call) -> Iterator[Hit]:
    name = _named(node.func)
    direct = isinstance(node.func, ast.Attribute) and node.func.attr in ("execute", "executemany")
    if not node.args or not (_has(name, P.SQL_CALLS) or direct):
        return
    sql, line = node.args[0], node.lineno
    literal = _text(sql)
    if literal is not None and _dangerous(literal):
        yield Hit(line, "sql_literal", "medium", 0.7)
    if _is_op(sql, ast.Add):
        yield Hit(line, "sql_concat", "high", 0.9)
    if isinstance(sql, ast.JoinedStr):
        shown = _template(sql)
        users = sorted({v.value.id for v in sql.values if isinstance(v, ast.FormattedValue) and isinstance(v.value, ast.Name) and _has(v.value.id.lower(), P.USER_NAMES)})
        if users and _has(shown.lower(), P.PARAMETER_CLAUSES):
            yield Hit(line, "sql_fstring", "critical", 0.95, ",".join(users))
        elif users:
            yield Hit(line, "sql_fstring", "high", 0.9, ",".join(users))
        else:
            yield Hit(line, "sql_fstring", "medium", 0.8)
    if _is_format(sql):
        yield Hit(line, "sql_format", "high", 0.8)
    if (isinstance(sql, (ast.BinOp, ast.JoinedStr)) or _is_format(sql)) and len(node.args) > 1 and _looks_like_params(node.args[1]):
        yield Hit(line, "sql_mixed", "high", 0.9)
    shown = _sql_text(sql)
    if shown and any(p.search(shown) for p in _CONTEXTUAL):
        yield Hit(line, "sql_contextual", "high", 0.9)


def cursor_hits(node: ast.Call) -> Iterator[Hit]:
    if not (isinstance(node.func, ast.Attribute) and node.func.attr in P.CURSOR_CALLS and node.args):
        return
    sql, line = node.args[0], node.lineno
    if isinstance(sql, ast.JoinedStr) or _is_op(sql, ast.Add, ast.Mod) or _is_format(sql):
        yield Hit(line, "cursor_interpolation", "critical", 0.9)
        return
    text = _text(sql)
    if text is None or not _has(text.upper(), P.SQL_WORDS):
        return
    if len(node.args) < 2 and ("?" in text or "%s" in text or re.search(r":\w+", text)):
        yield Hit(line, "cursor_missing_params", "high", 0.85)
    elif any(p.search(text) for p in _HARD):
        yield Hit(line, "cursor_hard_predicate", "medium", 0.7)


def _imports(tree: ast.AST) -> set[str]:
    out: set[str] = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out.update(a.name for a in n.names)
        elif isinstance(n, ast.ImportFrom) and n.module:
            out.add(n.module)
    return out


def _text_hits(content: str) -> Iterator[Hit]:
    at = lambda m: content.count("\n", 0, m.start()) + 1
    for m in re.finditer(P.UNNECESSARY_LAMBDA, content):
        yield Hit(at(m), "lambda_text", "low", 0.6)
    for m in re.finditer(P.EMPTY_CLASS, content, re.M):
        yield Hit(at(m), "empty_class", "medium", 0.7)


def analyse(content: str, audit: bool = True) -> list[Hit]:
    """All hits of one file, by line and rule. `audit` adds the opt-in cursor rules."""
    try:
        tree = ast.parse(content)
    except SyntaxError as e:
        return [Hit(e.lineno or 1, "syntax_error", "high", 1.0, str(e.msg), e.offset or 1), *_text_hits(content)]
    except (RecursionError, ValueError, MemoryError) as e:
        return [Hit(1, "parse_failure", "high", 1.0, type(e).__name__)]
    out: list[Hit] = []
    names = _imports(tree)
    sql = any(n == d or n.startswith(d + ".") for n in names for d in P.SQL_DRIVERS)
    lambdas = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            if node.level > 2 and node.module is not None:
                out.append(Hit(node.lineno, "deep_relative_import", "low", 0.9, node.module))
            if any(a.name == "*" for a in node.names):
                out.append(Hit(node.lineno, "star_import", "medium", 1.0, node.module or ""))
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name) and node.func.id == "print":
                out.append(Hit(node.lineno, "print_call", "low", 0.7, column=node.col_offset + 1))
            if sql:
                out += sql_call_hits(node)
            if sql and audit:
                out += cursor_hits(node)
        elif isinstance(node, ast.Lambda) and len(node.args.args) == 1:
            b = node.body
            if isinstance(b, (ast.Attribute, ast.Subscript)) or isinstance(b, ast.Call) and isinstance(b.func, ast.Attribute) and not b.args:
                out.append(Hit(node.lineno, "needless_lambda", "low", 0.6))
                lambdas.add(node.lineno)
    # one finding for a lambda, whichever way it was found
    out += [h for h in _text_hits(content) if not (h.rule == "lambda_text" and h.line in lambdas)]
    return sorted(out, key=lambda h: (h.line, h.rule, h.column))


def ast_findings(files: DataFrame, audit: bool = True) -> DataFrame:
    """One row for each hit in the Python files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (path, h.line, h.column, h.rule, *(CHECKER[h.rule][0],), h.severity, CHECKER[h.rule][1], h.confidence, h.detail)
                for path, content in zip(batch["path"], batch["content"], strict=True)
                for h in analyse(content or "", audit)
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.where(F.col("ext") == ".py").select("path", "content").mapInPandas(run, SCHEMA)


#: What to do about the hits of each rule.
ADVICE = {
    "sql_literal": "Keep values out of the statement's text and pass them as parameters.",
    "sql_concat": "Replace the concatenation by placeholders and pass the values as parameters.",
    "sql_fstring": "Replace the f-string by a plain string with placeholders and pass the values as parameters.",
    "sql_format": "Replace format() by placeholders and pass the values as parameters.",
    "sql_mixed": "The call passes parameters already: use them for the interpolated values too.",
    "sql_contextual": "The interpolated value stands where a parameter belongs: use a placeholder.",
    "cursor_interpolation": "Never build the statement of an execute call from values; bind them.",
    "cursor_missing_params": "The statement has placeholders: pass a sequence of values for them.",
    "cursor_hard_predicate": "Bind the value of the predicate instead of writing it into the statement.",
    "star_import": "Import the names that are used.",
    "deep_relative_import": "Import by the package's full name.",
    "print_call": "Use logging, or remove the call.",
    "needless_lambda": "Use operator.attrgetter, itemgetter or the method itself.",
    "lambda_text": "Use operator.attrgetter, itemgetter or the method itself.",
    "empty_class": "Remove the empty constructor.",
    "syntax_error": "Mend the syntax; the file's other checks wait for it.",
    "parse_failure": "Split or simplify the file so that it can be parsed.",
}


def advice(rule: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv]), rule)


def missing_init(files: DataFrame) -> DataFrame:
    """(path): Python files of a directory that has several of them and no __init__.py; an aggregate and a join."""
    python = files.where(F.col("ext") == ".py")
    dirs = python.groupBy("dir").agg(F.count("*").alias("n"), F.max((F.col("name") == "__init__.py").cast("int")).alias("init"))
    bare = dirs.where((F.col("n") > 1) & (F.col("init") == 0) & ~F.rlike("dir", F.lit(r"(^|/)\.[^/]*$")))
    return python.join(bare, "dir", "left_semi").select("path")
