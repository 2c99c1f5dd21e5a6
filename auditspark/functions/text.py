"""Column functions over text and lines."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ends a line: CR LF as one, and every other terminator alone.
LINE_END = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"


def lines(content: Column) -> Column:
    """The lines of a text; a terminator at its end begins no further line, and an empty text has none."""
    body = F.regexp_replace(content, f"(?:{LINE_END})\\z", "")
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(F.split(body, LINE_END, -1))


def explode_lines(files: DataFrame, keys: Sequence[str] = ("path",), content: str = "content") -> DataFrame:
    """(keys..., line from 1, text)."""
    return files.select(*keys, F.posexplode(lines(F.col(content))).alias("pos", "text")).select(*keys, (F.col("pos") + 1).alias("line"), "text")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def matches_any(text: Column, patterns: Sequence[str], flags: str = "") -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(text, F.lit(flags + p))
    return out


def first_match(text: Column, rules: Sequence[tuple[str, str]], flags: str = "") -> Column:
    """Name of the first pattern that is found, or null; later ones are not tried."""
    out = None
    for name, pattern in rules:
        hit = F.rlike(text, F.lit(flags + pattern))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def numbered(lines_: Column, start: Column | int = 1) -> Column:
    """Each line with its number in four places."""
    first = F.lit(start) if isinstance(start, int) else start
    return F.array_join(F.transform(lines_, lambda x, i: F.concat(F.lpad((i + first).cast("string"), 4, " "), F.lit("| "), x)), "\n")


def snippet(lines_: Column, line: Column, context: int = 1) -> Column:
    """The line with its neighbours, numbered in three places and marked; empty outside the text."""
    first = F.greatest(F.lit(1), line - context)
    part = F.slice(lines_, first, F.least(F.size(lines_), line + context) - first + 1)
    shown = F.transform(
        part,
        lambda x, i: F.concat(F.when(i + first == line, ">").otherwise(" "), F.lit(" "), F.lpad((i + first).cast("string"), 3, " "), F.lit("| "), x),
    )
    return F.when((line < 1) | (line > F.size(lines_)), F.lit("")).otherwise(F.array_join(shown, "\n"))


def shortened(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def quoted_key(title: Column) -> Column:
    """What stands between the first and the last apostrophe."""
    return F.regexp_extract(title, "(?s)'(.*)'", 1)


def display_path(path: Column, root: str) -> Column:
    prefix = F.lit(root.rstrip("/") + "/")
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def percent(share: Column) -> Column:
    return F.when(share == 0, F.lit("")).otherwise(F.format_string("%.1f%%", share * 100))


def placeholder_names(sql: Column) -> Column:
    """Distinct names in {name} and %(name), sorted."""
    both = F.concat(F.regexp_extract_all(sql, F.lit(r"\{(\w+)\}"), 1), F.regexp_extract_all(sql, F.lit(r"%\((\w+)\)"), 1))
    return F.array_sort(F.array_distinct(both))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))


# -- snippets whose extent depends on the code around ---------------------------------------------------------------


def _bounds_total(n: int, line: int, total: int) -> tuple[int, int]:
    before = 0 if total <= 2 else (total - 1) // 2
    return max(1, line - before), min(n, line + max(0, total - 1 - before))


def _bounds_code(rows: list[str], line: int) -> tuple[int, int]:
    """Definitions get room below, conditions reach to where their block ends, other lines their neighbours."""
    text, n = rows[line - 1], len(rows)
    body = text.strip()
    if body.startswith(("def ", "class ", "async def ", "try:", "except", "finally")):
        return max(1, line - 3), min(n, line + 5)
    if body.startswith(("if ", "elif ", "else:")):
        depth, end = len(text) - len(text.lstrip()), line
        while end < min(n, line + 8):
            after = rows[end]
            if after.strip() and len(after) - len(after.lstrip()) <= depth:
                break
            end += 1
        return max(1, line - 1), end
    if any(x in body for x in ("+", "-", "*", "/", "open(", "eval(", "exec(")):
        return max(1, line - 2), min(n, line + 3)
    return max(1, line - 1), min(n, line + 2)


def _bounds_comment(rows: list[str], line: int) -> tuple[int, int]:
    body, n = rows[line - 1].strip(), len(rows)
    for quote in ('"""', "'''"):
        if body.startswith(quote):
            end = line
            while quote not in (rows[end - 1].strip()[3:] if end == line else rows[end - 1]) and end < min(n, line + 4):
                end += 1
            return line, end
    return max(1, line - 1), min(n, line + 2)


def _render(rows: list[str], line: int, start: int, end: int, trim: bool) -> str:
    while trim and start < line and not rows[start - 1].strip():
        start += 1
    while trim and end > line and not rows[end - 1].strip():
        end -= 1
    return "\n".join(f"{'>' if i == line else ' '} {i:3d}| {rows[i - 1]}" for i in range(start, end + 1))


def sized_snippet(kind: str, size: int = 1):
    """A function of (content, line) columns; kind is total, code, comment or around."""

    @F.pandas_udf(T.StringType())
    def run(contents: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for content, number in zip(contents, numbers, strict=True):
            rows = (content or "").splitlines()
            line = int(number) if number == number and number is not None else 0
            if not 1 <= line <= len(rows):
                out.append("")
                continue
            if kind == "total":
                bounds = _bounds_total(len(rows), line, size)
            elif kind == "code":
                bounds = _bounds_code(rows, line)
            elif kind == "comment":
                bounds = _bounds_comment(rows, line)
            else:
                bounds = (max(1, line - size), min(len(rows), line + size))
            out.append(_render(rows, line, *bounds, trim=kind in ("total", "around")))
        return pd.Series(out, dtype=object)

    return run
