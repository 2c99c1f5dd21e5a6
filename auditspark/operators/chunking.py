"""Chunks of files that fit a limit of lines: fixed windows, blocks packed whole, and small files stacked."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import explode_lines, lines

BLOCK = "path string, start_line int, end_line int, block_type string, name string"


def line_chunks(files: DataFrame, max_lines: int) -> DataFrame:
    """(path, chunk from 0, start_line, end_line, content): consecutive windows, cut out of the array of lines."""
    rows = files.select("path", lines(F.col("content")).alias("l"))
    starts = F.when(F.size("l") > 0, F.sequence(F.lit(0), F.size("l") - 1, F.lit(max_lines))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("path", "l", F.posexplode(starts).alias("chunk", "s"))
    part = F.slice("l", F.col("s") + 1, F.lit(max_lines))
    return rows.select("path", "chunk", (F.col("s") + 1).alias("start_line"), (F.col("s") + F.size(part)).alias("end_line"), F.array_join(part, "\n").alias("content"))


def packed(sizes: Column, limit: Column | int) -> Column:
    """Chunk numbers (from 0) of an array of sizes packed greedily in order; an item is never split.

    A chunk closes when it holds something and the next item would exceed the limit. One step for each item: a fold of
    columns would copy the numbers so far at every step.
    """
    return _pack_numbers(F.transform(sizes, lambda n: n.cast("long")), (F.lit(limit) if isinstance(limit, int) else limit).cast("long"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _pack_numbers(sizes: pd.Series, limits: pd.Series) -> pd.Series:
    out = []
    for items, limit in zip(sizes, limits, strict=True):
        held = chunk = 0
        numbers = []
        for n in items if items is not None else ():
            if held > 0 and held + n > limit:
                held, chunk = 0, chunk + 1
            held += n
            numbers.append(chunk)
        out.append(numbers if items is not None else None)
    return pd.Series(out, dtype=object)


def pack_blocks(blocks: DataFrame, max_lines: int) -> DataFrame:
    """blocks (path, start_line, end_line, ...) with the chunk of each; blocks of one file are folded in order."""
    entry = F.struct("start_line", "end_line", "block_type", "name")
    per = blocks.groupBy("path").agg(F.array_sort(F.collect_list(entry)).alias("b"))
    sizes = F.transform("b", lambda x: x["end_line"] - x["start_line"] + 1)
    both = per.select("path", F.explode(F.arrays_zip("b", packed(sizes, max_lines).alias("c"))).alias("z"))
    return both.select("path", F.col("z.c").alias("chunk"), "z.b.*")


def find_blocks(content: str) -> list[tuple[int, int, str, str | None]]:
    """Top-level functions and classes, and runs of other code between them; none if the text does not parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function", ast.ClassDef: "class"}
    found = [(n.lineno, n.end_lineno or n.lineno, kinds[type(n)], n.name) for n in tree.body if type(n) in kinds]
    covered = {i for s, e, _, _ in found for i in range(s, e + 1)}
    rows, start = content.splitlines(), None
    for i in range(1, len(rows) + 2):
        inside = i <= len(rows) and i not in covered
        if inside and start is None and rows[i - 1].strip() and not rows[i - 1].strip().startswith("#"):
            start = i
        elif not inside and start is not None:
            found.append((start, i - 1, "module_code", None))
            start = None
    return sorted(found, key=lambda b: b[:2])


def blocks(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *b) for p, c in zip(batch["path"], batch["content"], strict=True) for b in find_blocks(c or "")]
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "block_type", "name"])

    return files.select("path", "content").mapInPandas(run, BLOCK)


def file_chunks(files: DataFrame, max_lines: int, reach: int = 10) -> DataFrame:
    """(path, chunk, start_line, end_line, content): whole file, packed blocks, or windows where there are no blocks.

    Where the nearest line of code above a chunk's first block is one of the file's first `reach`, the chunk begins at
    line 1.
    """
    rows = files.withColumn("n", F.size(lines(F.col("content"))))
    small = rows.where(F.col("n") <= max_lines).select("path", F.lit(0).alias("chunk"), F.lit(1).alias("start_line"), F.col("n").alias("end_line"), "content")
    large = rows.where(F.col("n") > max_lines)
    placed = pack_blocks(blocks(large), max_lines).groupBy("path", "chunk").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    cut = placed.join(large.select("path", lines(F.col("content")).alias("l")), "path")
    above = F.slice("l", 1, F.col("start_line") - 1)
    is_code = lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#"))
    # code within reach, and none between it and the chunk
    near = F.exists(F.slice(above, 1, reach), is_code) & ~F.exists(F.slice(above, reach + 1, F.greatest(F.size(above) - reach, F.lit(0))), is_code)
    cut = cut.withColumn("start_line", F.when(near, 1).otherwise(F.col("start_line")))
    cut = cut.select("path", "chunk", "start_line", "end_line", F.array_join(F.slice("l", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("content"))
    bare = large.join(placed.select("path").distinct(), "path", "left_anti")
    return small.unionByName(cut).unionByName(line_chunks(bare, max_lines))


def stack_files(files: DataFrame, max_lines: int, threshold: float, group: str | None = None) -> DataFrame:
    """(stack_group, stack, members, n_lines, content, line_map) of small files packed in path order.

    A file above max_lines closes the stack before it and is left to file_chunks. Stacks are packed within `group`
    (the directory if not given), so that no single task sees all files. line_map tells for each line of the content
    which file and line it shows.
    """
    key = F.col(group) if group else F.col("dir")
    rows = files.withColumn("n", F.size(lines(F.col("content"))))
    per = rows.groupBy(key.alias("stack_group")).agg(F.array_sort(F.collect_list(F.struct("path", "n"))).alias("f"))
    limit = int(max_lines * threshold)
    # a large file counts as one over the limit, so it stands alone; packing sees sizes only, contents join it after
    numbers = packed(F.transform("f", lambda x: F.when(x["n"] > max_lines, F.lit(limit + 1)).otherwise(F.greatest(x["n"], F.lit(0)))), limit)
    each = per.select("stack_group", F.explode(F.arrays_zip("f", numbers.alias("s"))).alias("z")).select("stack_group", F.col("z.s").alias("stack"), F.col("z.f.path").alias("path"))
    members = each.join(rows.where(F.col("n") <= max_lines).select("path", "name", "n", "content"), "path")
    stacks = members.groupBy("stack_group", "stack").agg(F.array_sort(F.collect_list(F.struct("path", "name", "n", "content"))).alias("m"))
    many = F.size("m") > 1
    part = lambda x: F.concat(F.lit("# === FILE: "), x["name"], F.lit(" ===\n"), x["content"])
    content = F.when(many, F.array_join(F.transform("m", part), "\n\n")).otherwise(F.element_at("m", 1)["content"])
    place = "array<struct<path:string,line:int>>"
    body = lambda x: F.transform(lines(x["content"]), lambda _, i: F.struct(x["path"].alias("path"), (i + 1).alias("line")))
    head = lambda x: F.array(F.struct(x["path"].alias("path"), F.lit(0).alias("line")))
    gap = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(0).alias("line")))
    mapped = F.when(many, F.flatten(F.transform("m", lambda x, i: F.concat(F.when(i > 0, gap).otherwise(F.array().cast(place)), head(x), body(x))))).otherwise(body(F.element_at("m", 1)))
    return stacks.select(
        "stack_group", "stack", F.transform("m", lambda x: x["path"]).alias("members"),
        F.aggregate("m", F.lit(0), lambda a, x: a + x["n"]).alias("n_lines"), content.alias("content"), mapped.alias("line_map"),
    )
