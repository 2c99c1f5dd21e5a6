"""Nearest neighbours by a block matrix join with quantisation bounds.

Candidates and queries are packed into blocks of vectors; every block of queries meets every block of candidates. In
a tile both sides are quantised to int8 with a scale for each vector, and their product (integers, computed exactly)
approximates all inner products. With x = s q + e, the error is at most |e_x| |y| + |s_x q_x| |e_y|, from the norms
measured. A pair survives if its upper bound reaches the k-th best lower bound known for its query; survivors are
computed again from the original vectors in double precision, and a bounded heap of each query keeps the best. No
pair that belongs in the result can be lost, so recall is 1.

Queries are dealt into blocks of about `query_block` vectors, candidates into blocks that are dealt into strips of at
most `strip` vectors, as many as there are tasks to fill. A cell is one query block with one strip; a task works on one
cell at a time and holds its query block, its heaps and one block of candidates, so its memory depends on neither
table. The best of a query's cells are merged in two steps.

Cases: vectors that are null, zero, of another length than the queries', or hold null or non-finite components take
no part, as query or candidate; a query's own row (any row of its id) is no candidate; repeated ids stay candidates
as often as they occur; as queries they count once (the least vector); ties go to the smaller id; with fewer
candidates than k all are returned; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trim

TOP_K = 20
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 2048
STRIP = 1 << 17
#: Longest stretch of components whose int8 products add up exactly in single precision.
_EXACT = 1 << 24


def usable(vector: Column) -> Column:
    """Non-empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pack(size: int, kind: type):
    """Rows (id, v) of a task to blocks (dim, ids, vectors as bytes), each of one dimension and at most `size` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim):
            ids, vectors = held.pop(dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.concatenate(vectors).tobytes()])],
                names=["dim", "ids", "vectors"],
            )

        for batch in batches:
            ids, at, flat = batch.column(0), *_flat(batch.column(1), kind)
            for i, (k, dim) in enumerate(zip(ids.to_pylist(), np.diff(at).tolist(), strict=True)):
                own = held.setdefault(dim, ([], []))
                own[0].append(k)
                own[1].append(flat[at[i] : at[i] + dim])
                if len(own[0]) >= size:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)
        trim()

    return run


def _flat(lists: pa.ListArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Where lists start, and all their values."""
    return lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(kind)


def _one_block(kind: type):
    """A group of rows (dim, part, id, v) as one block."""

    def run(rows: pa.Table) -> pa.Table:
        vectors = b"".join(np.ascontiguousarray(_flat(c, kind)[1][c.offsets[0].as_py() : c.offsets[-1].as_py()]).tobytes() for c in rows.column("v").chunks)
        ids = rows.column("id").to_numpy().astype(np.int64).tobytes()
        return pa.table({"dim": rows.column("dim")[:1], "part": rows.column("part")[:1], "ids": [ids], "vectors": [vectors]})

    return run


class Block:
    def __init__(self, dim: int, ids: bytes, vectors: bytes, kind: type = np.float64):
        self.ids = np.frombuffer(ids, np.int64)
        self.exact = np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64)
        self.scale = np.abs(self.exact).max(axis=1) / 127
        self.int8 = np.rint(self.exact / self.scale[:, None]).astype(np.int8)
        shown = self.int8 * self.scale[:, None]
        slack = 1 + 1e-12
        self.error = np.linalg.norm(self.exact - shown, axis=1) * slack + 1e-300
        self.norm = np.linalg.norm(self.exact, axis=1) * slack
        self.shown_norm = np.linalg.norm(shown, axis=1) * slack

    def integer_product(self, other: Block) -> np.ndarray:
        """Exact products of int8 vectors, in double precision."""
        dim, step = self.int8.shape[1], _EXACT // (127 * 127)
        total = 0.0
        for a in range(0, dim, step):
            total = total + (self.int8[:, a : a + step].astype(np.float32) @ other.int8[:, a : a + step].astype(np.float32).T).astype(np.float64)
        return total


class Heaps:
    """The k best (score, smaller id first) of each query of a block."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.floor = np.full(len(queries.ids), -np.inf)

    def add(self, candidates: Block, rows: int = 512) -> None:
        q = self.queries
        for a in range(0, len(q.ids), rows):
            part = slice(a, a + rows)
            sub = Block.__new__(Block)
            sub.int8 = q.int8[part]
            near = sub.integer_product(candidates) * q.scale[part, None] * candidates.scale[None, :]
            bound = q.error[part, None] * candidates.norm[None, :] + q.shown_norm[part, None] * candidates.error[None, :]
            bound += 1e-9 * q.norm[part, None] * candidates.norm[None, :]
            own = q.ids[part, None] == candidates.ids[None, :]
            low = np.where(own, -np.inf, near - bound)
            if low.shape[1] > self.k:
                cut = np.partition(low, low.shape[1] - self.k, axis=1)[:, low.shape[1] - self.k]
                floor = np.maximum(self.floor[part], cut)
            else:
                floor = self.floor[part]
            i, j = np.nonzero((near + bound >= floor[:, None]) & ~own)
            for s in range(0, len(i), 1 << 16):
                si, sj = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                scores = np.einsum("ij,ij->i", q.exact[si + a], candidates.exact[sj])
                for x, score, c in zip((si + a).tolist(), scores.tolist(), candidates.ids[sj].tolist(), strict=True):
                    heap, item = self.heaps[x], (score, -c)
                    if len(heap) < self.k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
            for x in range(a, min(a + rows, len(q.ids))):
                if len(self.heaps[x]) == self.k:
                    self.floor[x] = self.heaps[x][0][0]


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP_K, query_block: int = QUERY_BLOCK, strip: int = STRIP) -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score): the k candidates of largest inner product for each query."""
    spark = vectors.sparkSession
    # single precision travels as it is; products are of doubles all the same
    single = all(df.schema[vector_col].dataType == T.ArrayType(T.FloatType(), True) for df in (vectors, queries))
    kind, element = (np.float32, "float") if single else (np.float64, "double")
    wanted = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked, offered = wanted(queries).groupBy("id").agg(F.min("v").alias("v")), wanted(vectors)
    n_queries, n_offered = wanted(queries).select("id").distinct().count(), offered.count()
    n_parts = max(1, -(-n_queries // query_block))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_strips = max(1, -(-n_offered // strip), min(-(-tasks // n_parts), -(-n_offered // CANDIDATE_BLOCK)))
    dealt = asked.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int").alias("part"), "id", "v")
    q = dealt.groupBy("dim", "part").applyInArrow(_one_block(kind), "dim int, part int, ids binary, vectors binary")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("dim", "part", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), each(n_strips).alias("strip"))
    c = offered.mapInArrow(_pack(CANDIDATE_BLOCK, kind), "dim int, ids binary, vectors binary")
    c = c.select("dim", each(n_parts).alias("part"), F.pmod(F.xxhash64("ids"), F.lit(n_strips)).cast("int").alias("strip"), "ids", "vectors")
    tiles = q.join(c, ["dim", "part", "strip"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                dim, part, strip, ids, data = (batch.column(x)[r].as_py() for x in (0, 1, 2, 5, 6))
                if (dim, part, strip) != cell:
                    if held is not None:
                        yield from _rows(held, cell[2])
                    cell, held = (dim, part, strip), Heaps(Block(dim, batch.column(3)[r].as_py(), batch.column(4)[r].as_py(), kind), k)
                held.add(Block(dim, ids, data, kind))
        if held is not None:
            yield from _rows(held, cell[2])
        held = None
        trim()

    columns = ["dim", "part", "strip", "q_ids", "q_vectors", "ids", "vectors"]
    found = tiles.select(columns).mapInArrow(best, "query_id long, strip int, near array<long>, scores array<double>")
    pairs = F.transform(F.arrays_zip("near", "scores"), lambda x: F.struct((-x["scores"]).alias("d"), x["near"].alias("vec_id")))
    least = F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("p")
    few = F.pmod(F.col("strip"), F.lit(max(1, math.isqrt(n_strips)))).alias("few")
    merged = found.select("query_id", few, pairs.alias("p")).groupBy("query_id", "few").agg(least).groupBy("query_id").agg(least)
    return merged.select("query_id", F.posexplode("p").alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.d")).alias("score")
    )


def _rows(held: Heaps, strip: int) -> Iterator[pa.RecordBatch]:
    """What a cell found for its queries."""
    rows = [(i, [-c for _, c in heap], [s for s, _ in heap]) for i, heap in zip(held.queries.ids.tolist(), held.heaps, strict=True) if heap]
    for a in range(0, len(rows), 1024):
        ids, near, scores = zip(*rows[a : a + 1024], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([strip] * len(ids), pa.int32()), pa.array(near, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))],
            names=["query_id", "strip", "near", "scores"],
        )
