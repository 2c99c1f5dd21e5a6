"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts.

Groups are taken from the heaviest down; each enters the open shard with the least remaining capacity that still
holds it. Open shards lie in a balanced tree ordered by remaining capacity. Groups of one weight are alike, so the
packing runs over the histogram of weights: after a group enters the tightest shard that fits, that shard stays the
tightest, so as many of the weight as fit go there at once. Weights are rounded up to `DIGITS` binary digits (by less
than one part in 2,000), so the histogram has at most 2,048 entries for each power of two, below 100,000 at any size; it
and the plan are all the driver sees. Which group of a weight goes where follows from its rank among them, counted in
Spark from partial counts over salts, of which there are more the more groups there are.

With a fixed number of shards the capacity is the least (within one part in `PRECISION`) at which all rounded groups
fit: near-equal bytes. Without it, the number of shards of a given capacity is what is minimised.

Cases: a null text counts as empty and shares the group of empty texts; repeated rows of one id are rows of their
own; a group heavier than an even share sets the capacity; more shards than groups leave shards empty; an empty table
gives an empty table; columns of the input other than id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PRECISION = 1 << 20
DIGITS = 12
#: Rows or groups that one task numbers in one go, about, and the least number of such runs.
ROWS_PER_RUN = 20_000
LEAST_RUNS = 64


class CapacityTree:
    """Open shards as (remaining capacity, shard) in a treap: insertion, removal and next larger in O(log n)."""

    def __init__(self):
        self.root, self.state = None, 88_172_645_463_325_252

    def _priority(self) -> int:
        x = self.state
        x ^= x << 13 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= x << 17 & 0xFFFFFFFFFFFFFFFF
        self.state = x
        return x

    @staticmethod
    def _split(node, key):
        """(nodes below key, the rest)."""
        path = []
        while node is not None:
            below = node[0] < key
            path.append((node, below))
            node = node[3] if below else node[2]
        low = high = None
        for n, below in reversed(path):
            if below:
                n[3], low = low, n
            else:
                n[2], high = high, n
        return low, high

    @staticmethod
    def _merge(a, b):
        top = [None, 0, None, None]
        at, side = top, 2
        while a is not None and b is not None:
            if a[1] > b[1]:
                at[side], at, side, a = a, a, 3, a[3]
            else:
                at[side], at, side, b = b, b, 2, b[2]
        at[side] = a if a is not None else b
        return top[2]

    def add(self, remaining: int, shard: int) -> None:
        low, high = self._split(self.root, (remaining, shard))
        self.root = self._merge(self._merge(low, [(remaining, shard), self._priority(), None, None]), high)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the shard with the least remaining capacity of at least need; ties to the smaller shard."""
        low, high = self._split(self.root, (need, -1))
        found, node = None, high
        while node is not None:
            found, node = node, node[2]
        if found is not None:
            key = found[0]
            _, rest = self._split(high, (key[0], key[1] + 1))
            high = rest
        self.root = self._merge(low, high)
        return found[0] if found is not None else None


def pack(histogram: list[tuple[int, int]], capacity: int, shards: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best fit of (weight, count) pairs: runs (weight, shard, count) in the order placed.

    With `shards`, all of them are open from the start and None is returned if something does not fit; without, a
    new shard is opened whenever nothing fits (a weight above the capacity is an error).
    """
    tree, runs, opened = CapacityTree(), [], shards or 0
    for s in range(opened):
        tree.add(capacity, s)
    for weight, count in sorted(histogram, reverse=True):
        while count:
            got = tree.take(weight)
            if got is None:
                if shards is not None:
                    return None
                if weight > capacity:
                    raise ValueError(f"a group of weight {weight} exceeds the capacity {capacity}")
                got, opened = (capacity, opened), opened + 1
            n = min(count, got[0] // weight)
            runs.append((weight, got[1], n))
            tree.add(got[0] - n * weight, got[1])
            count -= n
    return runs


def least_capacity(histogram: list[tuple[int, int]], shards: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The least capacity tried at which everything fits in `shards`, and the packing."""
    total = sum(w * c for w, c in histogram)
    low = max(-(-total // shards), max((w for w, _ in histogram), default=1))
    if (runs := pack(histogram, low, shards)) is not None:
        return low, runs
    step = max(1, low // PRECISION)
    good, best = step, None
    while (best := pack(histogram, low + good, shards)) is None:
        good *= 2
    bad = good // 2
    while good - bad > step:
        mid = (good + bad) // 2
        if (runs := pack(histogram, low + mid, shards)) is None:
            bad = mid
        else:
            good, best = mid, runs
    return low + good, best


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size (UTF-8 bytes plus 1), text_crc32 (unsigned), and the key of its text's group."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("grp"),
    )


def rounded(weight: Column) -> Column:
    """The weight, rounded up to a number of at most DIGITS binary digits and zeros."""
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(weight)) - DIGITS)).cast("long")
    return weight + F.pmod(-weight, unit)


def assign_shards(docs: DataFrame, shards: int | None = 8, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    Give `shards` for near-equal shards, or `capacity` (in bytes) for the fewest shards of that capacity.
    """
    spark = docs.sparkSession
    rows = cut(measured(docs, id_col, text_col))
    weight = F.col("weight")
    up = rounded(weight) if capacity is None else F.when(weight <= capacity, F.least(rounded(weight), F.lit(capacity))).otherwise(weight)
    groups = cut(rows.groupBy("grp").agg(F.sum("size").alias("weight")).withColumn("weight", up))
    histogram = [(r["weight"], r["n"]) for r in groups.groupBy("weight").agg(F.count("*").alias("n")).toLocalIterator()]
    runs = least_capacity(histogram, shards)[1] if capacity is None else pack(histogram, capacity)
    done: dict[int, int] = {}
    plan = []
    for weight, shard, n in runs:
        first = done.get(weight, 0)
        plan.append((weight, first, first + n, shard))
        done[weight] = first + n
    plan_df = spark.createDataFrame(plan, "weight long, first long, stop long, shard int")

    salts = max(LEAST_RUNS, math.ceil(sum(n for _, n in histogram) / ROWS_PER_RUN))
    salted = groups.withColumn("salt", F.pmod(F.xxhash64("grp"), F.lit(salts)))
    counts = salted.groupBy("weight", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("weight").orderBy("salt")) - F.col("n")).drop("n")
    within = salted.withColumn("at", F.row_number().over(Window.partitionBy("weight", "salt").orderBy("grp")) - 1)
    ranked = within.join(before, ["weight", "salt"]).withColumn("rank", F.col("at") + F.col("base"))
    placed = ranked.join(plan_df, "weight").where("rank >= first AND rank < stop").select("grp", "shard")

    sharded = cut(rows.join(placed, "grp").drop("grp"))
    n_rows = sharded.count()
    parts = max(LEAST_RUNS, math.ceil(n_rows / ROWS_PER_RUN))
    dealt = sharded.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    held = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offsets = held.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    numbered = dealt.withColumn("at", F.row_number().over(order) - 1).join(offsets, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("base")).cast("long").alias("slot"))
