"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts with equal shingle sets are one class; the join runs over classes and finds all links between them that are
needed for their connected components.

A pair with Jaccard similarity t or more misses at most n - ceil(t n) of either side's n shingles. So if shingles are
put in one order (of their fingerprints), the prefixes of n - ceil(t n) + m shingles share at least m (the smaller m
of the two). Every class begins with m = 1. The postings of a prefix shingle are expanded to candidates only if the
list is cheap; what a class would have to pay in lists that are not is its estimated candidate cost. A class with at
least as many costly shingles in its prefix as the m its partners need to match gets a longer prefix and a larger m
(a quarter, then three quarters of n) and goes through the next round with the others like it; a class with fewer is
settled, because one of the m shared shingles then lies in an expanded list. Classes that are costly to the end (all
their shingles are everywhere) meet in blocks of similar size: bit signatures bound the overlap, and only pairs that
may reach t come out.

Before that, classes that share a minimum of one of six random orders are compared with one centre for each minimum.
This links most groups of near copies with as many comparisons as they have members, and pairs that are already
connected are not expanded again. Candidates pass a bound from bit signatures; what is left is verified on the exact
sets. Nothing is capped or dropped.

Shingles are told apart by 64-bit fingerprints of word hashes, sets by 128 bits over their fingerprints.

Cases: null, empty and wordless texts have the empty set and link with nothing; a text of fewer words than a shingle is
one shingle; at a threshold of 100 only equal sets link; copies and repeated rows are one class and share its component; null ids stay, and are a component's
smallest id only if it has no other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, slices, small_batches, trim
from .components import components
from .shingles import SHINGLE_WORDS, Shingler, bitmap, fold, mix, most_shared

THRESHOLD = 75  # of 100
ORDERS = 6
#: A list is costly with more than so many components, or more pairs between components than so many for each posting.
LIST_COMPONENTS = 32
LIST_PAIRS = 64
#: Shares of n by which m grows from round to round.
ROUNDS = (0.0, 0.25, 0.75)
POSTINGS_PER_BUCKET = 500_000
FLUSH = 1_000_000
BLOCK_BYTES = 1 << 20
#: Ids of texts to verify are broadcast up to so many (16 bytes each), else they meet the texts in a shuffle.
BROADCAST_ROWS = 50_000
_SEEDS = mix(np.arange(1, ORDERS + 1, dtype=np.uint64))
_SIDES = mix(np.array([101, 102], np.uint64))


def _required(n, t: int):
    """ceil(t n / 100)."""
    return (t * n + 99) // 100


def _set_key(fingerprints: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: sums over two mixings of its fingerprints, each mixed with the set's size."""
    sums = [np.add.reduce(mix(fingerprints ^ s), dtype=np.uint64) for s in _SIDES]
    return tuple(mix(np.array(sums, np.uint64) + np.uint64(len(fingerprints))).view(np.int64).tolist())


def summarise(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Per row: id, n (shingles), ka and kb (the set's key), mins (in each random order), bits (signature), sha (of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                sets = shingler.sets(texts)
                some = [s for s in sets if len(s)]
                flat = np.concatenate(some) if some else np.empty(0, np.uint64)
                at = np.cumsum([0, *map(len, some)])[:-1]
                mins = np.stack([np.minimum.reduceat(mix(flat ^ s), at) for s in _SEEDS], axis=1).view(np.int64).tolist() if some else []
                where = iter(mins)
                keys = [_set_key(s) if len(s) else (0, 0) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([a for a, _ in keys], pa.int64()),
                        pa.array([b for _, b in keys], pa.int64()),
                        pa.array([next(where) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        pa.array([bitmap(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                        pa.array([text_sha(t) for t in texts], pa.binary()),
                    ],
                    names=["id", "n", "ka", "kb", "mins", "bits", "sha"],
                )
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, ka long, kb long, mins array<long>, bits binary, sha binary")


def text_sha(text: str | None) -> bytes | None:
    """As Spark's sha2(text, 256), in bytes."""
    return None if text is None else sha256(text.encode("utf-8", "surrogatepass")).digest()


def _centre_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): each class with the centre of each of its minima."""
    each = classes.select("key", "n", F.posexplode("mins").alias("o", "m"))
    rank = F.xxhash64("key", "o")
    centre = each.groupBy("o", "m").agg(F.min(F.struct(rank.alias("r"), F.col("key").alias("c"))).alias("s"), F.count("*").alias("k")).where("k > 1")
    met = each.join(centre.select("o", "m", F.col("s.c").alias("c")), ["o", "m"]).where("key <> c")
    return met.select(F.least("key", "c").alias("a"), F.greatest("key", "c").alias("b")).distinct()


def _may_link(pairs: DataFrame, classes: DataFrame, t: int) -> DataFrame:
    """Pairs whose sizes and signatures allow the threshold."""
    side = classes.select("key", "n", "bits")
    left = pairs.join(side.toDF("a", "n_a", "bits_a"), "a")
    both = left.join(side.toDF("b", "n_b", "bits_b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, x, y = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for i in range(len(a)):
                most = most_shared(n_a[i], np.frombuffer(x[i], np.uint64), n_b[i], np.frombuffer(y[i], np.uint64))
                keep.append(100 * most >= t * (n_a[i] + n_b[i] - most))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _among(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows whose id is the first of one of the classes; all rows if these are too many to send out.

    classes must be materialised: they are counted, and broadcast only up to BROADCAST_ROWS ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if classes.count() > BROADCAST_ROWS:
        return rows
    wanted = F.broadcast(classes.select(F.col("id").alias("first")).distinct())
    return rows.join(wanted, rows["id"].eqNullSafe(wanted["first"]), "left_semi")


def _matched(rows: DataFrame, classes: DataFrame, extra: list[str]) -> DataFrame:
    """(key, s, ...) of the rows (id, ka, kb, s) that stand for their class, those of its smallest id."""
    wanted = classes.select("key", F.col("ka").alias("wa"), F.col("kb").alias("wb"), F.col("id").alias("first"), *extra)
    same = (rows["ka"] == wanted["wa"]) & (rows["kb"] == wanted["wb"]) & rows["id"].eqNullSafe(wanted["first"])
    # in a shuffle however few they are: what follows runs Python too, and a task should have one worker
    return rows.join(wanted.hint("merge"), same).select("key", "s", *extra)


def _hashed(rows: DataFrame, words: int, t: int, share: float | None) -> DataFrame:
    """(id, ka, kb, s): fingerprints of each text as bytes; all of 64 bits, or with `share` the prefix's upper 48 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part, found in slices(batch, "text"):
                ids, keys, data = part.column(0).to_pylist(), [], []
                own = []
                for k, s in zip(ids, shingler.sets(found), strict=True):
                    if n := len(s):
                        own.append(k)
                        keys.append(_set_key(s))
                        if share is None:
                            data.append(s.tobytes())
                        else:
                            p = min(n, n - int(_required(n, t)) + int(_matches(np.array([n]), share, t)[0]))
                            data.append((s[:p] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                both = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *both, pa.array(data, pa.binary())], names=["id", "ka", "kb", "s"])
        trim()

    return rows.mapInArrow(run, "id long, ka long, kb long, s binary")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int, t: int) -> DataFrame:
    """The pairs that reach the threshold, from the exact sets."""
    needed = cut(classes.join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key").select("key", "ka", "kb", "id"))
    sets = _matched(_hashed(_among(docs, needed, id_col, text_col), words, t, None), needed, []).dropDuplicates(["key"])
    # the side that is a centre of many comes last, as one row that a split join can repeat
    loads = pairs.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("load"))
    weighed = pairs.join(loads.toDF("a", "load_a"), "a").join(loads.toDF("b", "load_b"), "b")
    swap = F.col("load_a") > F.col("load_b")
    turned = weighed.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("y"))
    joined = turned.join(sets.toDF("x", "s_x"), "x").join(sets.toDF("y", "s_y"), "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= t * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("x", "y", "s_x", "s_y").mapInArrow(compare, "u long, v long")


def _matches(n: np.ndarray, share: float, t: int) -> np.ndarray:
    """m of a class of n shingles in a round."""
    return np.maximum(1, np.ceil(share * n).astype(np.int64))


def _postings(prefixes: DataFrame, buckets: int) -> DataFrame:
    """Packed postings (bucket, kind, tokens, owners, table) of prefixes (key, component, n, s).

    kind 0: 48-bit tokens, their owners as indexes into a table (key, component, n). kind 1: in `table`, keys and the
    number of their shingles already known to be costly (in this task's own lists).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners, count = [], [], 0
        for batch in batches:
            for key, comp, n, s in zip(*(batch.column(i) for i in range(4)), strict=True):
                held.append(_wide(s.as_buffer()))
                owners.append((key.as_py(), comp.as_py(), n.as_py()))
                count += len(held[-1])
                if count >= FLUSH:
                    yield from _packed(held, owners, buckets)
                    held, owners, count = [], [], 0
        if held:
            yield from _packed(held, owners, buckets)
        held = owners = None
        trim()

    return prefixes.select("key", "component", "n", "s").mapInArrow(run, "bucket int, kind int, tokens binary, owners binary, table binary")


def _wide(buffer) -> np.ndarray:
    """48-bit numbers from six bytes each."""
    raw = np.frombuffer(buffer, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).ravel()


def _packed(held: list[np.ndarray], owners: list[tuple[int, int, int]], buckets: int) -> Iterator[pa.RecordBatch]:
    table = np.array(owners, np.int64)
    tokens = np.concatenate(held)
    who = np.repeat(np.arange(len(held), dtype=np.uint32), [len(h) for h in held])
    # a list that is costly here alone sends on just what proves it
    order = np.argsort(tokens, kind="stable")
    tokens, who = tokens[order], who[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    sizes = np.diff(np.append(first, len(tokens)))
    hot, keep = np.zeros(len(held), np.int64), np.ones(len(tokens), bool)
    for s, c in zip(first[sizes > 4 * LIST_COMPONENTS].tolist(), sizes[sizes > 4 * LIST_COMPONENTS].tolist(), strict=True):
        mine = who[s : s + c]
        _, one = np.unique(table[mine, 1], return_index=True)
        if len(one) > LIST_COMPONENTS:
            keep[s : s + c] = False
            keep[s + one[: LIST_COMPONENTS + 1]] = True
            np.add.at(hot, np.delete(mine, one[: LIST_COMPONENTS + 1]), 1)
    tokens, who = tokens[keep], who[keep]
    bucket = (mix(tokens) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(edges)).tolist():
        mine = order[edges[b] : edges[b + 1]]
        used, index = np.unique(who[mine], return_inverse=True)
        raw = tokens[mine].view(np.uint8).reshape(-1, 8)[:, :6]
        rows.append((b, 0, raw.tobytes(), index.astype(np.uint32).tobytes(), table[used].tobytes()))
    if hot.any():
        some = np.flatnonzero(hot)
        rows.append((int(table[some[0], 0]) % buckets, 1, b"", b"", np.stack((table[some, 0], hot[some]), axis=1).tobytes()))
    for a in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, x) for c, x in zip(zip(*rows[a : a + 64], strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
            names=["bucket", "kind", "tokens", "owners", "table"],
        )


def _expand(t: int):
    """Of one bucket: (0, a, b) for candidate pairs between components, (1, key, number of costly shingles)."""

    def run(rows: pa.Table) -> pa.Table:
        tokens, who, tables, base, hot_rows = [], [], [], 0, []
        for r in rows.to_batches():
            for kind, tok, own, table in zip(*(r.column(i) for i in range(1, 5)), strict=True):
                data = np.frombuffer(table.as_buffer(), np.int64)
                if kind.as_py():
                    hot_rows.append(data.reshape(-1, 2))
                    continue
                tokens.append(_wide(tok.as_buffer()))
                who.append(np.frombuffer(own.as_buffer(), np.uint32).astype(np.int64) + base)
                tables.append(data.reshape(-1, 3))
                base += len(tables[-1])
        a = b = np.empty(0, np.int64)
        if tokens:
            token, owner, table = np.concatenate(tokens), np.concatenate(who), np.concatenate(tables)
            # one number for each class, whatever blobs it came in
            keys, number = np.unique(table[:, 0], return_inverse=True)
            comp, n = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
            comp[number], n[number] = table[:, 1], table[:, 2]
            owner = number[owner]
            order = np.lexsort((owner, token))
            token, owner = token[order], owner[order]
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])))
            token, owner = token[new], owner[new]
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size = np.diff(np.append(first, len(token)))
            hot, left, right = np.zeros(len(keys), np.int64), [], []
            for s, c in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                mine = owner[s : s + c]
                kinds, counts = np.unique(comp[mine], return_counts=True)
                if len(kinds) < 2:
                    continue
                cross = (c * c - int((counts * counts).sum())) // 2
                if len(kinds) > LIST_COMPONENTS or cross > LIST_PAIRS * c:
                    hot[mine] += 1
                    continue
                by = mine[np.argsort(comp[mine], kind="stable")]
                ends = np.cumsum(counts)
                for k in range(len(kinds) - 1):
                    x, y = by[ends[k] - counts[k] : ends[k]], by[ends[k] :]
                    left.append(np.repeat(x, len(y)))
                    right.append(np.tile(y, len(x)))
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                fits = 100 * np.minimum(n[x], n[y]) >= t * np.maximum(n[x], n[y])
                x, y = x[fits], y[fits]
                code = np.unique(np.minimum(x, y) * len(keys) + np.maximum(x, y))
                a, b = keys[code // len(keys)], keys[code % len(keys)]
            some = np.flatnonzero(hot)
            hot_rows.append(np.stack((keys[some], hot[some]), axis=1))
        hots = np.concatenate(hot_rows) if hot_rows else np.empty((0, 2), np.int64)
        kind = np.concatenate((np.zeros(len(a), np.int32), np.ones(len(hots), np.int32)))
        return pa.table({"kind": kind, "a": np.concatenate((a, hots[:, 0])), "b": np.concatenate((b, hots[:, 1]))})

    def trimmed(rows: pa.Table) -> pa.Table:
        out = run(rows)
        trim(cycles=False)
        return out

    return trimmed


def _block_links(classes: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """(u, v): links between components among classes (key, component, n, bits), enough to connect what is connected.

    Blocks of about BLOCK_BYTES of sets meet within and between neighbouring bands of size. In a pair of blocks the
    signatures bound the overlap, pairs that may link are compared exactly, and pairs that are connected already, in
    this task or before, are left out; only links come out.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / t)).cast("int")
    rows = cut(classes.join(sets, "key").select("key", "component", "n", "bits", "s").withColumn("band", band))
    # bands grow by a constant factor, so there are some eighty of them for any size
    chunks = {r["band"]: r["chunks"] for r in rows.groupBy("band").agg(F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("int").alias("chunks")).collect()}
    if not chunks:
        return rows.select(F.col("key").alias("u"), F.col("key").alias("v")).limit(0)
    of_band = F.create_map(*[F.lit(x) for kv in chunks.items() for x in kv])
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), of_band[F.col("band")]).cast("int"))

    def pack(rows: pa.Table) -> pa.Table:
        meta = np.stack([rows.column(c).to_numpy() for c in ("key", "component", "n")], axis=1)
        bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("bits")]
        folded = np.stack([fold(x, min(map(len, bits))) for x in bits])
        flat = b"".join(rows.column("s").to_pylist())
        return pa.table({"band": rows.column("band")[:1], "chunk": rows.column("chunk")[:1], "meta": [meta.tobytes()], "bits": [folded.tobytes()], "sets": [flat]})

    packed = cut(dealt.groupBy("band", "chunk").applyInArrow(pack, "band int, chunk int, meta binary, bits binary, sets binary"))
    # a class and its partners lie in one band or in neighbouring ones (rounding is covered by a second neighbour)
    left = packed.select("band", "chunk").withColumn("band_2", F.explode(F.array("band", F.col("band") + 1, F.col("band") + 2)))
    places = left.join(packed.select(F.col("band").alias("band_2"), F.col("chunk").alias("chunk_2")), "band_2").where("band_2 > band OR chunk_2 >= chunk")
    met = places.join(packed, ["band", "chunk"]).join(packed.toDF("band_2", "chunk_2", "meta_2", "bits_2", "sets_2"), ["band_2", "chunk_2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                sides = [[np.frombuffer(batch.column(3 * side + i)[r].as_buffer(), d) for i, d in enumerate((np.int64, np.uint64, np.uint64))] for side in (0, 1)]
                links = _links_of_blocks(sides[0], sides[1], t)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["u", "v"])

    return met.select("meta", "bits", "sets", "meta_2", "bits_2", "sets_2").mapInArrow(run, "u long, v long")


def _links_of_blocks(left: list[np.ndarray], right: list[np.ndarray], t: int) -> list[tuple[int, int]]:
    """Links (key, key) that join components of the two blocks' classes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    meta, meta_2 = left[0].reshape(-1, 3), right[0].reshape(-1, 3)
    x, y = left[1].reshape(len(meta), -1), right[1].reshape(len(meta_2), -1)
    words = min(x.shape[1], y.shape[1])
    x, y = (np.bitwise_or.reduce(z.reshape(len(z), -1, words), axis=1) for z in (x, y))
    at, at_2 = (np.concatenate(([0], np.cumsum(m[:, 2]))) for m in (meta, meta_2))
    n_y, out = meta_2[:, 2], []
    for k, (key, comp, n) in enumerate(meta.tolist()):
        ok = (meta_2[:, 1] != comp) & (100 * np.minimum(n, n_y) >= t * np.maximum(n, n_y))
        j = np.flatnonzero(ok)
        most = np.minimum(n - np.bitwise_count(x[k] & ~y[j]).sum(axis=1, dtype=np.int64), n_y[j] - np.bitwise_count(~x[k] & y[j]).sum(axis=1, dtype=np.int64))
        mine = left[2][at[k] : at[k + 1]]
        for b in j[100 * most >= t * (n + n_y[j] - most)].tolist():
            other = find(int(meta_2[b, 1]))
            if other == find(comp):
                continue
            theirs = right[2][at_2[b] : at_2[b + 1]]
            # both sorted: what is found at its place is shared
            place = np.minimum(np.searchsorted(mine, theirs), n - 1)
            both = int((mine[place] == theirs).sum())
            if 100 * both >= t * (n + len(theirs) - both):
                out.append((key, int(meta_2[b, 0])))
                parent[other] = find(comp)
    return out


def linked_classes(docs: DataFrame, id_col: str, text_col: str, threshold: int, words: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): per row id, n, ka, kb and sha; per set of shingles key, ka, kb, first and component.

    `first` is the least row of a class (z: its id is null; id; sha), `component` the key of one class of those linked.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parallel = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    summary = cut(summarise(docs, id_col, text_col, words))
    lone = F.col("id").isNull().alias("z")
    first = F.min(F.struct(lone, "id", "sha", "n", "mins", "bits")).alias("s")
    classes = summary.where("n > 0").groupBy("ka", "kb").agg(first)
    # numbers that no two classes share; they hold once they are written
    classes = cut(classes.select(F.monotonically_increasing_id().alias("key"), "ka", "kb", "s.z", "s.id", "s.sha", "s.n", "s.mins", "s.bits"))
    # signatures are needed for some steps only; what stays to the end goes without them
    rows, thin = cut(summary.select("id", "n", "ka", "kb", "sha")), cut(classes.select("key", "ka", "kb", "z", "id", "sha"))
    del summary
    bare = thin.select("key", "ka", "kb", F.struct("z", "id", "sha").alias("first"))
    if threshold >= 100:  # only equal sets link
        return rows, bare.withColumn("component", F.col("key"))

    where = (docs, thin, id_col, text_col, words, threshold)
    links = [cut(_verified(cut(_may_link(_centre_pairs(classes), classes, threshold)), *where))]
    release(spark)
    grouped = components(links[0])
    side = classes.select("key", "ka", "kb", "id", "n", "bits")
    labelled = cut(side.join(grouped.withColumnRenamed("v", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")))
    del grouped, side, classes
    release(spark)

    active, found = labelled.drop("bits"), []
    for share in ROUNDS:
        matches = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n")))
        total = active.agg(F.sum(F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * threshold / 100) + matches))).first()[0]
        if not total:
            break
        buckets = max(parallel, -(-int(total) // POSTINGS_PER_BUCKET))
        # prefixes, not texts, meet the classes in a shuffle
        hashed = _hashed(_among(docs, active, id_col, text_col), words, threshold, share)
        posted = _postings(_matched(hashed, active, ["component", "n"]), buckets).repartition(buckets, "bucket")
        out = cut(posted.groupBy("bucket").applyInArrow(_expand(threshold), "kind int, a long, b long"))
        del hashed, posted  # what these frames shuffled can go
        found.append(out.where("kind = 0").select("a", "b"))
        costly = out.where("kind = 1").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("costly"))
        # the least m of any partner, whose size may be threshold / 100 of this one's
        least = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.ceil(F.col("n") * threshold / 100)))
        active = cut(active.join(costly, "key").where(F.col("costly") >= least).drop("costly"))
        del costly
        release(spark)
    if not active.isEmpty():
        sets = _matched(_hashed(_among(docs, active, id_col, text_col), words, threshold, None), active, []).dropDuplicates(["key"])
        links.append(cut(_block_links(labelled.join(active.select("key"), "key", "left_semi"), sets, threshold)))
        del sets
    if found:
        pairs = reduce(DataFrame.unionByName, found).distinct()
        links.append(cut(_verified(cut(_may_link(pairs, labelled, threshold)), *where)))
        release(spark)
    joined = components(reduce(DataFrame.unionByName, links)).withColumnRenamed("v", "key")
    return rows, cut(bare.join(joined, "key", "left").withColumn("component", F.coalesce("component", "key")))


def _with_least(classes: DataFrame) -> DataFrame:
    """Adds `least`, the least `first` of each class's component.

    A component may hold most classes. Those with more than a quarter of an even partition's share, at most four for
    each partition, are sent to all tasks; the others meet their classes in a shuffle.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = cut(classes.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("k")))
    share = (sizes.agg(F.sum("k")).first()[0] or 0) // (4 * parts)
    large = F.broadcast(sizes.where(F.col("k") > share + 1).drop("k"))
    here = classes.join(large, "component")
    there = classes.join(large.select("component"), "component", "left_anti").join(sizes.where(F.col("k") <= share + 1).drop("k"), "component")
    return here.unionByName(there)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links of Jaccard similarity >= threshold / 100)."""
    rows, classes = linked_classes(docs, id_col, text_col, threshold, words)
    resolved = _with_least(classes).select("ka", "kb", F.col("least.id").alias("component_id"))
    out = rows.drop("sha").join(resolved, ["ka", "kb"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of docs that stand for their component: of the smallest id (nulls last), then of the least hash of the text.

    Rows without words are linked with nothing; of equal rows (id and text), with words or without, one stays.
    """
    rows, classes = linked_classes(docs, id_col, text_col, threshold, words)
    lead = classes.groupBy("component").agg(F.min("first").alias("least")).select("least.id", "least.sha")
    wordless = rows.where("n = 0").select("id", "sha").distinct()
    counts = rows.groupBy("id", "sha").agg(F.count("*").alias("rows")).where("rows > 1")
    again = F.col("rows").isNotNull().alias("__again")
    kept = lead.unionByName(wordless).alias("k").join(counts.alias("c"), F.expr("k.id <=> c.id AND k.sha <=> c.sha"), "left")
    kept = kept.select(F.col("k.id").alias("__id"), F.col("k.sha").alias("__sha"), again)
    keyed = docs.withColumns({"__row_id": F.col(id_col).cast("long"), "__row_sha": F.unhex(F.sha2(text_col, 256))})
    found = keyed.join(kept, F.expr("__row_id <=> __id AND __row_sha <=> __sha")).drop("__row_id", "__row_sha")
    found = cut(found) if not counts.isEmpty() else found
    once = found.where("NOT __again").unionByName(found.where("__again").dropDuplicates(["__id", "__sha"]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
