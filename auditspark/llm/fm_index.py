"""Benchmark decontamination by an FM-index per training shard.

A shard is a run of consecutive rows of one task. Its words become one integer sequence; an FM-index over the whole
of it (suffix array by prefix doubling of what is not yet told apart, Burrows-Wheeler sequence in a wavelet tree,
suffix positions sampled at every eighth place) answers all benchmark windows at once by backward search; occurrences
are located by walking to sampled positions, and the spans of a document are merged. A word that no item holds, and
the gap between two documents, is a symbol of its own at every place: it can be part of no window, ends all ties in
the sorting, and is where a walk ends too (suffixes after such a word are sampled).

The benchmark is searched in blocks of at most `block_bytes` of text, so the part held by a worker is bounded
whatever the benchmark's size.

Cases: null or wordless texts have no words and are never hit; a null or wordless item has no window; a null item id
is reported as an empty one; items with equal windows are all reported; repeated documents are each judged; an empty benchmark leaves all documents clean;
an empty table gives an empty table; input columns named like output columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import slices, small_batches, trim, without

WINDOW = 10
SAMPLE = 8
BLOCK_BYTES = 4 << 20
#: Text that one index covers, about: an index takes some fifty bytes of memory for each.
SHARD_BYTES = 1 << 20
_WORD_BYTES = bytes(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: Lower-cases A-Z, keeps word bytes, and turns all others into spaces.
_TABLE = bytes((c if (c := b + 32 if 0x41 <= b <= 0x5A else b) in _WORD_BYTES else 0x20) for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WaveletTree:
    """Bit rows of a sequence by binary digits of its symbols (high first), each row stably partitioned by the last."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        cur = seq
        for k in range(levels - 1, -1, -1):
            bit = (cur >> k) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(cur) - int(bit.sum()))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before position at (arrays of queries)."""
        lo, hi = np.zeros_like(at), at
        for row, k in enumerate(range(self.levels - 1, -1, -1)):
            one, up = self.ones[row], ((symbol >> k) & 1).astype(bool)
            lo1, hi1 = one[lo], one[hi]
            lo = np.where(up, self.zeros[row] + lo1, lo - lo1)
            hi = np.where(up, self.zeros[row] + hi1, hi - hi1)
        return hi - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Of a sequence of numbers, by prefix doubling; a suffix that is a prefix of another sorts first.

    A rank is the place of the first of equals, so only suffixes that still share one are sorted again.
    """
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    ordered = seq[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    shared = ~(new & np.append(new[1:], True))
    open_, step = order[shared], 1
    while len(open_):
        after = open_ + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        at = np.lexsort((second, rank[open_]))
        open_, second = open_[at], second[at]
        first = rank[open_]
        group = np.concatenate(([True], first[1:] != first[:-1]))
        equal = np.concatenate(([True], group[1:] | (second[1:] != second[:-1])))
        place = np.arange(len(open_))
        start = np.maximum.accumulate(np.where(group, place, 0))
        rank[open_] = first + np.maximum.accumulate(np.where(equal, place, 0)) - start
        open_ = open_[~(equal & np.append(equal[1:], True))]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Index of a sequence of word numbers from 1 to `top`; 0 is any other word, equal to nothing."""

    def __init__(self, seq: np.ndarray, top: int):
        other = seq == 0
        text = np.append(np.where(other, top + 1 + np.arange(len(seq)), seq), 0)
        sa = suffix_array(text)
        self.size, self.top = len(text), top
        self.bwt = np.minimum(text[sa - 1], top + 1)
        self.tree = WaveletTree(self.bwt, (top + 1).bit_length())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(np.minimum(text, top + 1), minlength=top + 2))))
        self.sampled = (sa % SAMPLE == 0) | (self.bwt > top)
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned patterns (rows of a matrix) of the given lengths."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1):
            live = live[(lengths[live] >= back) & (lo[live] < hi[live])]
            c = patterns[live, -back]
            known = (c > 0) & (c <= self.top)
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            first = self.before[c]
            lo[live], hi[live] = first + self.tree.rank(c, lo[live]), first + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Sequence positions of index rows, by walking back to sampled ones."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[rows[live]]
            out[live[done]] = self.samples[self.sample_at[rows[live[done]]]] + steps
            live = live[~done]
            c = self.bwt[rows[live]]
            rows[live] = self.before[c] + self.tree.rank(c, rows[live])
            steps += 1
        return out


class Windows:
    """The distinct windows of benchmark items, as rows of word numbers, with the items each belongs to."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.size, self.vocabulary = size, {}
        rows: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                rows.setdefault(ids[i : i + size], []).append(item)
        self.items = [sorted(set(v)) for v in rows.values()]
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), size), np.int32)
        for k, r in enumerate(rows):
            self.rows[k, size - len(r) :] = r

    def __len__(self) -> int:
        return len(self.items)

    def occurrences(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window number) of every occurrence in a shard's word numbers (0: a word of no item, or a gap)."""
        if not len(self):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        index = FMIndex(seq, len(self.vocabulary))
        lo, hi = index.find(self.rows, self.lengths)
        count = hi - lo
        window = np.repeat(np.arange(len(count)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return index.locate(rows), window


def judge(texts: list[str | None], windows: Windows) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """Of each text: words, hit words, items with an occurring window, merged spans in words."""
    each = [words(t) for t in texts]
    sizes = np.array([len(w) for w in each], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    get, seq = windows.vocabulary.get, np.zeros(int(sizes.sum() + len(each)) + 1, np.int64)
    for s, w in zip(starts, each, strict=True):
        seq[s : s + len(w)] = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
    at, which = windows.occurrences(seq)
    out = [(int(n), 0, [], []) for n in sizes]
    if not len(at):
        return out
    change = np.zeros(len(seq) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + windows.lengths[which], -1)
    hit = (np.cumsum(change) > 0).astype(np.int8)
    owner = np.searchsorted(starts, at, side="right") - 1
    order = np.argsort(owner, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)
    for g in groups:
        d = int(owner[g[0]])
        mine = hit[starts[d] : starts[d] + sizes[d]]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mine, [0]))))
        items = sorted({i for w in set(which[g].tolist()) for i in windows.items[w]})
        out[d] = (int(sizes[d]), int(mine.sum()), items, [(int(a), int(b)) for a, b in edge.reshape(-1, 2)])
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", SPANS),
]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[Broadcast]:
    """Item ids and texts as broadcasts of at most `block_bytes` of text (or one item); the driver holds one at a time."""
    sc, out, block, held = benchmark.sparkSession.sparkContext, [], [], 0
    size = F.octet_length(text_col).alias("n")
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"), size).where("t IS NOT NULL")
    for r in rows.orderBy("i", "t").toLocalIterator():
        if block and held + r.n > block_bytes:
            out.append(sc.broadcast(block))
            block, held = [], 0
        block.append((r.i or "", r.t))
        held += r.n
    return [*out, sc.broadcast(block)]


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of its spans and what stands between them; unchanged without spans."""
    if not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    where, parts, at = [m.span() for m in _WORD.finditer(data)], [], 0
    for first, stop in spans:
        parts.append(data[at : where[first][0]])
        at = where[stop - 1][1]
    return b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass")


def _merged(a: tuple, b: tuple) -> tuple:
    """What two benchmark blocks found in one text: items united, spans merged anew, hits counted again."""
    if not a[1] or not b[1]:
        return b if b[1] else a
    spans: list[tuple[int, int]] = []
    for first, stop in sorted([*a[3], *b[3]]):
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], stop))
        else:
            spans.append((first, stop))
    return a[0], sum(y - x for x, y in spans), sorted({*a[2], *b[2]}), spans


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    cleaned_col: str | None = None,
) -> DataFrame:
    """docs with n_words, n_hit, items (sorted as strings) and spans (merged, in words).

    `cleaned_col` names a further column for the text without its spans. One map-only pass: a task opens one benchmark
    block after the other for each of its batches, so neither its memory nor the driver's grows with the benchmark.
    """
    fields = [*FIELDS, *([T.StructField(cleaned_col, T.StringType())] if cleaned_col else [])]
    docs = without(docs, [f.name for f in fields])
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    schema = T.StructType([*docs.schema.fields, *fields])
    added = to_arrow_schema(T.StructType(fields))

    def opened(block: Broadcast) -> Windows:
        windows = Windows(block.value, window)
        vars(block).pop("_value", None)  # a broadcast keeps what it has read, of which one is enough
        return windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = opened(blocks[0])
        for batch in batches:
            parts = list(slices(batch, text_col, SHARD_BYTES))
            found: list[list[tuple]] = []
            for k, block in enumerate(blocks):
                if len(blocks) > 1:
                    windows = opened(block)
                for i, (_, texts) in enumerate(parts):
                    new = judge(texts, windows)
                    if k:
                        found[i] = list(map(_merged, found[i], new))
                    else:
                        found.append(new)
            for (part, texts), rows in zip(parts, found, strict=True):
                columns = [list(c) for c in zip(*rows, strict=True)]
                if cleaned_col:
                    columns.append([t and cut_words(t, s) for t, s in zip(texts, columns[3], strict=True)])
                columns[3] = [[{"start": a, "end": b} for a, b in s] for s in columns[3]]
                new = [pa.array(c, added.field(i).type) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema=pa.schema([*part.schema, *added]))
        windows = None
        trim()

    return docs.mapInArrow(run, schema)
