"""BPE encoding and decoding by tree concatenation.

A text longer than `leaf_chars` is cut into leaves that are encoded in parallel (as rows of their own); a tree of
joins then puts neighbours together. What two neighbours have to settle lies between the last break (white space or a
special token) before the join and the first one behind it; everything else stands. The pre-tokens there are split
anew from the last that the left side alone decides, over a window that grows until a pre-token begins where one of
the right side's does. Of a pre-token that reaches across the join, however long, a window of tokens round the join is
encoded again and grown until its first token agrees with the left side and its last with the right side; beyond those
points both sides stand. Merges are rank-ordered, so a token sequence is the encoding exactly if each neighbouring
pair encodes to itself. One pre-token longer than `word_symbols` is encoded by the same tree over its symbols.

The vocabulary file is a parameter (a `tokenizers` JSON with NFC, white-space and lower-case normalisation, a split
expression, byte-level symbols and word-end suffixes); it must be readable on every worker.

Cases: a null or empty text has no tokens and decodes to an empty text; strings of special tokens in a text become
those tokens, as the library does, and are breaks of their leaf; a leaf grows beyond its size where a cut would part a
special token or a letter from its marks; repeated rows give repeated results; an empty table gives an empty table;
input columns named like output columns are replaced.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, slices, trim, without

LEAF_CHARS = 32_768
WORD_SYMBOLS = 256
#: Entries of a cache, and the characters of the longest entry; a worker holds up to two generations of two caches.
CACHE_WORDS = 25_000
CACHE_CHARS = 48
#: Texts of code points below this are composed already and pre-tokenised alike in all Unicode versions.
PLAIN_BELOW = 0x300
#: Characters that decide on a pre-token: a contraction looks at three, the end of a run at one more.
LOOK_AHEAD = 4

#: One pre-token: its normalised text and its tokens.
Piece = tuple[str, list[str]]


def _byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where printable Latin-1, else the next of 256 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(extra)) for b in range(256)]


@dataclass
class Node:
    """A stretch of text: with a break inside, pieces before the first (head) and after the last (tail) and packed ids
    and shown tokens between; without one (open), pieces in head only."""

    open: bool
    head: list[Piece] = field(default_factory=list)
    ids: list[bytes] = field(default_factory=list)
    shown: list[str] = field(default_factory=list)
    tail: list[Piece] = field(default_factory=list)


class TreeEncoder:
    """Encodes and decodes as the library does with the file's tokenizer, special tokens not added."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, word_symbols: int = WORD_SYMBOLS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.path, self.final = path, self.library.model
        self.suffix = self.final.end_of_word_suffix
        self.ids = self.library.get_vocab(with_added_tokens=False)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.leaf_chars, self.word_symbols = leaf_chars, word_symbols
        self.symbols = _byte_symbols()
        letter, number = (
            "".join(re.escape(chr(c)) for c in range(PLAIN_BELOW) if unicodedata.category(chr(c))[0] == k) for k in "LN"
        )
        space = r"\t-\r \x85\xa0"
        self.plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
        self.gap, self.odd_gap = re.compile(f"[{space}]+"), re.compile("[\x1c-\x1f]")
        # not plain: the one capital here whose lower case is two characters long (U+0130), and the two whose lower
        # case lies beyond (U+023A, U+023E)
        self.beyond = re.compile("[^\x00-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u02ff]")
        self.words = _Cache(self._word)
        self.stretches = _Cache(self._stretch)

    @cached_property
    def inner(self):
        """The same merges for symbols that do not end a pre-token; only long ones need them."""
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path).model
        model.end_of_word_suffix = None
        return model

    def rest(self) -> None:
        """Forget what was cached: workers outlive tasks."""
        for cache in (self.words, self.stretches):
            cache.clear()
            cache.old = {}

    # -- one pre-token ------------------------------------------------------------------------------------------

    def _merge(self, symbols: str, final: bool) -> list[str]:
        return [t.value for t in (self.final if final else self.inner).tokenize(symbols)]

    def merge_tree(self, symbols: str, final: bool = True) -> list[str]:
        """Tokens of one pre-token's symbols; halves of a long one are merged on their own and joined."""
        if len(symbols) <= self.word_symbols:
            return self._merge(symbols, final)
        mid = len(symbols) // 2
        return self.join_tokens(self.merge_tree(symbols[:mid], False), self.merge_tree(symbols[mid:], final), final, False)

    def join_tokens(self, left: list[str], right: list[str], final: bool = True, ended: bool = True) -> list[str]:
        """Tokens of the symbols of both. `ended`: left's last token has the suffix; `final`: right's has, and the result's."""
        k, cut = 4, len(self.suffix)
        while True:
            a, b = left[-k:], right[:k]
            whole_left, whole_right = k >= len(left), k >= len(right)
            before, after = "".join(a), "".join(b)
            ends = final and whole_right
            text = (before[:-cut] if ended else before) + (after[:-cut] if ends else after)
            window = self._merge(text, ends)
            if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                return [*left[:-k], *window, *right[k:]]
            k *= 2

    def tokens(self, text: str) -> list[str]:
        """Tokens of one normalised pre-token."""
        if len(text) <= CACHE_CHARS:
            return self.words[text][1].split(" ")
        return self.merge_tree(self._symbols(text))

    def _symbols(self, text: str) -> str:
        return text if text.isascii() and text.isprintable() else "".join(map(self.symbols.__getitem__, text.encode("utf-8")))

    def _word(self, text: str) -> tuple[bytes, str]:
        return self._packed(self.merge_tree(self._symbols(text)))

    def _stretch(self, text: str) -> tuple[bytes, str]:
        """Packed ids and shown tokens of plain normalised text without white space."""
        found = [self.words[w] if len(w) <= CACHE_CHARS else self._word(w) for w in self.plain.findall(text)]
        return found[0] if len(found) == 1 else (b"".join([p[0] for p in found]), " ".join([p[1] for p in found]))

    def _packed(self, tokens: list[str]) -> tuple[bytes, str]:
        return _pack(list(map(self.ids.__getitem__, tokens))), " ".join(tokens)

    # -- texts --------------------------------------------------------------------------------------------------

    def split(self, text: str) -> list[tuple[int, int]]:
        """Places of the pre-tokens of normalised text."""
        if not self.beyond.search(text):
            return [m.span() for m in self.plain.finditer(text)]
        return [place for _, place in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def leaf(self, text: str) -> Node:
        """A text encoded in one go; special tokens are breaks."""
        parts, at = [], 0
        for m in self.at_special.finditer(text):
            parts += [self._segment(text[at : m.start()]), Node(False, ids=[_pack((self.special[m[0]],))], shown=[m[0]])]
            at = m.end()
        return reduce(self.join, [*parts, self._segment(text[at:])])

    def _segment(self, text: str) -> Node:
        """A text without special tokens."""
        if not self.beyond.search(text):
            first, *others = self.gap.split(text.lower())
            head = [(w, self.tokens(w)) for w in self.plain.findall(first)]
            if not others:
                return Node(True, head)
            found = [self.stretches[s] if len(s) <= CACHE_CHARS else self._stretch(s) for s in others[:-1]]
            tail = [(w, self.tokens(w)) for w in self.plain.findall(others[-1])]
            return Node(False, head, [f[0] for f in found], [f[1] for f in found], tail)
        text = self.library.normalizer.normalize_str(text)
        places = self.split(text)
        ends = [0, *(e for _, e in places)]
        breaks = [i for i, s in enumerate([*(s for s, _ in places), len(text)]) if s > ends[i]]
        pieces = lambda a, b: [(w := text[s:e], self.tokens(w)) for s, e in places[a:b]]
        if not breaks:
            return Node(True, pieces(0, len(places)))
        found = [self._packed(t) for _, t in pieces(breaks[0], breaks[-1])]
        return Node(False, pieces(0, breaks[0]), [f[0] for f in found], [f[1] for f in found], pieces(breaks[-1], len(places)))

    def join(self, a: Node, b: Node) -> Node:
        if a.open and b.open:
            return Node(True, self.join_runs(a.head, b.head))
        if a.open:
            return Node(False, self.join_runs(a.head, b.head), b.ids, b.shown, b.tail)
        if b.open:
            return Node(False, a.head, a.ids, a.shown, self.join_runs(a.tail, b.head))
        ids, shown = self._packed([t for _, tokens in self.join_runs(a.tail, b.head) for t in tokens])
        return Node(False, a.head, [*a.ids, ids, *b.ids], [*a.shown, *([shown] if shown else []), *b.shown], b.tail)

    def join_runs(self, left: list[Piece], right: list[Piece]) -> list[Piece]:
        """Pieces of a text without breaks from those of its two parts."""
        if not left or not right:
            return left or right
        i = size = 0
        while i < len(left) and size < LOOK_AHEAD:
            i += 1
            size += len(left[-i][0])
        k = 2
        while True:
            window = left[-i:] + right[:k]
            spans, again = self._resplit(window, i, k >= len(right))
            if again is not None:
                middle = [self._piece(window, s, e) for s, e in spans]
                return [*left[:-i], *middle, *right[again - i :]]
            k *= 2

    def _resplit(self, window: list[Piece], i: int, whole: bool) -> tuple[list, int | None]:
        """Places ((piece, offset) to (piece, offset)) of new pre-tokens, and the piece from which the old ones stand.

        Only the ends of a long piece are looked at: it is a run of one class, and nothing ends within it.
        """
        shown, at = [], []
        for p, (text, _) in enumerate(window):
            keep = range(len(text)) if len(text) <= 4 * LOOK_AHEAD else [*range(LOOK_AHEAD), *range(len(text) - LOOK_AHEAD, len(text))]
            shown += [text[x] for x in keep]
            at += [(p, x) for x in keep]
        places = self.split("".join(shown))
        out = []
        for s, e in places:
            if at[s][0] >= i and at[s][1] == 0:
                return out, at[s][0]
            out.append((at[s], (at[e - 1][0], at[e - 1][1] + 1)))
        return out, len(window) if whole else None

    def _piece(self, window: list[Piece], start: tuple[int, int], stop: tuple[int, int]) -> Piece:
        """The pre-token between two places: tokens of whole old pieces and of fragments, joined."""
        parts = []
        for p in range(start[0], stop[0] + 1):
            text, tokens = window[p]
            a, b = start[1] if p == start[0] else 0, stop[1] if p == stop[0] else len(text)
            parts.append((text, tokens) if (a, b) == (0, len(text)) else (text[a:b], self.tokens(text[a:b])))
        return "".join(t for t, _ in parts), reduce(self.join_tokens, [tokens for _, tokens in parts])

    def finish(self, node: Node) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        (first, begin), (last, end) = (self._packed([t for _, tokens in run for t in tokens]) for run in (node.head, node.tail))
        return b"".join([first, *node.ids, last]), " ".join([s for s in (begin, *node.shown, end) if s])

    def tree(self, nodes: list[Node]) -> Node:
        """Neighbours joined level by level."""
        while len(nodes) > 1:
            up = [self.join(a, b) for a, b in zip(nodes[::2], nodes[1::2], strict=False)]
            nodes = up + nodes[len(up) * 2 :]
        return nodes[0]

    def encode(self, text: str | None) -> tuple[bytes, str]:
        if not text:
            return b"", ""
        if len(text) <= self.leaf_chars:
            if self.beyond.search(text):
                e = self.library.encode(text, add_special_tokens=False)
                return _pack(e.ids), " ".join(e.tokens)
            if "<|" not in text:
                # Python's own splitting knows four separators that the library's white space does not
                odd = self.odd_gap.search(text)
                found = list(filter(None, self.gap.split(text.lower()))) if odd else text.lower().split()
                if not found:
                    return b"", ""
                if max(map(len, found)) <= CACHE_CHARS:
                    ids, shown = zip(*map(self.stretches.__getitem__, found), strict=True)
                else:
                    ids, shown = zip(*[self.stretches[s] if len(s) <= CACHE_CHARS else self._stretch(s) for s in found], strict=True)
                return b"".join(ids), " ".join(shown)
        cuts = leaf_cuts(text, self.leaf_chars)
        return self.finish(self.tree([self.leaf(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]))


class _Cache(dict):
    """Results by text: a full generation becomes the old one, from which what is used again comes back."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, text: str) -> tuple[bytes, str]:
        out = self.old.get(text)
        if out is None:
            out = self.make(text)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[text] = out
        return out


def _pack(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def shared_encoder(path: str, leaf_chars: int) -> TreeEncoder:
    """One encoder for each worker process, whatever number of tasks it runs."""
    return TreeEncoder(path, leaf_chars)


FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("decoded", T.StringType()),
]
_PIECES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.StringType())]))
_NODE = [
    T.StructField("open", T.BooleanType()),
    T.StructField("head", _PIECES),
    T.StructField("ids", T.BinaryType()),
    T.StructField("shown", T.StringType()),
    T.StructField("tail", _PIECES),
]


def encode_documents(
    docs: DataFrame, path: str, text_col: str = "text", leaf_chars: int = LEAF_CHARS, partitions: int | None = None
) -> DataFrame:
    """docs with n_tokens, ids (little-endian unsigned 32-bit integers in one binary) and decoded.

    Texts within `leaf_chars` take one map-only pass. Longer ones become leaf rows (the first of them with the other
    columns) that are spread over the cluster, encoded, and put together by document; only they are shuffled.
    """
    docs = without(docs, [f.name for f in FIELDS])
    long_text = F.coalesce(F.length(text_col) > leaf_chars, F.lit(False))

    def make():
        encoder = shared_encoder(path, leaf_chars)

        def apply(texts):
            both = [encoder.encode(t) for t in texts]
            return [[len(b) // 4 for b, _ in both], [b for b, _ in both], [d for _, d in both]]

        apply.done = encoder.rest
        return apply

    short = append_columns(docs.where(~long_text), text_col, make, FIELDS)
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("__none"))
    key = F.concat_ws("-", F.monotonically_increasing_id(), F.sha2(text_col, 256))
    marked = docs.where(long_text).select(key.alias("key"), row.alias("row"), F.col(text_col).alias("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = _encode_leaves(_leaves(marked, leaf_chars).repartition(n, "key", "leaf"), path, leaf_chars)
    kept = T.StructType([encoded.schema["row"], encoded.schema["text"], *FIELDS])
    ordered = encoded.repartition(n, "key").sortWithinPartitions("key", "leaf")
    joined = ordered.mapInArrow(_joiner(path, leaf_chars), kept)
    back = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return short.unionByName(joined.select(*back, *[f.name for f in FIELDS]))


def _leaves(marked: DataFrame, size: int) -> DataFrame:
    """Rows (key, leaf number, number of leaves, row, text); `row` is null but with the first leaf."""
    schema = T.StructType([marked.schema["key"], T.StructField("leaf", T.IntegerType()), T.StructField("leaves", T.IntegerType()), T.StructField("row", marked.schema["row"].dataType), marked.schema["text"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                for i, t in enumerate(texts):
                    cuts = leaf_cuts(t, size)
                    n = len(cuts) - 1
                    rows = pa.concat_arrays([part.column(1).slice(i, 1), pa.nulls(n - 1, part.column(1).type)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part.column(0)[i].as_py()] * n, pa.string()),
                            pa.array(range(n), pa.int32()),
                            pa.array([n] * n, pa.int32()),
                            rows,
                            pa.array([t[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.string()),
                        ],
                        names=["key", "leaf", "leaves", "row", "text"],
                    )
        trim()

    return marked.mapInArrow(run, schema)


def leaf_cuts(text: str, size: int, guard: int = 32) -> list[int]:
    """0, places at about equal distances where texts can be normalised apart, and the end."""
    n = -(-len(text) // size)
    cuts = [0]
    for i in range(1, n):
        at = len(text) * i // n
        near = text.rfind("<|", max(0, at - guard), at + 1)
        if near >= 0 and at < near + guard:
            at = near
        while at < len(text) and not _begins(text[at]):
            at += 1
        if cuts[-1] < at < len(text):
            cuts.append(at)
    return [*cuts, len(text)]


def _begins(c: str) -> bool:
    """No normalisation puts the character together, or in another order, with what stands before it: neither a mark
    nor a vowel or final consonant that completes a syllable."""
    return c.isascii() or unicodedata.category(c)[0] != "M" and not ("\u1160" <= c <= "\u11ff" or "\U00016d40" <= c <= "\U00016d7f")


def _encode_leaves(leaves: DataFrame, path: str, leaf_chars: int) -> DataFrame:
    """Adds each leaf's node: whether it is open, its head, what is settled, and its tail."""
    added = _NODE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or shared_encoder(path, leaf_chars)
            for part, texts in slices(batch, "text"):
                nodes = [encoder.leaf(t) for t in texts]
                new = [
                    pa.array([x.open for x in nodes], pa.bool_()),
                    _packed_runs([x.head for x in nodes]),
                    pa.array([b"".join(x.ids) for x in nodes], pa.binary()),
                    pa.array([" ".join(x.shown) for x in nodes], pa.string()),
                    _packed_runs([x.tail for x in nodes]),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *[f.name for f in added]])
        if encoder:
            encoder.rest()
        trim()

    return leaves.mapInArrow(run, T.StructType([*leaves.schema.fields, *added]))


def _packed_runs(runs: list[list[Piece]]) -> pa.Array:
    """Tokens never hold a space (bytes are shown as printable symbols)."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.string())]))
    return pa.array([[{"text": t, "tokens": " ".join(tokens)} for t, tokens in run] for run in runs], kind)


def _joiner(path: str, leaf_chars: int):
    """Documents from their leaves, which come one after the other; a task holds one document's nodes at a time."""
    run = lambda x: [(p["text"], p["tokens"].split(" ")) for p in x.as_py()]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, nodes, texts, row, wanted = None, [], [], None, 0
        for batch in batches:
            encoder = encoder or shared_encoder(path, leaf_chars)
            for i in range(batch.num_rows):
                if batch.column("leaf")[i].as_py() != len(nodes):
                    raise ValueError("a document's leaves are not complete")
                if not nodes:
                    row, wanted = batch.column("row").slice(i, 1), batch.column("leaves")[i].as_py()
                opened, head, ids, shown, tail = (batch.column(f.name)[i] for f in _NODE)
                nodes.append(Node(opened.as_py(), run(head), [ids.as_py()], [s] if (s := shown.as_py()) else [], run(tail)))
                texts.append(batch.column("text")[i].as_py())
                if len(nodes) == wanted:
                    packed, decoded = encoder.finish(encoder.tree(nodes))
                    yield pa.RecordBatch.from_arrays(
                        [
                            row,
                            pa.array(["".join(texts)], pa.string()),
                            pa.array([len(packed) // 4], pa.int64()),
                            pa.array([packed], pa.binary()),
                            pa.array([decoded], pa.string()),
                        ],
                        names=["row", "text", *[f.name for f in FIELDS]],
                    )
                    nodes, texts, row = [], [], None
        if nodes:
            raise ValueError("a document's leaves are not complete")
        if encoder:
            encoder.rest()
        trim()

    return join
