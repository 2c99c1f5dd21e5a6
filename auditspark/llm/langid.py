"""Language identification by hyperdimensional profiles.

Every letter, of any script, has a random vector of +1 and -1 (upper and lower case share one). An n-gram is the product of its letters' vectors, each rotated by its
place; a document is the sum over its n-grams (words are joined by one boundary symbol, which has a vector too), and
a language's prototype is the sum of its training documents' unit vectors, rounded to fixed point so that the sum
does not depend on its order. A document gets the language whose prototype has the largest cosine with it.

The vectors follow from a seed; nothing but the prototypes (languages x dimensions numbers, added up in Spark) comes
to the driver, and all labelled rows that the caller passes are used.

Cases: a null text or one without a letter is `und` with score 0; so is every text if there is no labelled row; a
tie goes to the language that sorts first; texts are read whole; repeated rows count as often as they occur; an empty
table gives an empty table; input columns named like output columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, slices, trim

UNDETERMINED = "und"
DIMENSIONS = 1024
NGRAM = 3
SEED = 20_011
_FIXED_POINT = float(1 << 20)
_BATCH = 96


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower case of each code point that is a letter, else 0; one table for each process."""
    table = np.zeros(0x110000, np.uint32)
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            table[ord(c)] = ord(c.lower()[0])
    return table


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Space:
    """The random vectors, and documents as vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.table = dimensions, _letters()
        self.seed = np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))

    def letter_vectors(self, symbols: np.ndarray) -> np.ndarray:
        """A row of +1 and -1 for each symbol (a code point, or 0 for the boundary), from the seed and the symbol alone."""
        words = -(-self.dimensions // 64)
        at = symbols.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
        bits = np.unpackbits(_spread(_spread(at + np.uint64(1)) + self.seed).view(np.uint8), axis=1)
        return bits[:, : self.dimensions].astype(np.int8) * 2 - 1

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A unit vector for each text, and whether it has a letter (else its vector is zero)."""
        data = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
        sizes = np.array([len(d) // 4 for d in data])
        pad = np.zeros(1, np.uint32).tobytes()
        symbols = self.table[np.frombuffer(pad + b"".join(d + pad for d in data), np.uint32)]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
        owner = np.concatenate((owner[:1], owner))
        keep = symbols > 0
        keep[1:] |= symbols[:-1] > 0
        symbols, owner = symbols[keep], owner[keep]
        has = np.zeros(len(texts), bool)
        has[owner[symbols > 0]] = True
        # every text also begins with a boundary: the one that ends its predecessor serves both
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        symbols, owner = np.insert(symbols, begins, 0), np.insert(owner, begins, owner[begins])
        out = np.zeros((len(texts), self.dimensions), np.float32)
        if len(symbols) < NGRAM:
            return out, has
        # symbols by their number in this batch, n-grams by one number made of theirs
        present = np.flatnonzero(np.bincount(symbols))
        number = np.zeros(present[-1] + 1, np.int64)
        number[present] = np.arange(len(present))
        at, base = number[symbols], len(present)
        own = owner[: 1 - NGRAM] == owner[NGRAM - 1 :]
        code = reduce(lambda x, k: x * base + at[k : len(at) - NGRAM + 1 + k], range(NGRAM), owner[: 1 - NGRAM].astype(np.int64))
        key, count = np.unique(code[own], return_counts=True)
        row, gram = np.divmod(key, base**NGRAM)
        grams, column = np.unique(gram, return_inverse=True)
        letters = self.letter_vectors(present)
        rotated = [np.roll(letters, NGRAM - 1 - k, axis=1) for k in range(NGRAM)]
        for a in range(0, len(grams), 8192):
            g, bound = grams[a : a + 8192], np.int8(1)
            for k in range(NGRAM - 1, -1, -1):
                g, digit = np.divmod(g, base)
                bound = bound * rotated[k][digit]
            mine = (column >= a) & (column < a + 8192)
            counts = np.zeros((len(texts), len(g)), np.float32)
            counts[row[mine], column[mine] - a] = count[mine]
            out += counts @ bound.astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0), has

    def all_vectors(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for at in range(0, len(texts), _BATCH):
            yield at, *self.vectors(texts[at : at + _BATCH])


@dataclass
class Profiles:
    """Learned languages (sorted) and their prototypes as unit vectors."""

    languages: list[str]
    prototypes: np.ndarray
    dimensions: int
    seed: int


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> Profiles:
    """Bundle all labelled texts by language. One narrow pass; per task one partial sum for each language."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimensions, seed), {}
        for batch in batches:
            for part, texts in slices(batch, "t"):
                langs = part.column(part.schema.get_field_index("l")).to_pylist()
                for at, vectors, _ in space.all_vectors(texts):
                    fixed = np.rint(vectors * _FIXED_POINT).astype(np.int64)
                    mine = langs[at : at + len(fixed)]
                    for lang in set(mine):
                        sums[lang] = sums.get(lang, 0) + fixed[[x == lang for x in mine]].sum(axis=0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["l", "v"])
        trim()

    rows = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    parts = rows.mapInArrow(bundle, "l string, v array<long>")
    summed = parts.select("l", F.posexplode("v").alias("i", "x")).groupBy("l", "i").agg(F.sum("x").alias("x"))
    by: dict[str, np.ndarray] = {}
    for r in summed.toLocalIterator():
        by.setdefault(r.l, np.zeros(dimensions))[r.i] = r.x
    by = {k: v / n for k, v in by.items() if (n := np.linalg.norm(v)) > 0}
    languages = sorted(by)
    matrix = np.array([by[k] for k in languages], np.float32).reshape(len(languages), dimensions)
    return Profiles(languages, matrix, dimensions, seed)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language and its cosine (0 to 1). Map-only."""

    def make():
        space = Space(profiles.dimensions, profiles.seed)

        def apply(texts):
            langs, scores = [], []
            for _, vectors, has in space.all_vectors(texts):
                if not profiles.languages:
                    has = has & False
                    cosine = np.zeros((len(vectors), 1))
                else:
                    cosine = vectors @ profiles.prototypes.T
                best = cosine.argmax(axis=1)
                top = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                langs += [profiles.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)]
                scores += [float(s) if h else 0.0 for s, h in zip(top, has, strict=True)]
            return [langs, scores]

        return apply

    return append_columns(docs, text_col, make, [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
