"""Word shingles of texts as sorted arrays of 64-bit fingerprints, in whole-array arithmetic.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z is lower-cased. A word's hash mixes two polynomials of its UTF-8 bytes,
modulo two primes near 2^31 and with unrelated bases (prefix sums, so no loop over words; unlike sums modulo a power of
two, no repetitive structure makes them collide), and its length; a very long word has a keyed BLAKE2b hash. A
shingle's fingerprint mixes the weighted sum of its words' hashes.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np

SHINGLE_WORDS = 5
#: Bytes of text whose sums are held at once (about forty bytes of memory for each), and the longest word summed up.
AT_ONCE = 1 << 17
LONG_WORD = 1 << 12
_WHITE = {0x20, *range(0x09, 0x0E)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in _WHITE else b for b in range(256))
#: Fixed primes with the bases of their polynomials, the multiplier of the places in a shingle, and the key of long words.
_FIELDS = ((2_147_483_647, 1_540_483_477), (2_147_483_629, 917_654_321))
_WORD_BASE = 0xD6E8FEB86659FD93
_KEY = b"word shingles"
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each base its powers and their inverses modulo the prime, for a stretch of AT_ONCE bytes."""
    return [(_raised(base, p), _raised(pow(base, -1, p), p)) for p, base in _FIELDS]


def _raised(base: int, p: int) -> np.ndarray:
    """1, base, base^2 ... modulo p, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) <= AT_ONCE:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)))
    return out[: AT_ONCE + 1]


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and their hashes; raw begins and ends with a space."""
    space = raw == 0x20
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
    size = stop - start
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):  # the values do not depend on where stretches end
        end = max(at + 1, int(np.searchsorted(stop, start[at] + AT_ONCE, "right")))
        a, b = start[at], min(stop[end - 1], start[at] + AT_ONCE)
        x = raw[a:b].astype(np.uint64) + np.uint64(1)
        first, last = start[at:end] - a, np.minimum(stop[at:end], b) - a
        halves = []
        for (p, _), (up, down) in zip(_FIELDS, _powers(), strict=True):
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x * up[: len(x)], out=sums[1:])
            halves.append((sums[last] - sums[first]) % np.uint64(p) * down[first] % np.uint64(p))
        out[at:end] = mix((halves[0] << np.uint64(32) | halves[1]) + size[at:end].astype(np.uint64) * np.uint64(_WORD_BASE))
        at = end
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(blake2b(raw[start[i] : stop[i]].tobytes(), digest_size=8, key=_KEY).digest(), "little")
    return start, out


class Shingler:
    def __init__(self, words: int = SHINGLE_WORDS):
        self.words = words
        self.factors = [np.uint64(pow(_WORD_BASE, i, 1 << 64)) for i in range(words)]

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text the sorted distinct fingerprints; with fewer words than a shingle one for all, without words none."""
        out, held, size = [], [], 0
        for t in texts:
            held.append((t or "").encode("utf-8", "surrogatepass").translate(_TABLE) + b" ")
            size += len(held[-1])
            if size >= AT_ONCE:
                out += self._sets(held)
                held, size = [], 0
        return out + self._sets(held) if held else out

    def _sets(self, data: list[bytes]) -> list[np.ndarray]:
        start, words = _word_hashes(np.frombuffer(b" " + b"".join(data), np.uint8))
        k = self.words
        rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for i in range(k if len(rolled) else 0):
            rolled += words[i : i + len(rolled)] * self.factors[i]
        rolled = mix(rolled)
        ends = np.searchsorted(start, np.cumsum([len(d) for d in data]) + 1)
        out, a = [], 0
        for b in ends.tolist():
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:  # told apart from whole shingles by the number of words
                total = sum(int(w) * int(f) for w, f in zip(words[a:b], self.factors, strict=False)) + b - a
                out.append(mix(np.array([total & _MASK], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
            a = b
        return out


def bitmap(fingerprints: np.ndarray) -> np.ndarray:
    """A bit for each fingerprint in a power of two of bits, 4 to 8 for each; words of 64 bits."""
    bits = max(64, 1 << int(4 * len(fingerprints) - 1).bit_length()) if len(fingerprints) else 64
    out = np.zeros(bits, np.uint8)
    out[(fingerprints & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of more words as one of fewer."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def most_shared(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray) -> int:
    """An upper bound of the intersection: a bit set on one side only stands for a fingerprint of that side only."""
    words = min(len(a), len(b))
    a, b = fold(a, words), fold(b, words)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
