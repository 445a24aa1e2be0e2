"""Vectorised word and n-gram hashing on UTF-8 bytes, used by several kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MASK = (1 << 64) - 1


def splitmix(i: int) -> int:
    """The i-th value of the splitmix64 sequence."""
    x = (i * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


#: Odd multipliers, one for each place in an n-gram.
PLACES = np.array([splitmix(i) | 1 for i in range(64)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher(dict):
    """Word to 64-bit hash, remembered for words seen before; bounded in size."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of a sequence of word hashes, in order."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(hashes) - n + 1
    acc = hashes[:m] * PLACES[0]
    for i in range(1, n):
        acc += hashes[i : i + m] * PLACES[i]
    return mix(acc + np.uint64(n))


# --- words of a whole Arrow batch at once --------------------------------------------------------

SEPARATOR = 0x20
#: Bytes that are worked on at a time; a longer text is taken in pieces.
PIECE = 1 << 18


def byte_map(keep: bytes, lower: bool = True) -> np.ndarray:
    """A table of 256: A-Z to a-z if lower, what is in keep to itself, the rest to the separator."""
    out = np.full(256, SEPARATOR, dtype=np.uint8)
    kept = np.frombuffer(keep, dtype=np.uint8)
    out[kept] = kept
    if lower:
        capital = kept[(kept >= 0x41) & (kept <= 0x5A)]
        out[capital] = capital + 32
    return out


#: Words parted by ASCII white space, A-Z put into lower case.
SPACED_LOWER = byte_map(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))

_BASE = splitmix(301) & ~7 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.array([splitmix(400 + b) | 1 for b in range(256)], dtype=np.uint64)


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string array, one after another, and the place where each begins (one more at the end); null is empty."""
    a = pc.fill_null(texts, "")
    if not len(a) or a.buffers()[2] is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(a) + 1, dtype=np.int64)
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    at = np.frombuffer(a.buffers()[1], dtype=kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    return np.frombuffer(a.buffers()[2], dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    """np.unique without its overhead on short arrays."""
    out = np.sort(values)
    new = np.ones(len(out), dtype=bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def word_hashes(texts: pa.Array, table: np.ndarray = SPACED_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after another, and the place of each text's first (one more at the end).

    A word's hash is the sum of a random value for each byte times a power of
    an odd base for its place, finalised; differences of running sums give it
    for all words of a piece at once.
    """
    data, edge_at = flat_bytes(texts)
    found, begins, ends = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for lo in range(0, len(data), PIECE):
        m = table[data[lo : lo + PIECE]]
        n = len(m)
        inside = m != SEPARATOR
        edge = np.zeros(n + 1, dtype=bool)
        edge[edge_at[np.searchsorted(edge_at, lo) : np.searchsorted(edge_at, lo + n, "right")] - lo] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[m] * _UP[:n], out=total[1:])
        found.append((total[e] - total[s]) * _DOWN[s])
        begins.append(s + lo)
        ends.append(e + lo)
    h, s, e = np.concatenate(found), np.concatenate(begins), np.concatenate(ends)
    # A word that goes on in the next piece: two words never touch otherwise, but where a text ends.
    on = np.flatnonzero(s[1:] == e[:-1]) + 1
    on = on[edge_at[np.searchsorted(edge_at, s[on])] != s[on]] if len(on) else on
    for i in on.tolist()[::-1]:
        h[i - 1 : i] += h[i : i + 1] * np.uint64(pow(_BASE, int(e[i - 1] - s[i - 1]), 1 << 64))
    if len(on):
        keep = np.ones(len(h), dtype=bool)
        keep[on] = False
        h, s = h[keep], s[keep]
    return mix(h), np.searchsorted(s, edge_at)
