"""Near duplicates by b-bit minhash signatures and a multi-index Hamming join.

A set of shingles has a signature of SYMBOLS minhashes, of each of which BITS
bits are kept. Two sets of similarity s differ in about (1 - s) SYMBOLS of
them. Signatures are cut into CHUNKS of WIDTH symbols; if two differ in at most
DISTANCE symbols, then by the pigeonhole principle in some chunk in ERRORS at
most. The errors a chunk allows are enumerated: each way to leave ERRORS symbols
out gives a key, the rest of the chunk's symbols. So all pairs of signatures
within DISTANCE share a key, whatever the data; nodes that share one are
candidates. Candidates are screened by the distance of their signatures, and
then compared on their full sets.

Of sets with a similarity of exactly 85 % one pair in some million has a greater
distance than DISTANCE (missed()), and far fewer of more similar ones.

Equal sets are one node. How nodes of a bucket are compared, without all pairs
of a group of copies and without a task for a bucket, is the Jaccard join's
(``partenum``), with this method's keys, screen and threshold.

Cases: as there. A text without words, or null, has an empty set, linked with
nothing; texts of any length are taken whole; a tie (85 % exactly) is a link;
documents without identifier have no component, but their copies do, and links
through them count; rows with one identifier are treated each by its text; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.llm import partenum
from chronosift.llm.textops import mix, splitmix

SHINGLE, PERCENT = 3, 85
CHUNKS, WIDTH, ERRORS, BITS = 13, 5, 1, 16
SYMBOLS = CHUNKS * WIDTH
#: Signatures that differ in so many symbols share a key for certain.
DISTANCE = CHUNKS * (ERRORS + 1) - 1

#: A pair of multipliers for each two minhashes.
_MULTIPLIERS = [(np.uint64(splitmix(900 + 2 * i) | 1), np.uint64(splitmix(901 + 2 * i) | 1)) for i in range((SYMBOLS + 1) // 2)]
#: Symbols of a chunk that a key keeps, for each way to leave ERRORS out.
_KEPT = np.array(list(combinations(range(WIDTH), WIDTH - ERRORS)))
_SALT = mix(np.arange(CHUNKS * len(_KEPT), dtype=np.uint64) + np.uint64(splitmix(880))).reshape(CHUNKS, len(_KEPT))
#: Shingles whose minhashes are found at once.
PIECE = 1 << 16


def missed(similarity: float, distance: int = DISTANCE, symbols: int = SYMBOLS) -> float:
    """Probability that sets of this similarity have signatures farther apart than distance."""
    return sum(comb(symbols, d) * (1 - similarity) ** d * similarity ** (symbols - d) for d in range(distance + 1, symbols + 1))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """SYMBOLS symbols of BITS bits for each non-empty set."""
    out = np.full((2 * len(_MULTIPLIERS), len(sets)), 0xFFFFFFFF, dtype=np.uint32)
    if not sets:
        return out[:SYMBOLS].astype(np.uint16).T
    x, start = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for lo in range(0, len(x), PIECE):
        piece = x[lo : lo + PIECE]
        first, last = np.searchsorted(start, lo, "right") - 1, np.searchsorted(start, lo + len(piece))
        at = np.maximum(start[first:last] - lo, 0)
        for j, (p, q) in enumerate(_MULTIPLIERS):
            z = piece * p
            z ^= z >> np.uint64(32)
            z *= q
            z ^= z >> np.uint64(29)
            for i, half in ((2 * j, z.astype(np.uint32)), (2 * j + 1, (z >> np.uint64(32)).astype(np.uint32))):
                np.minimum(out[i, first:last], np.minimum.reduceat(half, at), out=out[i, first:last])
    return (out[:SYMBOLS] & np.uint32((1 << BITS) - 1)).astype(np.uint16).T


def keys(symbols: np.ndarray) -> np.ndarray:
    """The keys of signatures, a row each: of each chunk, each choice of WIDTH - ERRORS of its symbols."""
    chunks = symbols.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    packed = np.zeros((len(chunks), *_SALT.shape), dtype=np.uint64)
    for place in range(WIDTH - ERRORS):
        packed = (packed << np.uint64(BITS)) | chunks[:, :, _KEPT[:, place]]
    return mix(packed ^ _SALT).reshape(len(chunks), -1)


def give(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found = keys(minhashes(sets))
    return found.ravel(), np.repeat(np.arange(len(sets)), found.shape[1])


def vectors(sets: list[np.ndarray]) -> list[bytes]:
    """Signatures as bytes; sets are not empty, but for those of texts without words."""
    full = [s if len(s) else np.zeros(1, dtype=np.uint64) for s in sets]
    return [row.tobytes() for row in minhashes(full)]


def near(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Whether signatures differ in DISTANCE symbols at most."""
    x, y = (np.frombuffer(b"".join(v), dtype=np.uint16).reshape(-1, SYMBOLS) for v in (a, b))
    return (x != y).sum(axis=1) <= DISTANCE


#: Sets of 5 shingles or fewer are similar to equal ones only: the next larger pair is 5 of 6, under 85 %.
METHOD = partenum.Method(SHINGLE, PERCENT, 6, lambda spark, scanned: give, vector=vectors, near=near, at_once=10_000_000)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those linked to a smaller identifier; see partenum.one_of_each."""
    return partenum.one_of_each(docs, id_col, text_col, METHOD)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest identifier reachable by links) and kept of each row."""
    return partenum.components(docs, id_col, text_col, METHOD).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def oracle() -> str:
    """DuckDB SQL of components()."""
    return partenum.oracle(SHINGLE, PERCENT, ", doc_id = component_id AS kept")
