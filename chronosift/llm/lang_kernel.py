"""Language identification with a blended-spectrum string kernel.

A text is the set of its character 1-, 2- and 3-grams (every letter in lower
case for itself, everything else one class). The kernel of two texts is the
number of n-grams that both have, over the geometric mean of their numbers
(n-grams that no landmark has count for nothing). Landmark texts (Nyström)
stand for the training set: with K the kernel of training texts and landmarks
and M that of the landmarks, ridge regression solves
(K'K + ridge * n * M) a = K'y for each language against the rest. A text's
scores are its kernel row times a, in products over whole batches.

The classifier is fitted on a bounded sample: about ``per_lang`` rows of each
language (those with the least hash of the identifier) and about
``landmarks_per_lang`` of them as landmarks, of rows that are not held out, i.e.
whose crc32(identifier as text) mod 5 is not 0. The driver gets the landmarks'
n-grams and the others' kernel rows, never their texts.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is
all where nothing can be learned; a text of any length is read whole; of equal
scores the first language by name wins; a null identifier is neither held out
nor learned from; repeated rows get equal results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.llm.common import map_text
from chronosift.llm.textops import mix

PER_LANG, LANDMARKS_PER_LANG = 250, 40
#: So many languages' row counts, at most, are broadcast to the rows; more are joined by a shuffle.
COUNTED = 100_000
#: Texts in one matrix product.
BLOCK = 64
RIDGE = 1e-3
SEED = 7
UND = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter."""
    if not _LETTERS:
        out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(out)
    return _LETTERS[0]


def points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)


def codes(raw: bytes) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of a text, no two n-grams having the same: 21 bits a letter, and the length."""
    s = letters()[points(raw)].astype(np.uint64)
    bits, tag = np.uint64(21), np.uint64(1 << 63)
    two = s[:-1] << bits | s[1:]
    three = two[:-1] << bits | s[2:]
    return np.concatenate([s | tag, two | tag | np.uint64(1 << 62), three])


class Lookup:
    """Places of codes in an ascending array, by two tables of hashes and, for what collides in both, by search."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = np.uint64(64 - max(16, int(len(known) * 64).bit_length()))
        self.tables, left = [], np.arange(len(known))
        for turn in (0, 1):
            table = np.zeros(1 << (64 - int(self.bits)), dtype=np.int32)
            slot = self._slot(known[left], turn)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]
        self.rest = left

    def _slot(self, code: np.ndarray, turn: int) -> np.ndarray:
        return mix(code ^ np.uint64(turn * 0x5851F42D4C957F2D)) >> self.bits

    def __call__(self, code: np.ndarray) -> np.ndarray:
        """The distinct places of the codes that are known, ascending."""
        seen = np.zeros(len(self.known), dtype=bool)
        if len(self.known):
            for turn, table in enumerate(self.tables):
                at = table[self._slot(code, turn)]
                seen[at[self.known[at] == code]] = True
            if len(self.rest):
                at = self.rest[np.minimum(np.searchsorted(self.known[self.rest], code), len(self.rest) - 1)]
                seen[at[self.known[at] == code]] = True
        return np.flatnonzero(seen)


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # the landmarks' n-grams, ascending codes
    first: np.ndarray  # where each n-gram's landmarks begin in owners, and one more
    owners: np.ndarray
    norms: np.ndarray  # of each landmark
    weights: np.ndarray  # landmarks x languages

    @classmethod
    def of(cls, langs: list[str], landmarks: list[np.ndarray]) -> Model:
        """A model without weights, from the landmarks' distinct n-grams."""
        code = np.concatenate([np.empty(0, dtype=np.uint64), *landmarks])
        owner = np.repeat(np.arange(len(landmarks), dtype=np.int32), [len(x) for x in landmarks])
        order = np.argsort(code, kind="stable")
        grams, first = np.unique(code[order], return_index=True)
        norms = np.sqrt(np.maximum([len(x) for x in landmarks], 1)).astype(np.float32)
        return cls(langs, grams, np.append(first, len(code)), owner[order], norms, np.zeros((len(landmarks), len(langs)), dtype=np.float32))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lookup"}

    def present(self, raw: bytes) -> np.ndarray:
        """Places of a text's n-grams among the landmarks'."""
        if "_lookup" not in self.__dict__:
            self._lookup = Lookup(self.grams)
        return self._lookup(codes(raw))

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        """Kernel of texts (as present gives them) and landmarks, by a product over the n-grams the texts have."""
        out = [np.empty((0, len(self.norms)), dtype=np.float32)]
        for i in range(0, len(rows), BLOCK):
            part = rows[i : i + BLOCK]
            used, at = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *part]), return_inverse=True)
            n = np.array([len(r) for r in part])
            x = np.zeros((len(part), len(used)), dtype=np.float32)
            x[np.repeat(np.arange(len(part)), n), at] = 1
            many = self.first[used + 1] - self.first[used]
            own = np.repeat(self.first[used] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            marks = np.zeros((len(used), len(self.norms)), dtype=np.float32)
            marks[np.repeat(np.arange(len(used)), many), self.owners[own]] = 1
            out.append((x @ marks) / (np.sqrt(np.maximum(n, 1)).astype(np.float32)[:, None] * self.norms[None, :]))
        return np.concatenate(out)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.kernel(rows) @ self.weights

    def solve(self, k: np.ndarray, y: list[str], m: np.ndarray, ridge: float = RIDGE) -> Model:
        """Set the weights from kernel rows of training texts with languages y, and the landmarks' kernel."""
        k, m = k.astype(np.float64), m.astype(np.float64)
        sign = np.array([[1.0 if v == c else -1.0 for c in self.langs] for v in y])
        self.weights = np.linalg.solve(k.T @ k + ridge * len(y) * m + 1e-6 * np.eye(len(m)), k.T @ sign).astype(np.float32)
        return self


def _places(model: Model, landmarks: list[np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(model.grams, x) for x in landmarks]


def fit(rows: list[tuple[bytes, str]], landmarks_per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> Model | None:
    """Fit on (text, language) rows; the first ones of each language are its landmarks."""
    rows = [(t, y) for t, y in rows if letters()[points(t)].any()]
    if not rows:
        return None
    langs = sorted({y for _, y in rows})
    marks, per = [], dict.fromkeys(langs, 0)
    for t, y in rows:
        if per[y] < landmarks_per_lang:
            per[y] += 1
            marks.append(np.unique(codes(t)))
    model = Model.of(langs, marks)
    return model.solve(model.kernel([model.present(t) for t, _ in rows]), [y for _, y in rows], model.kernel(_places(model, marks)), ridge)


def _sample(docs: DataFrame, per_lang: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """About per_lang rows (text, lang, at, id) of each language that may be learned from; at, from 0 to about per_lang, orders them by the hash of their identifiers."""
    d = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    may = d.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = may.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    if counts.limit(COUNTED + 1).count() <= COUNTED:
        counts = F.broadcast(counts)
    part = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 40)) / float(1 << 40)
    return may.join(counts, F.col("lang") == F.col("of")).withColumn("at", part * F.col("n")).filter(F.col("at") < per_lang).select("text", "lang", "at", "id")


def learn(docs: DataFrame, per_lang: int = PER_LANG, landmarks_per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on about per_lang rows of each language; texts are read on the executors."""
    rows = _sample(docs, per_lang, id_col, text_col, lang_col)

    def grams(batches: Iterator[list[bytes | None]]) -> Iterator[list[pa.Array]]:
        for texts in batches:
            found = [np.unique(codes(t)) if letters()[points(t)].any() else None for t in texts]
            yield [pa.array([None if x is None else x.tobytes() for x in found], type=pa.binary())]

    binary = lambda n: T.StructType([T.StructField(n, T.BinaryType())])
    order = lambda r: (r["at"], r["id"], r["lang"])
    marks = sorted((r for r in map_text(rows.filter(F.col("at") < landmarks_per_lang), "text", binary("grams"), grams, ["lang", "at", "id"]).collect() if r["grams"]), key=order)
    if not marks:
        return None
    found = [np.frombuffer(r["grams"], dtype=np.uint64) for r in marks]
    model = Model.of(sorted({r["lang"] for r in marks}), found)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel_rows(batches: Iterator[list[bytes | None]]) -> Iterator[list[pa.Array]]:
        for texts in batches:
            k = shared.value.kernel([shared.value.present(t) for t in texts])
            yield [pa.array([row.tobytes() if letters()[points(t)].any() else None for row, t in zip(k, texts, strict=True)], type=pa.binary())]

    train = sorted((r for r in map_text(rows, "text", binary("k"), kernel_rows, ["lang", "at", "id"]).collect() if r["k"] and r["lang"] in model.langs), key=order)
    k = np.stack([np.frombuffer(r["k"], dtype=np.float32) for r in train])
    return model.solve(k, [r["lang"] for r in train], model.kernel(_places(model, found)), ridge)


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, lang_pred and score (0 to 1) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[list[bytes | None]]) -> Iterator[list[pa.Array]]:
        model = shared.value
        for texts in batches:
            langs, scores = [UND] * len(texts), [0.0] * len(texts)
            use = [i for i, t in enumerate(texts) if t and model is not None and letters()[points(t)].any()]
            if use:
                found = model.scores([model.present(texts[i]) for i in use])
                best = found.argmax(axis=1)
                for i, b, s in zip(use, best.tolist(), found.max(axis=1).tolist(), strict=True):
                    langs[i], scores[i] = model.langs[b], min(1.0, max(0.0, (s + 1) / 2))
            yield [pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())]

    return map_text(docs, text_col, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]), kernel, keep)
