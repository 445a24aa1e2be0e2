"""Quality classification by co-training.

Two logistic regressions see different views of a document: its text (hashed
words and measurements of form) and its metadata (source, language, size).
From the labelled documents both are trained; in each round either labels, for
the other, the unlabelled documents of the whole table it is surest of (``each``
good and as many bad ones, by rank within the view), and the other is trained
again with them. Each view is calibrated on labelled documents kept apart, and
a last regression on both calibrated views weighs them, so that a view that
tells nothing counts for nothing; for that, either half of the documents kept
apart is calibrated on the other half. All documents are scored.

The views of all documents are computed once and written to the shared folder;
rounds and scores read them. Labelled training rows are a bounded sample: about
``labelled`` documents, those with the least hash of the identifier; all other
documents are the unlabelled ones. A task keeps its own surest documents, so
that a round moves a few rows a task.

Cases: nulls are values of their own in the metadata, a null text is an empty
one; a text of any length is read whole; labels without a document and null
labels are not used; of clashing labels of one identifier the least (bad)
counts; if labels are of one kind or missing, every score is the share of good
ones (0.5 without any); ties of certainty go by a hash of identifier and text;
repeated rows get equal scores; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.llm.common import forget, settle, small_batches
from chronosift.llm.rule_ledger import measure_text
from chronosift.llm.textops import word_hashes

LABELLED = 4000
WORD_BUCKETS, META_BUCKETS = 512, 64
ROUNDS, EACH = 3, 50
SEED = 41


def text_view(raw: bytes | None, hashes: np.ndarray) -> np.ndarray:
    """Measurements of form as ratios, then the shares of hashed words, square-rooted."""
    words, chars, symbols, dup_lines, repeats, lines, alpha, upper, marks, digits = measure_text(raw)
    w, c = max(1, words), max(1, chars)
    form = [math.log1p(words) / 10, min(100.0, chars / w / 10), min(2.0, symbols / w), dup_lines / max(1, lines), repeats / w, lines / w, alpha / c, upper / max(1, alpha), min(2.0, marks / w), digits / c]
    bag = np.zeros(WORD_BUCKETS)
    if len(hashes):
        bag = np.sqrt(np.bincount((hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=WORD_BUCKETS) / len(hashes))
    return np.concatenate([form, bag])


def meta_places(source: str | None, lang: str | None, size: int | None) -> bytes:
    """One of META_BUCKETS hashed places each for source, language and the size's power of two."""
    return bytes(zlib.crc32(repr(v).encode()) % META_BUCKETS for v in (source, lang, None if size is None else str(max(0, size).bit_length())))


def meta_views(places: list[bytes]) -> np.ndarray:
    """The metadata views, 1 at each place."""
    at = np.frombuffer(b"".join(places), dtype=np.uint8).reshape(-1, 3).astype(np.int64) + np.arange(3) * META_BUCKETS
    out = np.zeros((len(places), 3 * META_BUCKETS))
    out[np.arange(len(places))[:, None], at] = 1
    return out


def text_views(stored: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(stored), dtype=np.float16).reshape(len(stored), -1).astype(np.float64)


@dataclass
class Regression:
    """Logistic regression, then a calibration of its margin (Platt)."""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights[:-1] + self.weights[-1]) + self.shift


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Regression:
    """Newton's method with an L2 penalty on all but the constant."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x1 @ w)
        grad = x1.T @ (p - y) + penalty * w
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return Regression(w)


def calibrate(model: Regression, x: np.ndarray, y: np.ndarray) -> Regression:
    fitted = fit_regression(model.margin(x)[:, None], y)
    return Regression(model.weights, float(fitted.weights[0]), float(fitted.weights[1]))


@dataclass
class CoTrained:
    text: Regression
    meta: Regression
    both: np.ndarray  # weights of the calibrated margins, and a constant
    rounds: list[tuple[int, int]]  # labels given by the text view, and by the metadata view


#: Of a view and a label, the surest unlabelled documents: (key, text view, metadata view), none of those taken.
Surest = Callable[[list[Regression], list[set[int]]], dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]]]


def surest_of(margin: np.ndarray, key: np.ndarray, taken: set[int], good: int, each: int) -> np.ndarray:
    """Places of the surest documents of a view for a label: of greatest, or least, margin, ties by key; a key once."""
    free = ~np.isin(key, np.fromiter(taken, dtype=np.int64, count=len(taken)))
    at = np.flatnonzero(free)
    _, first = np.unique(key[at], return_index=True)
    at = at[np.sort(first)]
    return at[np.lexsort((key[at], -margin[at] if good else margin[at]))][:each]


def array_pool(text: np.ndarray, meta: np.ndarray, each: int) -> Surest:
    """Unlabelled documents in memory."""

    def surest(models: list[Regression], taken: list[set[int]]) -> dict:
        key = np.arange(len(text))
        return {(v, good): [(int(i), text[i], meta[i]) for i in surest_of(models[v].margin((text, meta)[v]), key, taken[1 - v], good, each)] for v in (0, 1) for good in (0, 1)}

    return surest


def _across(model: Regression, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Margins of documents kept apart, of either half as calibrated on the other."""
    half, out = np.arange(len(y)) % 2 == 0, model.margin(x)
    if len(set(y[half])) == 2 == len(set(y[~half])):
        for part in (half, ~half):
            out[part] = calibrate(Regression(model.weights), x[~part], y[~part]).margin(x[part])
    return out


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, surest: Surest, rounds: int = ROUNDS) -> CoTrained:
    """Views of labelled documents with labels y (0 or 1), and what tells the surest unlabelled ones. A third of the labelled is kept apart."""
    apart = np.arange(len(y)) % 3 == 2
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), dtype=bool)
    learn, held = ~apart, apart if apart.any() else ~apart
    views = [text, meta]
    given: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]  # what a view has been given by the other: label and view of it

    def trained(v: int) -> Regression:
        rows = [given[v][k] for k in sorted(given[v])]
        x = np.vstack([views[v][learn], *(r[1][None, :] for r in rows)])
        return calibrate(fit_regression(x, np.concatenate([y[learn], [r[0] for r in rows]])), views[v][held], y[held])

    models, history = [trained(0), trained(1)], []
    for _ in range(rounds):
        found = surest(models, [set(g) for g in given])
        gave = [0, 0]
        for (v, good), rows in sorted(found.items()):
            for key, *own in rows:
                gave[v] += key not in given[1 - v]
                given[1 - v].setdefault(key, (float(good), own[1 - v]))
        history.append((gave[0], gave[1]))
        if not any(gave):
            break
        models = [trained(0), trained(1)]
    margins = np.stack([_across(m, v[held], y[held]) for m, v in zip(models, views, strict=True)], axis=1)
    return CoTrained(models[0], models[1], fit_regression(margins, y[held]).weights, history)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, source, lang, size; columns that are missing are null."""
    have = {c.lower() for c in docs.columns}
    pick = lambda c, kind: (F.col(f"`{c}`").cast("string") if c in have else F.lit(None)).try_cast(kind)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), pick("source", "string").alias("source"), pick("lang", "string").alias("lang"), pick("n_chars", "long").alias("size"))


def views(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (a hash of identifier and text), tv and mv (the views, packed) of each row, written to the shared folder."""
    small_batches(docs.sparkSession)
    body = _columns(docs, id_col, text_col).select("id", F.xxhash64("id", "text").alias("key"), "source", "lang", "size", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at = word_hashes(b.column(5))
            at = at.tolist()
            raw = b.column(5).cast(pa.binary()).to_pylist()
            tv = [text_view(t, h[x:y]).astype(np.float16).tobytes() for t, x, y in zip(raw, at[:-1], at[1:], strict=True)]
            mv = [meta_places(*m) for m in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tv, type=pa.binary()), pa.array(mv, type=pa.binary())], names=["id", "key", "tv", "mv"])

    schema = T.StructType([body.schema["id"], T.StructField("key", T.LongType()), T.StructField("tv", T.BinaryType()), T.StructField("mv", T.BinaryType())])
    return settle(body.mapInArrow(run, schema), "quality-views")


def _table_pool(pool: DataFrame, each: int) -> Surest:
    """Unlabelled documents in a frame of views; each task keeps its own surest ones, of which the surest of all are taken."""

    def surest(models: list[Regression], taken: list[set[int]]) -> dict:
        shared = pool.sparkSession.sparkContext.broadcast((models, taken))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, taken = shared.value
            kept = {(v, good): (np.empty(0), np.empty(0, dtype=np.int64), [], []) for v in (0, 1) for good in (0, 1)}
            for b in batches:
                key, tv, mv = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_pylist()
                margins = models[0].margin(text_views(tv)), models[1].margin(meta_views(mv))
                for (v, good), (m, k, t, w) in kept.items():
                    m, k, t, w = np.concatenate([m, margins[v]]), np.concatenate([k, key]), t + tv, w + mv
                    best = surest_of(m, k, taken[1 - v], good, each).tolist()
                    kept[v, good] = m[best], k[best], [t[i] for i in best], [w[i] for i in best]
            for (v, good), (m, k, t, w) in kept.items():
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(k), type=pa.int32()), pa.array([good] * len(k), type=pa.int32()), pa.array(m if good else -m, type=pa.float64()), pa.array(k, type=pa.int64()), pa.array(t, type=pa.binary()), pa.array(w, type=pa.binary())], names=["v", "good", "sure", "key", "tv", "mv"])

        rows = settle(pool.select("key", "tv", "mv").mapInArrow(run, "v int, good int, sure double, key long, tv binary, mv binary"), "surest")
        found = {}
        for v in (0, 1):
            for good in (0, 1):
                best = rows.filter((F.col("v") == v) & (F.col("good") == good)).dropDuplicates(["key"]).orderBy(F.col("sure").desc(), "key").limit(each).collect()
                found[v, good] = [(r["key"], text_views([r["tv"]])[0], meta_views([r["mv"]])[0]) for r in best]
        forget(rows)
        return found

    return surest


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rounds: int = ROUNDS, each: int = EACH, prepared: DataFrame | None = None) -> CoTrained | float:
    """The classifier, or the share of good labels where they are of one kind; prepared: views(docs), if there already."""
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("long").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    n_marks, good = marks.agg(F.count("*"), F.avg("y")).first()
    if not n_marks or good in (0.0, 1.0):
        return 0.5 if not n_marks else good
    prepared = views(docs, id_col, text_col) if prepared is None else prepared
    part = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = F.broadcast(marks.filter(part < labelled / n_marks))  # about ``labelled`` rows of two integers
    train = prepared.join(chosen, "id").select("y", "key", "tv", "mv").collect()
    train.sort(key=lambda r: r["key"])
    y = np.array([float(r["y"]) for r in train])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else good
    pool = prepared.join(chosen.select("id"), "id", "left_anti")
    return co_train(text_views([r["tv"] for r in train]), meta_views([r["mv"] for r in train]), y, _table_pool(pool, each), rounds)


def score(docs: DataFrame, model: CoTrained | float, id_col: str = "doc_id", text_col: str = "text", prepared: DataFrame | None = None) -> DataFrame:
    """doc_id, p_text, p_meta and score of each row."""
    prepared = views(docs, id_col, text_col) if prepared is None else prepared
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            if isinstance(model, float):
                cols = [np.full(b.num_rows, model)] * 3
            else:
                mt, mm = model.text.margin(text_views(b.column(1).to_pylist())), model.meta.margin(meta_views(b.column(2).to_pylist()))
                cols = [_sigmoid(mt), _sigmoid(mm), _sigmoid(mt * model.both[0] + mm * model.both[1] + model.both[2])]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, type=pa.float64()) for c in cols)], names=["id", "p_text", "p_meta", "score"])

    schema = T.StructType([prepared.schema["id"], *(T.StructField(c, T.DoubleType()) for c in ("p_text", "p_meta", "score"))])
    return prepared.select("id", "tv", "mv").mapInArrow(run, schema).withColumnRenamed("id", id_col)
