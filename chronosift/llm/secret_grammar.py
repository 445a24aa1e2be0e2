"""Secret scans by fixed patterns and by grammars learned from the secrets found.

Base patterns give labelled credentials. From a bounded sample of them a prefix
tree is built over character classes; states whose outgoing frequencies do not
differ significantly (Hoeffding bounds) are merged, which leaves a
probabilistic automaton of the credentials' formats. Two more automata are
inferred in the same way from ordinary tokens, those of letters alone and the
others (numbers, dates, addresses and the like). Every candidate of every text,
i.e. every run of the automata's characters outside the base matches that is as
long as the shortest credential, is scored by how much likelier the credential
format makes it than the likelier one of the others; candidates above the threshold are added as ``grammar`` spans.

The texts are read twice, once for the sample and once for the result; no
credential is written anywhere.

Spans count code points, end exclusive; that of ``assign`` is the value alone.

Cases: a null text is empty; a text of any length is scanned whole, and a
candidate of any length scored whole (only the sample leaves out credentials of
more than LONGEST characters); without credentials in the table nothing is
added; without ordinary tokens these count as evenly likely; a gain exactly at
the threshold is one; full stops that end a run are no part of a candidate;
repeated rows give repeated results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.llm.common import map_column, small_batches
from chronosift.llm.textops import flat_bytes

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Character classes: the automata's alphabet; the last index ends a token.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", "-", ".", "=")
END = len(CLASSES)
CLASS_OF = {c: i for i, cs in enumerate(CLASSES) for c in cs}
#: Log probability of one character of each class, given the class.
WITHIN = [-math.log(len(cs)) for cs in CLASSES]
#: The class of each byte; END for those of no class.
CLASS_BYTES = np.full(256, END, dtype=np.int64)
CLASS_BYTES[[ord(c) for c in CLASS_OF]] = list(CLASS_OF.values())

#: Shortest candidate: as short as credentials can be.
CANDIDATE = min(LEAST.values())
#: Labelled credentials, and ordinary tokens of either kind, that the automata are inferred from at most, and the longest of them.
SAMPLE, LONGEST = 1500, 256
ALPHA = 0.02
#: Least gain in log likelihood of a candidate, in nats, over the whole and over each character.
GAIN, GAIN_EACH = 8.0, 0.25


# --- base patterns -------------------------------------------------------------------------------


#: What a run of HEX or ACCESS of sufficient length holds; most texts hold none.
_LONG_RUN = re.compile(rb"[0-9a-zA-Z]{20}")


def base_spans(raw: bytes) -> list[tuple[int, int, int, int]]:
    """Base spans in bytes as (start, end, kind, start of the whole match), by start and kind."""
    spans: list[tuple[int, int, int, int]] = []
    lowered = raw.lower()
    if any(k in lowered for k in KEYWORDS):
        spans += [(m.start(2), m.end(2), 0, m.start()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if _LONG_RUN.search(raw):
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            spans += [(m.start(), m.end(), kind, m.start()) for m in pattern.finditer(raw) if m.end() - m.start() >= LEAST[KINDS[kind]]]
    spans.sort(key=lambda s: (s[0], s[2]))
    return spans


def candidates(data: np.ndarray, cuts: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the candidates in the bytes of texts that begin at cuts, without the (start, end) spans given."""
    inside = CLASS_BYTES[data] < END
    for a, b in spans:
        inside[a:b] = False
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[cuts] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    dot = ord(".")
    while len(trim := np.flatnonzero((end - start >= CANDIDATE) & (data[end - 1] == dot))):
        end[trim] -= 1
    long = end - start >= CANDIDATE
    return start[long], end[long]


class Scanned:
    """The base spans and candidates of a batch of texts, in bytes of the batch."""

    def __init__(self, texts: pa.Array):
        self.data, self.cuts = flat_bytes(texts)
        raw, cuts = self.data.tobytes(), self.cuts.tolist()
        self.base = [base_spans(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        taken = [(a + at, a + e) for a, spans in zip(cuts, self.base, strict=False) for _, e, _, at in spans]
        self.start, self.end = candidates(self.data, self.cuts, taken)
        self.raw = raw

    def points(self, i: int):
        """Byte place in the i-th text to code point place."""
        a, b = int(self.cuts[i]), int(self.cuts[i + 1])
        part = self.data[a:b]
        if not (part >= 0x80).any():
            return lambda place: place
        within = np.concatenate([[0], np.cumsum((part & 0xC0) == 0x80)])
        return lambda place: place - int(within[place])


# --- grammar inference ---------------------------------------------------------------------------


class Automaton:
    """Probabilistic automaton: for each state the log probabilities of the classes and of the end, and where they lead."""

    def __init__(self, log_p: list[list[float]], to: list[list[int]]):
        self.log_p, self.to = log_p, to

    def score(self, token: str) -> float:
        """Log probability of a token; unseen steps lead to the first state at a smoothed cost."""
        s, total = 0, 0.0
        for c in token:
            k = CLASS_OF.get(c)
            if k is None:
                return -math.inf
            total += self.log_p[s][k] + WITHIN[k]
            s = self.to[s][k]
        return total + self.log_p[s][END]

    def scores(self, classes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """score of many tokens, given the classes of a batch's characters; step by step for all at once."""
        step = np.array(self.log_p)
        cost, to = step[:, :END] + np.array(WITHIN), np.array(self.to)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state, total = np.zeros(len(start), dtype=np.int64), np.zeros(len(start))
        left = len(start)
        for place in range(int(length[0]) if left else 0):
            while length[left - 1] <= place:
                left = int(np.searchsorted(-length, -place, "left"))
            c = classes[start[:left] + place]
            total[:left] += cost[state[:left], c]
            state[:left] = to[state[:left], c]
        out = np.empty(len(start))
        out[order] = total + step[state, END]
        return out


def _prefix_tree(tokens: list[str]) -> tuple[list[list[int]], list[list[int]]]:
    """Counts and children of each node, by class; counts[END] are ends."""
    counts, child = [[0] * (END + 1)], [[-1] * END]
    for token in tokens:
        s = 0
        for c in token:
            k = CLASS_OF[c]
            counts[s][k] += 1
            if child[s][k] < 0:
                child[s][k] = len(counts)
                counts.append([0] * (END + 1))
                child.append([-1] * END)
            s = child[s][k]
        counts[s][END] += 1
    return counts, child


def infer(tokens: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the tokens' prefix tree, nearest the root first."""
    counts, child = _prefix_tree(tokens)
    spread = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, b: int) -> bool:
        na, nb = sum(counts[a]), sum(counts[b])
        if not na or not nb:
            return False
        bound = spread * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
        return any(abs(x / na - y / nb) > bound for x, y in zip(counts[a], counts[b], strict=True))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if differ(a, b):
                return False
            todo += [(x, y) for x, y in zip(child[a], child[b], strict=True) if x >= 0 and y >= 0 and x != y]
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree under b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for k in range(END + 1):
                counts[a][k] += counts[b][k]
            for k in range(END):
                x, y = child[a][k], child[b][k]
                if y >= 0:
                    if x >= 0:
                        if x != y:
                            todo.append((x, y))
                    else:
                        child[a][k] = y

    red, blue = [0], [(0, k, c) for k, c in enumerate(child[0]) if c >= 0]
    while blue:
        blue.sort(key=lambda x: (-sum(counts[x[2]]), x[2]))
        parent, k, node = blue.pop(0)
        into = next((r for r in red if compatible(r, node)), None)
        if into is None:
            red.append(node)
        else:
            child[parent][k] = into
            fold(into, node)
        done = set(red)
        blue = [(r, j, c) for r in red for j, c in enumerate(child[r]) if c >= 0 and c not in done]
    place = {r: i for i, r in enumerate(red)}
    log_p, to = [], []
    for r in red:
        total = sum(counts[r]) + 0.05 * (END + 1)
        log_p.append([math.log((c + 0.05) / total) for c in counts[r]])
        to.append([place.get(c, 0) for c in child[r]])
    return Automaton(log_p, to)


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[Automaton | None, list[Automaton]]:
    """The automaton of credentials and those of ordinary tokens, from the sample with the least hashes of each; a task keeps its own least ones."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[bytes, int]] = [{}, {}, {}]
        limit = [1 << 64] * 3
        for b in batches:
            found = Scanned(b.column(0))
            raw, cuts = found.raw, found.cuts.tolist()
            secrets = {raw[a + s : a + e] for a, spans in zip(cuts, found.base, strict=False) for s, e, _, _ in spans}
            plain = {raw[s:e] for s, e in zip(found.start.tolist(), found.end.tolist(), strict=True)}
            words = {v for v in plain if v.isalpha()}
            for i, values in enumerate((secrets, words, plain - words)):
                for v in values:
                    if len(v) <= LONGEST and (h := xxhash.xxh3_64_intdigest(v)) < limit[i]:
                        kept[i][v] = h
                if len(kept[i]) > 2 * sample:
                    kept[i] = dict(sorted(kept[i].items(), key=lambda x: (x[1], x[0]))[:sample])
                    limit[i] = max(kept[i].values()) + 1
        for i in range(3):
            rows = sorted((h, v) for v, h in kept[i].items())[:sample]
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), type=pa.int32()), pa.array([h - (1 << 63) for h, _ in rows], type=pa.int64()), pa.array([v.decode() for _, v in rows], type=pa.string())], names=["kind", "h", "value"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, "kind int, h long, value string").distinct()
    least = lambda i: [r["value"] for r in rows.filter(F.col("kind") == i).orderBy("h", "value").limit(sample).collect()]
    rows = rows.persist()
    try:
        return automata(least(0), [least(1), least(2)])
    finally:
        rows.unpersist()


def gains(secret: Automaton, ordinary: list[Automaton], classes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How much likelier the credential format makes tokens than the likelier ordinary one; without any, characters are evenly likely."""
    others = [a.scores(classes, start, length) for a in ordinary] or [-math.log(sum(map(len, CLASSES))) * length]
    return secret.scores(classes, start, length) - np.max(others, axis=0)


def enough(length: np.ndarray, gain: float = GAIN, gain_each: float = GAIN_EACH) -> np.ndarray:
    return np.maximum(gain, gain_each * length)


def automata(secrets: list[str], ordinary: list[list[str]]) -> tuple[Automaton | None, list[Automaton]]:
    """All automata; tokens to which the first round gives the credential format rather than an ordinary one are no ordinary ones in the second."""
    secret = infer(secrets) if secrets else None
    first = [infer(tokens) for tokens in ordinary if tokens]
    if secret is None:
        return None, first
    second = []
    for tokens in ordinary:
        if tokens:
            length = np.array([len(t) for t in tokens])
            classes = CLASS_BYTES[np.frombuffer("".join(tokens).encode(), dtype=np.uint8)]
            found = gains(secret, first, classes, np.cumsum(length) - length, length) > 0
            rest = [t for t, f in zip(tokens, found.tolist(), strict=True) if not f]
            second += [infer(rest)] if rest else []
    return secret, second


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, gain: float = GAIN, gain_each: float = GAIN_EACH) -> DataFrame:
    """doc_id and spans (start, end, kind) of each row, base and grammar spans by start and kind."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text_col, sample))

    def kernel(batches: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        secret, ordinary = shared.value
        for texts in batches:
            found = Scanned(texts)
            rows = [[(s, e, k) for s, e, k, _ in spans] for spans in found.base]
            if secret is not None and len(found.start):
                length = found.end - found.start
                good = np.flatnonzero(gains(secret, ordinary, CLASS_BYTES[found.data], found.start, length) >= enough(length, gain, gain_each))
                of = np.searchsorted(found.cuts, found.start[good], "right") - 1
                for i, s, e in zip(of.tolist(), found.start[good].tolist(), found.end[good].tolist(), strict=True):
                    at = int(found.cuts[i])
                    rows[i].append((s - at, e - at, KINDS.index("grammar")))
            out = []
            for i, spans in enumerate(rows):
                place = found.points(i) if spans else None
                out.append([{"start": place(s), "end": place(e), "kind": KINDS[k]} for s, e, k in sorted(spans, key=lambda x: (x[0], x[2]))])
            yield [pa.array(out, type=_SPANS)]

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    return map_column(docs, text_col, T.StructType([T.StructField("spans", spans)]), kernel, [id_col])


def listed(spans):
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
