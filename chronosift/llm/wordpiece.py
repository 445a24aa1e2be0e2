"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes, again and again, the longest vocabulary
token that starts the rest of a word. A trie of the vocabulary is given failure
links: where no token continues the state's string, the tokens that greedy
matching would have taken by then are popped, and the link leads to the state
of what is left. With the number of popped tokens precomputed for each state, a
word's count needs one pass over its bytes and no piece is built.

The vocabulary is one whose tokens end words with a mark (here the mark is a
symbol of its own, so that one trie serves all places of a word). Words are
runs of letters and digits, or single other characters, of the ASCII-lower-cased
text; bytes beyond ASCII count as letters. Where greedy matching leaves only the
end mark, the word ends with a token without it. A word that cannot be cut is
one unknown token.

Cases: a null or empty text has no tokens; repeated rows give repeated
results; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronosift.llm.common import map_text

#: Symbol that ends a word, beside the 256 bytes.
END = 256
MARK = "</w>"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\s]")


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Tokens of a vocabulary file of the tokenizers library, as symbols."""
    of = byte_symbols()
    out = []
    for token in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
        stem = token.removesuffix(MARK)
        if stem and all(c in of for c in stem):
            out.append((*(of[c] for c in stem), *([END] if stem != token else [])))
    return out


class Automaton:
    """Trie with failure links and popped-token counts; state 0 is the root, -1 no state."""

    def __init__(self, vocabulary: list[tuple[int, ...]]):
        step: dict[int, int] = {}
        is_token = [False]
        for token in [*vocabulary, (END,)]:  # an end left alone is no token but ends the word
            s = 0
            for c in token:
                key = s << 9 | c
                if key not in step:
                    step[key] = len(is_token)
                    is_token.append(False)
                s = step[key]
            is_token[s] = True
        children: list[list[tuple[int, int]]] = [[] for _ in is_token]
        for key, to in step.items():
            children[key >> 9].append((key & 511, to))
        self.step, self.fail, self.pops = step, [-1] * len(is_token), [0] * len(is_token)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in children[u]:
                if is_token[v]:
                    self.fail[v], self.pops[v] = 0, int(v != step[END])
                else:
                    z, n = self.fail[u], self.pops[u]
                    while z >= 0 and z << 9 | c not in step:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = step[z << 9 | c], n
                todo.append(v)

    def count(self, word: bytes) -> int:
        """Tokens of a word; 0 if it cannot be cut."""
        step, s, n = self.step, 0, 0
        for c in (*word, END):
            while (to := step.get(s << 9 | c, -1)) < 0:
                n += self.pops[s]
                s = self.fail[s]
                if s < 0:
                    return 0
            s = to
        while s > 0:
            n += self.pops[s]
            s = self.fail[s]
        return n if s == 0 else 0


class Counter(dict):
    """Counts (words, tokens, unknown) of white-space chunks as one integer each; bounded memory."""

    def __init__(self, automaton: Automaton, limit: int = 300_000):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, chunk: bytes) -> int:
        value = 0
        for w in WORD.findall(chunk.lower()):
            n = self.automaton.count(w)
            value += 1 << 80 | (n << 40 if n else 1 << 40 | 1)
        if len(self) < self.limit and len(chunk) < 200:
            self[chunk] = value
        return value

    def of(self, text: bytes | None) -> tuple[int, int, int]:
        words = tokens = unknown = 0
        for v in map(self.__getitem__, text.split() if text else ()):
            words += v >> 80
            tokens += v >> 40 & 0xFFFFFFFFFF
            unknown += v & 0xFFFFFFFFFF
        return words, tokens, unknown


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(Automaton(load_vocabulary(path)))
    return _COUNTERS[path]


FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")])


def counts(docs: DataFrame, vocabulary: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, n_words, n_tokens and n_unknown of every whole text."""

    def kernel(batches: Iterator[list[bytes | None]]) -> Iterator[list[pa.Array]]:
        found = counter(vocabulary)
        for texts in batches:
            rows = np.array([found.of(t) for t in texts], dtype=np.int64).reshape(len(texts), 3)
            yield [pa.array(rows[:, i]) for i in range(3)]

    return map_text(docs, text_col, FIELDS, kernel, keep)
