"""Encoding whole texts with the tokenizers library, remembering words seen before."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TAIL = ".,"
#: Letters below are as old as to be letters for every version of Unicode; words with others are encoded whole.
SETTLED = "\u0590"
#: A longer chunk (scripts without spaces have sentences of one) is encoded, but not remembered.
LONGEST = 64


def _steady(c: str) -> bool:
    """Whether a letter is composed, in lower case one letter again whatever is beside it, and the same for Arrow."""
    low = c.lower()
    return c != "Σ" and len(low) == 1 and low.isalpha() and c.isalpha() and unicodedata.is_normalized("NFC", c + low) and low == pc.utf8_lower(c).as_py()


#: Words of these letters alone are normalised by lower case.
PLAIN = f"^[{''.join(filter(_steady, map(chr, range(ord(SETTLED)))))}]+$"


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all runs, one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def as_list(a: pa.Array) -> list:
    """to_pylist without a scalar for each value."""
    return a.to_numpy(zero_copy_only=False).tolist()


class Memory:
    """Words and their ids, at most ``limit``; when there are more, those stay that were met again, unless they are too many too."""

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], type=pa.binary())
        self.ids, self.length, self.again = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)

    def ids_of(self, words: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and their number for each; encode() gives those of new ones."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        self.again[at[~new]] = True
        added = words.filter(pa.array(new))
        ids, length = encode(added)
        ids, length = np.concatenate([self.ids, ids]), np.concatenate([self.length, length])
        at[new] = np.arange(len(self.words), len(length))
        n, starts = length[at], np.cumsum(length) - length
        found = ids[gather(starts[at], n)]
        self.words, self.ids, self.length = pa.concat_arrays([self.words, added]), ids, length
        self.again = np.concatenate([self.again, np.zeros(len(added), dtype=bool)])
        long = pc.binary_length(self.words).to_numpy(zero_copy_only=False) > LONGEST
        if len(length) > self.limit:
            self._keep(self.again & ~long, starts)
            self.again[:] = False
            if len(self.length) > self.limit // 2:
                self.forget()
        elif long.any():
            self._keep(~long, starts)
        return found, n

    def _keep(self, kept: np.ndarray, starts: np.ndarray) -> None:
        self.ids = self.ids[gather(starts[kept], self.length[kept])]
        self.words, self.length, self.again = self.words.filter(pa.array(kept)), self.length[kept], self.again[kept]


class ChunkEncoder:
    """Texts to token ids with add_special_tokens off.

    The tokenizer must never join what ASCII white space parts (its pre-tokenizer
    drops white space) and must put letters into lower case. The texts of a
    batch are cut at white space at once, and each distinct chunk is encoded
    once. Letters before a tail of full stops and commas are a word of their
    own, as for the pre-tokenizer, if the normalised word (composed, in lower
    case) is all letters; such words are told from one another by the
    vocabulary's word ends and encoded many at once, without the normaliser and
    the pre-tokenizer's patterns. Plain words are found and put into lower case
    by Arrow. Tails and all other chunks are encoded whole. Words and chunks met
    before are remembered, at most ``limit`` of each and no long ones.
    """

    def __init__(self, path: str, limit: int = 200_000, batch: int = 512):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit, self.batch = limit, batch
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        with open(path, encoding="utf-8") as f:
            plain = json.load(f)
        plain["normalizer"] = plain["post_processor"] = None
        plain["added_tokens"] = []
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.words, self.others = Memory(limit), Memory(limit)

    def _whole(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one after another, and their number for each."""
        found, texts = [], [c.decode("utf-8", "replace") for c in as_list(chunks)]
        for i in range(0, len(texts), self.batch):
            found += [e.ids for e in self.tok.encode_batch_fast(texts[i : i + self.batch], add_special_tokens=False)]
        return np.array([x for ids in found for x in ids], dtype=np.uint32), np.array([len(ids) for ids in found], dtype=np.int64)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters in normal form, encoded in joined texts."""
        ids, lengths = [np.empty(0, dtype=np.uint32)], [np.empty(0, dtype=np.int64)]
        for i in range(0, len(words), self.batch):
            part = words[i : i + self.batch]
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), b" ")[0].as_py().decode()
            got = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[got]) + 1
            if len(ends) == len(part) and ends[-1] == len(got):
                n = np.diff(ends, prepend=0)
            else:
                got, n = self._whole(part)
            ids.append(got)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def _split(self, chunk: bytes) -> tuple[bytes, bytes]:
        """A chunk that is not plain as a word of letters in normal form and its tail; (b"", chunk) if it must be encoded whole."""
        if chunk.isascii():
            return b"", chunk
        stem = chunk.rstrip(TAIL.encode())
        try:
            word = unicodedata.normalize("NFC", stem.decode())
        except UnicodeDecodeError:
            return b"", chunk
        low = word.lower()
        if max(low) < SETTLED and "Σ" not in word and low.isalpha() and unicodedata.is_normalized("NFC", low):
            return low.encode(), chunk[len(stem) :]
        return b"", chunk

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, one after another, and their number for each: those of its word, if any, and of its tail or the whole chunk."""
        stems = pc.ascii_rtrim(chunks, TAIL)
        plain = pc.match_substring_regex(stems, PLAIN)
        low = pc.utf8_lower(stems.filter(plain)).cast(pa.binary())
        raw, is_plain = chunks.cast(pa.binary()), plain.to_numpy(zero_copy_only=False)
        parts = [self._split(c) for c in as_list(raw.filter(pc.invert(plain)))]
        word = pa.concat_arrays([low, pa.array([w for w, _ in parts if w], type=pa.binary())]).dictionary_encode()
        # Places among words and others, whose first one is empty.
        has_word, others = is_plain.copy(), {b"": 0}
        has_word[~is_plain] = [bool(w) for w, _ in parts]
        words, other = np.zeros(len(chunks), dtype=np.int64), np.zeros(len(chunks), dtype=np.int64)
        at = word.indices.to_numpy(zero_copy_only=False) + 1
        words[is_plain], words[has_word & ~is_plain] = at[: len(low)], at[len(low) :]
        tail = (pc.binary_length(chunks).to_numpy(zero_copy_only=False) - pc.binary_length(stems).to_numpy(zero_copy_only=False)) * is_plain
        tailed = np.flatnonzero(tail)
        other[tailed] = [others.setdefault(c[-n:], len(others)) for c, n in zip(as_list(raw.take(pa.array(tailed))), tail[tailed].tolist(), strict=True)]
        other[~is_plain] = [others.setdefault(t, len(others)) for _, t in parts]
        ids, n = self.words.ids_of(word.dictionary, self._plain)
        more, m = self.others.ids_of(pa.array(others, type=pa.binary()), self._whole)
        ids, length = np.concatenate([ids, more]), np.concatenate([np.zeros(1, dtype=np.int64), n, m])
        rows = np.stack([words, other + len(n) + 1], axis=1).ravel()
        part = length[rows]
        return ids[gather((np.cumsum(length) - length)[rows], part)], part[::2] + part[1::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and their number for each; a null text has none."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        if not len(split):
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        n_chunks = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = split.flatten().dictionary_encode()
        own, length = self._distinct(distinct.dictionary)
        # The ids of the distinct chunks as a value each, of which all chunks take theirs.
        size = own.itemsize
        ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(length) * size])
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(own)])
        _, ends, ids = values.take(distinct.indices).buffers()
        total, last = np.frombuffer(ends, dtype=np.int64) // size, np.cumsum(n_chunks)
        n = total[last] - total[last - n_chunks]
        return np.frombuffer(ids or b"", dtype=np.uint32)[: total[last[-1]]], n


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this process for a tokenizer file; workers are used again by later tasks.

    The library's own threads are off in it: a task has one core, and they cost more than they bring.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
