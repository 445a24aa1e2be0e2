import io
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from chronosift.llm import queries, sstable, tokens
from tests.llm import helpers


class Source:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def expected(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [queries.END_ID]) for r in rows]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    out, start = [], 0
    for d, x in ids:
        out.append((d, start, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
        start += len(x)
    return out


def same_ids(texts, **options):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = [e.ids for e in tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    enc = tokens.ChunkEncoder(queries.tokenizer_path(), **options)
    for size in (len(texts), 7):
        for i in range(0, len(texts), size):
            ids, n = enc.encode(pa.array(texts[i : i + size], type=pa.string()))
            ends = np.cumsum(n).tolist()
            assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == want[i : i + size]


def test_chunked_encoding_equals_whole_texts():
    texts = [r[1] for r in helpers.awkward_rows()] + ["it's we'll A<|endoftext|>b <|startoftext|>", "é ́x a b", "don 't 's", "x" * 3000, "İ..", "क़.", "ΣΑΣ, σας.", "H\u0331. h\u0331.", "\u212b. \u212a, \ufb01."]
    same_ids(texts, limit=3)
    same_ids(texts)


def test_encoding_of_random_texts():
    """Letters, marks, digits, signs and white space of many scripts."""
    rng = random.Random(8)
    alphabet = "aAzZéÉİıßẞſΣσςКкҐїאבעربक़ि日本ｶ한ᄀ" + "\u0300\u0301\u0307\u0331\u093c\u0345" + "019²½.,.,.,'`-_*$<|>" + " \t\n\r\x0b\x0c\x1c\x85\xa0\u2028\u3000" + "ǅﬁÅK\u1e9e\U0001f600"
    words = ["the", "Of", "and.", "l'amour,", "über", "ÜBER..", "'s", "don't", "NATION,."]
    texts = ["".join(rng.choice([rng.choice(alphabet), rng.choice(alphabet), " " + rng.choice(words) + " ", rng.choice(words)]) for _ in range(rng.randrange(25))) for _ in range(4000)]
    same_ids(texts, limit=2000)


def test_plain_letters_are_encoded_as_by_the_library():
    """All letters before the settled ones' end, in both cases, alone and in words with tails."""
    letters = [c for c in map(chr, range(0x590)) if c.isalpha()]
    same_ids([f"{c} {c}a., b{c}{c.upper()}. {c.lower()}\u0301" for c in letters] + ["".join(letters), " ".join(letters)])


def test_words_met_again_stay_remembered(monkeypatch):
    """Beyond the limit, only words that came once are encoded again; the library's threads, which cost more CPU, are off."""
    enc = tokens.ChunkEncoder(queries.tokenizer_path(), limit=50)
    asked = []
    plain = enc._plain
    monkeypatch.setattr(enc, "_plain", lambda words: (asked.extend(words.to_pylist()), plain(words))[1])
    letters = "abcdefghij"
    rare = [f"z{a}{b}" for a in letters for b in letters]
    for i in range(10):
        enc.encode(pa.array(["The often met, words. " + " ".join(rare[10 * i : 10 * i + 10])]))
    assert all(asked.count(w) == 1 for w in (b"the", b"often", b"met", b"words")) and len(enc.words.words) <= 50
    enc.encode(pa.array([rare[0]]))
    assert asked.count(rare[0].encode()) == 2
    assert tokens.encoder(queries.tokenizer_path()) and os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_round_trip(spark):
    manifest, n = sstable.encode_to_shards(spark, helpers.clashing(spark), queries.tokenizer_path(), queries.END_ID, partitions=3)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sstable.read(manifest, n).collect()), key=lambda r: (r[1]))
    assert got == expected(helpers.awkward_rows())
    for doc_id, _, n_tokens, crc in got:
        found = sstable.lookup(manifest, doc_id)
        assert all(len(f) == n_tokens and zlib.crc32(f.tobytes()) == crc for f in found)
        assert len(found) == (2 if doc_id == 6 else 1)
    assert sstable.lookup(manifest, 12345) == []


def test_empty_table(spark):
    manifest, n = sstable.encode_to_shards(spark, helpers.empty(spark), queries.tokenizer_path(), queries.END_ID, partitions=2)
    assert sstable.read(manifest, n).count() == 0


def test_shard_blocks_and_lookup():
    out = io.BytesIO()
    w = sstable.ShardWriter(out, 4)
    rows = [(sstable.key_of(i - 50), bytes(4 * (i * 97 % 3000))) for i in range(200) for _ in range(1 + (i == 60) * 40)]
    for k, v in rows:
        w.add(k, v)
    w.finish()
    r = sstable.ShardReader(Source(out.getvalue()))
    assert list(r) == rows and len(r.index) > 3 and r.entries == len(rows)
    for k in {k for k, _ in rows}:
        assert r.get(k) == [v for x, v in rows if x == k]
    assert r.get(sstable.key_of(999)) == [] and r.get(b"") == []
    with pytest.raises(ValueError):
        w.add(sstable.key_of(-99), b"")
    assert sstable.id_of(sstable.key_of(-(1 << 63))) == -(1 << 63)
    assert pa.__version__
