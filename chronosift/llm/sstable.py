"""Token ids in sorted-string-table shards.

A shard is one immutable file of entries in ascending key order::

    block*  Bloom filter  block index  footer

An entry is (shared key bytes, own key bytes, value length, value), the key cut
by the bytes it shares with the one before it. Keys start afresh at each block,
so a block is decoded alone. A block holds entries until BLOCK_BYTES are
reached (a longer document has a block to itself) and is compressed. The sparse
index has the first key, place and length of each block; the Bloom filter says
which keys cannot be in the shard; the footer has fixed length and the places
of both. A lookup reads the footer, filter and index, then one block by binary
search.

Keys are document identifiers as 8 bytes whose byte order is the integers'
order. Values are token ids, 2 or 4 bytes each, as the footer tells.

Cases: identifiers are integers (others stop the query, as their order would
not be the keys'); a null identifier is the empty key, before all others;
documents with the same identifier, repeated rows too, are all kept, ordered by
a hash of their text; a null or empty text has no ids but the end id; a text of
any length is one entry, in a block of its own if it is long; an empty table
has no shards; other columns are ignored.

Writing is safe from lost executors: a task writes under a name of its own and
renames at the end; a repeated task renames the same bytes into place.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronosift.llm import tokens
from chronosift.llm.common import fresh_path, small_batches, trim

BLOCK_BYTES = 64 * 1024
#: Values in a shard before it is closed; bounds a shard's index and filter, and what a reader holds.
SHARD_BYTES = 32 * 1024 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"CSSTABL1"
#: Place and length of filter and index, entries, ids, bytes an id, magic.
FOOTER = struct.Struct("<QQQQQQB8s")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    """Bloom filter with double hashing."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        size = max(64, len(keys) * BLOOM_BITS + 7 & ~7)
        out = cls(np.zeros(size // 8, dtype=np.uint8))
        for k in keys:
            for place in out._places(k):
                out.bits[place >> 3] |= 1 << (place & 7)
        return out

    def _places(self, key: bytes) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key)
        a, b, n = h & (1 << 64) - 1, h >> 64 | 1, len(self.bits) * 8
        return [(a + i * b) % n for i in range(BLOOM_HASHES)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


@dataclass
class ShardWriter:
    """Appends entries in ascending key order to an open stream."""

    out: object
    id_bytes: int
    at: int = 0
    entries: int = 0
    ids: int = 0
    last: bytes | None = None
    first: bytes | None = None
    block: bytearray = field(default_factory=bytearray)
    block_first: bytes = b""
    index: list[tuple[bytes, int, int]] = field(default_factory=list)
    keys: list[bytes] = field(default_factory=list)

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        if not self.block:
            self.block_first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(value)) + value
        if self.first is None:
            self.first = key
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.last = key
        self.entries += 1
        self.ids += len(value) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.block:
            data = zlib.compress(bytes(self.block), 1)
            self.index.append((self.block_first, self.at, len(data)))
            self.out.write(data)
            self.at += len(data)
            self.block = bytearray()

    def finish(self) -> None:
        self._close_block()
        bloom = Bloom.of(self.keys).bits.tobytes()
        index = b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index)
        self.out.write(bloom + index + FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), self.entries, self.ids, self.id_bytes, MAGIC))


class ShardReader:
    """Reads a shard by ranges: only the blocks asked for are fetched."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        b_at, b_n, i_at, i_n, self.entries, self.ids, self.id_bytes, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.bloom = Bloom(np.frombuffer(source.read_at(b_n, b_at), dtype=np.uint8))
        raw, at = bytes(source.read_at(i_n, i_at)), 0
        self.index: list[tuple[bytes, int, int]] = []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key = raw[at : at + n]
            place, at = _read_varint(raw, at + n)
            length, at = _read_varint(raw, at)
            self.index.append((key, place, length))
        self.firsts = [k for k, _, _ in self.index]

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, length = self.index[i]
        buf, at, key = zlib.decompress(self.source.read_at(length, place)), 0, b""
        while at < len(buf):
            shared, at = _read_varint(buf, at)
            own, at = _read_varint(buf, at)
            key = key[:shared] + buf[at : at + own]
            n, at = _read_varint(buf, at + own)
            yield key, buf[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key, in order; none if it is absent."""
        if key not in self.bloom:
            return []
        i = max(0, bisect_right(self.firsts, key) - 1)
        while i > 0 and self.firsts[i] == key:  # equal keys may have begun in a block before
            i -= 1
        found = []
        for j in range(i, len(self.index)):
            if self.firsts[j] > key:
                break
            found += [v for k, v in self._block(j) if k == key]
        return found

    def widen(self, value: bytes) -> bytes:
        """A value's ids as little-endian uint32."""
        return value if self.id_bytes == 4 else np.frombuffer(value, dtype="<u2").astype("<u4").tobytes()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is local."""
    if not urlparse(uri).scheme:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def open_shard(uri: str) -> ShardReader:
    fs, path = open_fs(uri)
    return ShardReader(fs.open_input_file(path))


MANIFEST = "shard string, ord long, part long, first_key binary, last_key binary, n_docs long, n_tokens long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, partitions: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards of docs under folder and return their manifest, as a lazy frame.

    Documents are dealt by ranges of (identifier, text hash), so that many rows
    with one identifier do not meet in one task, and sorted in each range; each
    task encodes and writes its own shards. tokenizer is the path of a file of
    the tokenizers library; end_id is appended to each document. Null texts are
    documents without ids but the end id.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    ranged = rows.repartitionByRange(partitions, "id", "h").sortWithinPartitions("id", "h").select("id", "t")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        trim()
        id_bytes = 2 if enc.tok.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        tail = b"" if end_id is None else end_id.to_bytes(id_bytes, "little")
        fs, base = open_fs(folder)
        fs.create_dir(base)
        n, writer, stream, temp, size = 0, None, None, "", 0

        def close() -> pa.RecordBatch:
            nonlocal n, writer
            writer.finish()
            stream.close()
            name = f"{part:06d}-{n:05d}.sst"
            fs.move(temp, f"{base}/{name}")
            row = pa.RecordBatch.from_pylist(
                [{"shard": f"{folder}/{name}", "ord": part * 100_000 + n, "part": part, "first_key": writer.first, "last_key": writer.last, "n_docs": writer.entries, "n_tokens": writer.ids}],
                schema=pa.schema([("shard", pa.string()), ("ord", pa.int64()), ("part", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )
            n, writer = n + 1, None
            return row

        for b in batches:
            found, counts = enc.encode(b.column(1))
            values, ends = found.astype(f"<u{id_bytes}").tobytes(), (np.cumsum(counts) * id_bytes).tolist()
            for doc_id, at, end in zip(b.column(0).to_pylist(), [0, *ends], ends, strict=False):
                if writer is None:
                    temp, size = f"{base}/.{part}-{uuid.uuid4().hex}", 0
                    stream = fs.open_output_stream(temp)
                    writer = ShardWriter(stream, id_bytes)
                value = values[at:end] + tail
                writer.add(key_of(doc_id), value)
                size += len(value)
                if size >= SHARD_BYTES:
                    yield close()
        if writer is not None:
            yield close()

    return ranged.mapInArrow(run, MANIFEST)


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids in all shards before each.

    One row a shard goes through one task; ids are counted in partial sums.
    """
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read(manifest: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every entry, read from the files.

    manifest has ``shard`` and ``start``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, rows = open_shard(shard), []
                for key, value in reader:
                    n = len(value) // reader.id_bytes
                    rows.append((id_of(key), start, n, zlib.crc32(reader.widen(value)), shard))
                    start += n
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    small_batches(manifest.sparkSession)
    return manifest.select("shard", "start").repartition(partitions, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def encode_to_shards(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None, partitions: int | None = None) -> tuple[DataFrame, int]:
    """Write shards (by default in the shared folder) and their manifest; return it with starts, and the number of read tasks."""
    folder = folder or fresh_path(spark, "token-shards")
    partitions = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    write(docs, f"{folder}/data", tokenizer, end_id, partitions).write.parquet(f"{folder}/manifest")
    return with_starts(spark.read.parquet(f"{folder}/manifest")), partitions


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids of a document, from the shards whose key range holds it."""
    key = key_of(doc_id)
    rows = manifest.filter((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).select("shard", "ord").orderBy("ord").collect()
    out: list[np.ndarray] = []
    for r in rows:
        reader = open_shard(r["shard"])
        out += [np.frombuffer(reader.widen(v), dtype="<u4") for v in reader.get(key)]
    return out
