"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word shingles, as 64-bit hashes. Two sets
of a and b shingles reach a Jaccard similarity of 75 % only if they differ in
at most (a + b) / 7 shingles, and only if neither is larger than 4/3 of the
other. Sizes are cut into bands; in a band the shingles' domain is cut into
first-level partitions, each of them into second-level ones, and subsets of the
second-level partitions of a first-level one are enumerated: each gives a
signature, a hash of all the set's shingles in it. A number of differences can
touch only so many subsets, so a set need not give all signatures: if each set
gives one more than that, those of greatest weight by an order that depends on
a signature's content alone, two similar sets share one. (Of two sets take the
one whose weakest signature is the stronger: one of its signatures is
untouched, hence the other set's too, and strong enough there.) A set takes
part in its own band and, where it can be the smaller one of a pair there, in
the next.

The weight prefers signatures with shingles that few sets have. Shingles are
counted over all documents, by lossy counting in each task; the counts
influence how many candidates there are, never which pairs are found.

Equal sets are one node, whatever the number of copies. Nodes that share a
signature, in its bucket, are candidates; each candidate pair that may still
join two components is compared exactly. First each node is compared with the
heaviest pivot of its buckets, which joins large groups of near copies in linear
time. Then all pairs of nodes of a small bucket in different components are
compared; nodes of larger buckets that are still open are sifted by their
rarest shingles first (a prefix filter, exact too), so that a popular text's
altered copies need not all be compared with one another. What then remains is
compared in slices of bounded size.

No bucket meets in one task: what a task has of a bucket beyond LOCAL nodes is
dealt out by node, buckets are otherwise only aggregated and joined, and a
pivot's partners are dealt out in parts of PARTNERS.

Cases: a text without words, or null, has an empty set, linked with nothing; a
document without identifier has no component (null) but its copies do, and
links through it count; rows with one identifier are treated each by its text;
a tie in similarity (75 % exactly) is a link; a text of any length is taken
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chronosift.llm.common import BROADCAST_ROWS, forget, free_name, map_column, release, settle, small, small_batches, trim
from chronosift.llm.components import connected
from chronosift.llm.textops import PLACES, distinct_sorted, grams, mix, splitmix, word_hashes

SHINGLE = 5
#: Largest size in a band is so many times the smallest, about (4 / 3) ** 3.
BAND_RATIO = 2.37
#: Bands up to these sizes have one first-level partition with pairs of many second-level ones, or pairs of three; larger ones single partitions.
PAIRS_UP_TO, TRIPLES_UP_TO = 24, 256
#: Single partitions in a band, as a share of its largest size; first-level partitions of three, as a share of the possible differences.
PARTITIONS, TRIPLES = 0.4, 0.5
#: Shingles counted between two prunings of a task's counts; a count is too high by one for each so many at most.
COUNTED = 1_000_000
#: A task reports shingles that it met so often; those reported so often in all are common, and so many are remembered, the commonest first.
REPORTED_FROM, COMMON_FROM, COMMON = 4, 128, 200_000
#: Set hashes of which a task remembers that it has counted them or given their signatures.
SEEN = 100_000
#: Signatures that a task gathers before it sends them; of a bucket among them so many nodes (2 at least) meet the others, the rest is dealt out by node.
GATHER, LOCAL = 250_000, 8
#: Signatures a task sorts, and shingles whose signatures are found at once, on average; both bound a worker's memory.
SORTED, AT_ONCE = 600_000, 60_000
#: A bucket with more rows than this is joined with what is known of it by a broadcast of such buckets.
HOT = 1024


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the ascending distinct shingle hashes; a text of fewer than n words is one shingle."""
    h, at = word_hashes(texts)
    whole = grams(h, n)
    at = at.tolist()
    return [distinct_sorted(whole[a : b - n + 1]) if b - a >= n else grams(h[a:b], b - a) if b > a else whole[:0] for a, b in zip(at[:-1], at[1:], strict=True)]


def set_hash(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


@dataclass(frozen=True)
class Method:
    """Which sets are linked, and how candidates are found.

    Documents are sets of shingles of so many words, linked from a similarity
    of percent on; sets of fewer than least shingles are similar to equal ones
    alone. give, called with the session and the scanned documents, returns the
    function that gives buckets, and each one's place, of a list of sets in a
    task. Where vector is given, candidates are screened: vector makes bytes of
    a set, near tells of two sets' bytes whether the sets are to be compared.
    """

    shingle: int
    percent: int
    least: int
    give: Callable[[SparkSession, DataFrame], Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]]
    counts: bool = False
    vector: Callable[[list[np.ndarray]], list[bytes]] | None = None
    near: Callable[[list[bytes], list[bytes]], np.ndarray] | None = None
    at_once: int = 0  # in place of PAIRS_AT_ONCE, where screens make more pairs cheap

    def sizes_allow(self, a: str, b: str) -> str:
        return f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})"

    def both(self, n: str) -> str:
        """Least shingles that similar sets of n in all share."""
        return f"({self.percent} * ({n}) + {99 + self.percent}) div {100 + self.percent}"

    def prefix(self, n: str) -> str:
        """Shingles of a set of n of which a similar set has one."""
        return f"{n} - ({self.percent} * {n} + 99) div 100 + 1"


def largest_partner(size):
    return 4 * size // 3


def differences(size):
    """Most differences of a set of this size from one similar to it."""
    return (size + largest_partner(size)) // 7


@dataclass(frozen=True)
class Band:
    """How the sets that meet in one band of sizes are partitioned: ``first`` partitions of ``second`` each, of which ``subset`` are taken together."""

    low: int
    high: int
    first: int
    second: int
    subset: int

    @classmethod
    def of(cls, low: int, high: int) -> Band:
        most = differences(high)
        if high <= PAIRS_UP_TO:
            return cls(low, high, 1, most + 3, 2)
        if high <= TRIPLES_UP_TO:
            return cls(low, high, max(int(TRIPLES * most) + 1, most // 2 + 1), 3, 2)
        return cls(low, high, max(int(PARTITIONS * high) + 1, most + 2), 1, 1)

    @property
    def parts(self) -> int:
        return self.first * self.second

    @property
    def given(self) -> int:
        """Signatures of a set, if it gave all."""
        return self.first * comb(self.second, self.subset)

    def needed(self, k: int) -> int:
        """Signatures of which one at least is shared by sets with k differences at most.

        The differences touch most subsets if they are spread evenly over the
        first-level partitions: each further one there touches fewer new ones.
        """
        each, more = divmod(min(k, self.parts), self.first)
        touched = [comb(self.second, self.subset) - comb(max(0, self.second - j), self.subset) for j in (each, each + 1)]
        return (self.first - more) * touched[0] + more * touched[1] + 1


def _bands(up_to: int = 1 << 40) -> list[Band]:
    low, out = 3, []
    while low <= up_to:
        high = int(low * BAND_RATIO)
        out.append(Band.of(low, high))
        low = high + 1
    return out


BANDS = _bands()
_HIGHS = np.array([b.high for b in BANDS])


def _picked(weight: np.ndarray, need: int) -> np.ndarray:
    return np.argpartition(weight, len(weight) - need)[len(weight) - need :] if need < len(weight) else np.arange(len(weight))


def signatures_of(sets: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets of 3 shingles or more (smaller ones are similar to equal ones only), and the place of each one's set.

    common has the shingles that many sets have, ascending.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    x = np.concatenate([np.empty(0, dtype=np.uint64), *sets])
    rare = np.ones(len(x), dtype=bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, x), len(common) - 1)] != x
    content = mix(x ^ PLACES[9])
    own, next_ = np.searchsorted(_HIGHS, size), np.searchsorted(_HIGHS, largest_partner(size))
    sigs, places = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for number in np.unique(np.concatenate([own, next_])).tolist():
        band, who = BANDS[number], np.flatnonzero((own == number) | (next_ == number))
        n = size[who]
        # All elements of these sets, and the second-level partition (of all sets') each is in.
        at = np.repeat(start[who] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        slot = (((x[at] >> np.uint64(32)) * np.uint64(band.parts)) >> np.uint64(32)).astype(np.int64) + np.repeat(np.arange(len(who)) * band.parts, n)
        shape = (len(who), band.first, band.second)
        count = np.bincount(slot, minlength=len(who) * band.parts)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(content[at])])[np.concatenate([[0], np.cumsum(count)])]
        salt = mix(np.arange(band.parts, dtype=np.uint64) * PLACES[7] + np.uint64(splitmix(number + 1)))
        one = mix(np.diff(sums).reshape(shape) ^ salt.reshape(shape[1:]))
        count, few = count.reshape(shape), np.bincount(slot[rare[at]], minlength=len(who) * band.parts).reshape(shape)
        if band.subset == 2:
            i, j = np.array(list(combinations(range(band.second), 2))).T
            one, count, few = mix(one[..., i] * PLACES[10] + one[..., j]), count[..., i] + count[..., j], few[..., i] + few[..., j]
        one = one.reshape(len(who), -1)
        weight = (np.minimum(few, 15).astype(np.uint64) << np.uint64(60)) | (np.minimum(count, 15).astype(np.uint64) << np.uint64(56))
        weight = weight.reshape(one.shape) | (one >> np.uint64(8))
        for row, (k, w) in enumerate(zip(who.tolist(), weight, strict=True)):
            found = one[row][_picked(w, band.needed(differences(len(sets[k]))))]
            sigs.append(found)
            places.append(np.full(len(found), k, dtype=np.int64))
    return np.concatenate(sigs), np.concatenate(places)


# --- distributed steps ---------------------------------------------------------------------------


def text_hash(text_col: str) -> Column:
    """Tells the texts of rows apart that have one identifier, or none."""
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


class Counts:
    """Lossy counting of shingles: those met once or less in COUNTED are dropped, so that few are held."""

    def __init__(self, width: int = 0):
        self.width = width or COUNTED
        self.keys, self.upper = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.held: list[np.ndarray] = []
        self.waiting, self.round = 0, 0

    def add(self, s: np.ndarray) -> None:
        self.held.append(s)
        self.waiting += len(s)
        if self.waiting >= self.width:
            self._prune()

    def _prune(self) -> None:
        self.round += max(1, self.waiting // self.width)  # a long set alone can be several widths
        new, n = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.waiting = [], 0
        at = np.searchsorted(self.keys, new)
        old = np.zeros(len(new), dtype=bool)
        inside = at < len(self.keys)
        old[inside] = self.keys[at[inside]] == new[inside]
        self.upper[at[old]] += n[old]
        stay, fresh = self.upper > self.round, ~old & (n > 1)
        keys = np.concatenate([self.keys[stay], new[fresh]])
        upper = np.concatenate([self.upper[stay], n[fresh] + self.round - 1])
        order = np.argsort(keys)
        self.keys, self.upper = keys[order], upper[order]

    def often(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ascending shingles met least times or more, and how often (at most)."""
        if self.held:
            self._prune()
        return self.keys[self.upper >= least], self.upper[self.upper >= least]


def scan(docs: DataFrame, id_col: str, text_col: str, n: int = SHINGLE, counted: bool = True) -> DataFrame:
    """A row of doc_id, h (the hash of the text), n_shingles and k, the hash of the set (null if it is empty), for each document.

    If counted, other rows, of which shingle is not null, are each task's
    frequent shingles and their df; equal sets count once in a task, as far as
    it remembers them.
    """
    small_batches(docs.sparkSession)
    body = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_hash(text_col).alias("h"), F.col(f"`{text_col}`").cast("string").alias("t"))
    fields = [body.schema["doc_id"], body.schema["h"], *(T.StructField(n, T.LongType()) for n in ("n_shingles", "k", "shingle", "df"))]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, id_type = Counts(), set(), None
        for b in batches:
            found, keys, id_type = shingle_sets(b.column(2), n), [], b.column(0).type
            for s in found:
                keys.append(set_hash(s) if len(s) else None)
                if counted and keys[-1] not in seen:
                    counts.add(s)
                    if len(seen) < SEEN:
                        seen.add(keys[-1])
            none = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in found], type=pa.int64()), pa.array(keys, type=pa.int64()), none, none], names=schema.names)
        if counted and id_type is not None:
            x, df = counts.often(REPORTED_FROM)
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(x), id_type), none, none, none, pa.array(x.astype(np.int64)), pa.array(df)], names=schema.names)
        del counts, seen
        trim()

    return body.mapInArrow(run, schema)


def common_shingles(scanned: DataFrame) -> np.ndarray:
    """Ascending hashes of the shingles that most sets have."""
    often = scanned.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("df").alias("df")).filter(F.col("df") >= COMMON_FROM)
    rows = often.orderBy(F.col("df").desc(), "shingle").limit(COMMON).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(dtype=np.int64).astype(np.uint64))


#: The lowest bit of a bucket's number tells rows that are dealt out by node.
SPREAD = np.int64(1)


def _distinct(bucket: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, k) in the order of buckets, the number of nodes of each one's bucket, and its place there."""
    order = np.lexsort((k, bucket))
    bucket, k = bucket[order], k[order]
    new = np.ones(len(bucket), dtype=bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (k[1:] != k[:-1])
    bucket, k = bucket[new], k[new]
    first = np.ones(len(bucket), dtype=bool)
    first[1:] = bucket[1:] != bucket[:-1]
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(bucket)))
    return bucket, k, np.repeat(n, n), np.arange(len(bucket)) - np.repeat(at, n)


def _groups(found: dict[int, np.ndarray]) -> Iterator[dict[int, np.ndarray]]:
    """The sets in groups of about AT_ONCE shingles."""
    group, size = {}, 0
    for k, s in found.items():
        group[k] = s
        size += len(s)
        if size >= AT_ONCE:
            yield group
            group, size = {}, 0
    if group:
        yield group


def enumerated(spark: SparkSession, scanned: DataFrame) -> Callable:
    """Gives PartEnum signatures, weighed by the shingles that most sets have."""
    shared = spark.sparkContext.broadcast(common_shingles(scanned))
    return lambda sets: signatures_of(sets, shared.value)


#: The n-gram Jaccard join.
PARTENUM = Method(SHINGLE, 75, 3, enumerated, counts=True)


def signatures(docs: DataFrame, text_col: str, n: int, least: int, give: Callable) -> DataFrame:
    """(bucket, k) of all sets of least shingles or more, the bucket being a signature without its lowest bit; a task gives those of a set it remembers once only.

    Of a bucket that has more than LOCAL nodes among those gathered, the others
    have that bit set (SPREAD).
    """
    small_batches(docs.sparkSession)
    body = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))

    def sent(buckets: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        bucket, k, _, place = _distinct(np.concatenate(buckets) & ~SPREAD, np.concatenate(keys))
        order = np.argsort(k, kind="stable")  # rows with one k side by side take less room
        return pa.RecordBatch.from_arrays([pa.array((bucket | np.where(place >= LOCAL, SPREAD, 0))[order]), pa.array(k[order])], names=["bucket", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, buckets, keys, held = set(), [], [], 0
        for b in batches:
            new: dict[int, np.ndarray] = {}
            for s in shingle_sets(b.column(0), n):
                if len(s) >= least and (k := set_hash(s)) not in seen:
                    new[k] = s
                    if len(seen) < SEEN:
                        seen.add(k)
            for group in _groups(new):
                sig, place = give(list(group.values()))
                buckets.append(sig.astype(np.int64))
                keys.append(np.array(list(group), dtype=np.int64)[place])
                held += len(sig)
                if held >= GATHER:
                    yield sent(buckets, keys)
                    buckets, keys, held = [], [], 0
        if held:
            yield sent(buckets, keys)
        buckets, keys = [], []
        trim()

    return body.mapInArrow(run, "bucket long, k long")


def shared_buckets(rows: DataFrame, partitions: int) -> DataFrame:
    """(bucket, k, n) of the rows of buckets that have two nodes or more; n is the bucket's nodes as far as one task saw them.

    A task gets the rows of its buckets but the spread ones, whose buckets have
    more nodes than one anyway.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            bucket, k = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            met = (bucket & SPREAD) == SPREAD
            spread = [bucket[met] & ~SPREAD, k[met], np.full(int(met.sum()), LOCAL, dtype=np.int64)]
            bucket, k, n, _ = _distinct(bucket[~met], k[~met])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y[n > 1]])) for x, y in zip(spread, (bucket, k, n), strict=True)], names=["bucket", "k", "n"])
            del bucket, k, n, spread, met
        trim()

    key = F.when(F.col("bucket").bitwiseAND(F.lit(1)) == 1, F.col("k")).otherwise(F.col("bucket"))
    return rows.repartition(partitions, key).mapInArrow(run, "bucket long, k long, n long")


#: Buckets of at most so many nodes have all their open pairs compared; those of larger ones are sifted first.
LIGHT = 16
#: Open pairs of sifted buckets looked at at once: so many a row, or this many if there are few rows. Sizes and places rule most of them out where they are joined.
PAIRS_A_ROW, PAIRS_AT_ONCE = 20, 200_000
#: Partners of a node that are compared in one part.
PARTNERS = 1024


def node_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, method: Method) -> DataFrame:
    """(k, s, v) of the wanted nodes (k, rep, h): the set as bytes, computed from the text of the document rep, and its vector (else null).

    Where rep is null all the node's documents are without identifier, and a
    text of theirs with hash h is taken. Rows that share an identifier may give
    a node twice.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("rep"), F.col(f"`{text_col}`").cast("string").alias("t"))
    d = texts.join(small(wanted.filter("rep IS NOT NULL").select("k", "rep")), "rep").select("k", "t")
    unnamed = wanted.filter("rep IS NULL").select("k", "h")
    if not unnamed.isEmpty():
        rows = texts.filter("rep IS NULL").select("t", text_hash("t").alias("h"))
        d = d.unionByName(rows.join(small(unnamed), "h").select("k", "t").distinct())

    def kernel(batches: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        for texts in batches:
            found = shingle_sets(texts, method.shingle)
            v = method.vector(found) if method.vector else [None] * len(found)
            yield [pa.array([set_hash(s) if len(s) else None for s in found], type=pa.int64()), pa.array([s.tobytes() for s in found], type=pa.binary()), pa.array(v, type=pa.binary())]

    fields = T.StructType([T.StructField("own", T.LongType()), T.StructField("s", T.BinaryType()), T.StructField("v", T.BinaryType())])
    return map_column(d, "t", fields, kernel, ["k"]).filter("k = own").select("k", "s", "v")


def similar(a: bytes, b: bytes, percent: int = 75) -> bool:
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def screened(pairs: DataFrame, sets_of: DataFrame, few: bool, near: Callable) -> DataFrame:
    """The pairs (a, b) whose vectors are near; vectors alone are dealt out."""
    of_pairs = F.broadcast if few else lambda df: df
    a = sets_of.select(F.col("k").alias("a"), F.col("v").alias("va"))
    b = sets_of.select(F.col("k").alias("b"), F.col("v").alias("vb"))
    both = b.join(of_pairs(a.join(of_pairs(pairs), "a")), "b").select("a", "b", "va", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.select(["a", "b"]).filter(pa.array(near(x.column(2).to_pylist(), x.column(3).to_pylist()), type=pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, sets_of: DataFrame, few: bool, hot: bool, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar. Only sets of nodes in pairs are dealt out; if some node a is hot, its partners in parts of PARTNERS.

    few: there are at most BROADCAST_ROWS pairs.
    """
    small = F.broadcast if few else lambda df: df
    parted = pairs.withColumn("part", F.lit(0).cast("long"))
    if hot:
        many = pairs.groupBy("a").count().filter(F.col("count") > PARTNERS).select(F.col("a").alias("hot"), F.ceil(F.col("count") / PARTNERS).alias("of"))
        parted = pairs.join(many, pairs["a"] == F.col("hot"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("of", F.lit(1))).alias("part"))
    left = sets_of.select(F.col("k").alias("a"), F.col("s").alias("sa")).join(small(parted.select("a", "part").distinct()), "a")
    right = sets_of.select(F.col("k").alias("b"), F.col("s").alias("sb")).join(small(parted), "b")
    both = right.join(left, ["a", "part"]).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(x, y, percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, type=pa.bool_()))
        trim()

    return both.mapInArrow(run, "a long, b long")


# Rows (bucket, k, n, comp): nodes of a bucket, the bucket's size, and the components the nodes are in so far.


def _by_bucket(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows joined with known, a row for a bucket at most, so that no task gets a hot bucket's rows; there is one hot bucket for each HOT rows at most."""
    hot = rows.groupBy("bucket").count().filter(F.col("count") > HOT).select("bucket")
    n = hot.limit(BROADCAST_ROWS + 1).count()
    if not 0 < n <= BROADCAST_ROWS:
        return rows.join(known, "bucket")
    hot = F.broadcast(hot)
    cold = rows.join(hot, "bucket", "left_anti").join(known, "bucket")
    return cold.unionByName(rows.join(F.broadcast(known.join(hot, "bucket", "left_semi")), "bucket").select(*cold.columns))


def _star(rows: DataFrame) -> DataFrame:
    """For each node the pair with one pivot: of its buckets' heaviest nodes in another component the heaviest. A node weighs as much as its buckets have nodes."""
    weight = rows.groupBy("k").agg(F.sum("n").alias("weight"))
    weighed = rows.join(weight, "k")
    top = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "k", "comp")).alias("top"))
    best = _by_bucket(rows, top).filter("comp <> top.comp").groupBy("k").agg(F.max(F.struct("top.weight", "top.k")).alias("p"))
    return best.select(F.least("k", "p.k").alias("a"), F.greatest("k", "p.k").alias("b")).distinct()


def _every(rows: DataFrame) -> DataFrame:
    """All pairs of nodes of a bucket in different components; for small buckets."""
    x, y = rows.select("bucket", F.col("k").alias("a"), F.col("comp").alias("ca")), rows.select("bucket", F.col("k").alias("b"), F.col("comp").alias("cb"))
    return x.join(y, "bucket").filter("a < b AND ca <> cb").select("a", "b").distinct()


def _every_sifted(rows: DataFrame, part: int, of: int, method: Method) -> DataFrame:
    """Pairs of sifted rows in different components whose shared shingle can be their first; the pairs of one in so many nodes a.

    Similar sets share some number of shingles at least, so that the first one
    they share has as many places from it to the end in both.
    """
    x, y = (rows.select("bucket", F.col("k").alias(n), F.col("comp").alias(f"c{n}"), F.col("size").alias(f"s{n}"), F.col("place").alias(f"p{n}")) for n in ("a", "b"))
    both = x.filter(F.pmod(F.xxhash64("a"), F.lit(of)) == part).join(y, "bucket").filter("a < b AND ca <> cb").filter(method.sizes_allow("sa", "sb"))
    return both.filter(f"least(sa - pa, sb - pb) + 1 >= {method.both('sa + sb')}").select("a", "b").distinct()


def _open(buckets: DataFrame, links: _Links) -> DataFrame:
    """The rows of buckets (bucket, k, any more) whose nodes are in two components or more, with comp and the bucket's nodes n."""
    own = [c for c in buckets.columns if c not in ("comp", "n")]
    labels = links.small(links.labels)
    rows = buckets.select(*own).join(labels, F.col("k") == labels["node"], "left").select(*own, F.coalesce(labels["comp"], "k").alias("comp"))
    still = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("bucket", "n")
    return _by_bucket(rows, still).select(*own, "comp", "n")


def _open_pairs(rows: DataFrame) -> tuple[int, int]:
    """Rows, and pairs in different components of a bucket."""
    per = rows.groupBy("bucket", "comp").count().groupBy("bucket").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("same"))
    n, pairs = per.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
    return int(n or 0), int(pairs or 0)


def _sifted(nodes_: DataFrame, sets_of: DataFrame, method: Method) -> DataFrame:
    """(bucket, k, size, place) for each node and each shingle of its rarest, one more than a similar set can lack.

    Two similar sets have one of these in common: all sets' shingles are put in
    one order, the rarest among these nodes first. What copies of a common
    text have of their own is rare, so that copies changed too much to be
    similar do not meet all others again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(s, dtype=np.int64) for s in b.column(1).to_pylist()]
            keys = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(s) for s in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, dtype=np.int64), *found])), pa.array(keys, type=pa.int64()), pa.array(np.repeat([len(s) for s in found], [len(s) for s in found]).astype(np.int64))], names=["bucket", "k", "n"])

    rows = sets_of.join(nodes_, "k", "left_semi").select("k", "s").mapInArrow(run, "bucket long, k long, n long")
    spread = rows.groupBy("bucket").agg(F.count("*").alias("df")).filter("df > 1")
    own = rows.join(spread, "bucket")
    # A shingle of one node alone takes a place, but is no bucket.
    alone = rows.groupBy("k").agg(F.count("*").alias("all")).join(own.groupBy("k").agg(F.count("*").alias("shared")), "k").select("k", (F.col("all") - F.col("shared")).alias("before"))
    ranked = own.join(alone, "k").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("k").orderBy("df", "bucket")))
    return ranked.filter(f"place <= {method.prefix('n')}").select("bucket", "k", F.col("n").alias("size"), "place")


class _Links:
    """Components so far, and the pairs that were compared for them."""

    def __init__(self, sets_of: DataFrame, sizes: DataFrame, method: Method):
        self.sets_of, self.method = sets_of, method
        self.few = sizes.count() <= BROADCAST_ROWS
        self.sizes = self.small(sizes)
        self.labels = sizes.sparkSession.createDataFrame([], "node long, comp long")
        self.tested = sizes.sparkSession.createDataFrame([], "a long, b long")
        self.compared = 0

    def small(self, of_nodes: DataFrame) -> DataFrame:
        """A frame with a row of integers for each node at most, broadcast if there are few nodes."""
        return F.broadcast(of_nodes) if self.few else of_nodes

    def compare(self, pairs: DataFrame) -> bool:
        """Compare pairs of sizes that allow it and were not compared yet; whether a link was found."""
        na, nb = self.sizes.select(F.col("k").alias("a"), F.col("n").alias("na")), self.sizes.select(F.col("k").alias("b"), F.col("n").alias("nb"))
        before = F.broadcast(self.tested) if self.compared <= BROADCAST_ROWS else self.tested
        fresh = pairs.join(before, ["a", "b"], "left_anti") if self.compared else pairs
        fresh = settle(fresh.join(na, "a").join(nb, "b").filter(self.method.sizes_allow("na", "nb")).select("a", "b"), "pairs")
        n, most = fresh.groupBy("a").count().agg(F.sum("count"), F.max("count")).first()
        if not n:
            forget(fresh)
            return False
        few, near = n <= BROADCAST_ROWS, self.method.near
        close = settle(screened(fresh, self.sets_of, few, near), "close") if near else fresh
        found = settle(linked(close, self.sets_of, few, most > PARTNERS, self.method.percent), "links")
        if near:
            forget(close)
        before, self.tested = self.tested, settle(self.tested.unionByName(fresh), "pairs")
        self.compared += n
        some = not found.isEmpty()
        if some:
            self.labels = self._joined(found)
        forget(fresh, found, before)
        release(self.sets_of.sparkSession)
        return some

    def _joined(self, links: DataFrame) -> DataFrame:
        labels = self.small(self.labels)
        x, y = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        e = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        top = connected(e).select(F.col("node").alias("n"), F.col("comp").alias("c"))
        old = self.labels.join(self.small(top), self.labels["comp"] == top["n"], "left").select("node", F.coalesce("c", "comp").alias("comp"))
        new = top.join(labels.select("node"), top["n"] == F.col("node"), "left_anti").select(F.col("n").alias("node"), F.col("c").alias("comp"))
        after = settle(old.unionByName(new), "labels")
        forget(self.labels)
        return after


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", method: Method = PARTENUM) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest identifier reachable by links) of each row."""
    return _components(docs, id_col, text_col, method).drop("h")


def _components(docs: DataFrame, id_col: str, text_col: str, method: Method) -> DataFrame:
    """The columns of components, and h, the hash of the row's text."""
    spark = docs.sparkSession
    scanned = settle(scan(docs, id_col, text_col, method.shingle, method.counts), "sets")
    all_sets = scanned.filter("shingle IS NULL").drop("shingle", "df")
    nodes = all_sets.filter("k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("rep"), F.min("h").alias("h"), F.max("n_shingles").alias("n"))
    shingles = all_sets.agg(F.sum("n_shingles")).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // (2 * SORTED) + 1)  # a signature for two shingles at most
    given = signatures(docs, text_col, method.shingle, method.least, method.give(spark, scanned))
    buckets = settle(shared_buckets(given, partitions), "buckets")
    release(spark)
    wanted = settle(buckets.select("k").distinct().join(nodes, "k"), "nodes")
    found = node_sets(docs, wanted.select("k", "rep", "h"), id_col, text_col, method)
    once = all_sets.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()
    sets_of = settle(found if once else found.dropDuplicates(["k"]), "node-sets")

    links = _Links(sets_of, wanted.select("k", "n"), method)
    links.compare(_star(buckets.withColumn("comp", F.col("k"))))
    open_ = settle(_open(buckets, links), "open")
    forget(buckets)
    heavy = open_.filter(F.col("n") > LIGHT).select("k").distinct()
    if not heavy.isEmpty():
        sifted = settle(_sifted(links.small(heavy), sets_of, method), "sifted")
        release(spark)
        _resolve(sifted, links)
        forget(sifted)
    links.compare(_every(_open(open_.filter(F.col("n") <= LIGHT), links)))
    forget(open_, sets_of, links.tested)
    release(spark)

    labels = links.small(links.labels)
    lowest = nodes.join(labels, nodes["k"] == labels["node"]).select("k", F.col("comp").alias("bucket"), "rep")
    heads = lowest.groupBy("bucket").agg(F.min("rep").alias("component_id"))
    of_linked = settle(_by_bucket(lowest, heads).select(F.col("k").alias("node"), "component_id"), "heads")
    own = nodes.join(links.small(of_linked), nodes["k"] == F.col("node"), "left").select(F.col("k").alias("own"), F.coalesce("component_id", "rep").alias("component_id"))
    out = all_sets.join(own, all_sets["k"] == own["own"], "left")
    return out.select("doc_id", "h", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _resolve(sifted: DataFrame, links: _Links) -> None:
    """Compare all pairs that sifted buckets still leave open: with pivots as long as that finds links and the pairs are many, then in slices."""
    while True:
        rows = settle(_open(sifted, links), "open")
        n, pairs = _open_pairs(rows)
        at_once = max(links.method.at_once or PAIRS_AT_ONCE, PAIRS_A_ROW * n)
        if pairs <= at_once or not links.compare(_star(rows)):
            break
        forget(rows)
    slices = -(-pairs // at_once)
    for i in range(slices):
        links.compare(_every_sifted(rows, i, slices, links.method))
    forget(rows)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", method: Method = PARTENUM) -> DataFrame:
    """The rows of docs without those linked to a smaller identifier; of rows with one identifier and one text, one stays.

    A row is known by identifier and text, so that the other texts of its
    identifier, and other rows without one, stay. A row without identifier goes
    if it is linked to one; such rows linked with one another alone stay.

    Only identifiers and hashes are joined with the texts, and only identifiers
    that occur more than once have their rows dealt out by key.
    """
    comp = settle(_components(docs, id_col, text_col, method), "components")
    gone = comp.filter("component_id <> doc_id OR (doc_id IS NULL AND component_id IS NOT NULL)").select(F.col("doc_id").alias("gone"), F.col("h").alias("gone_h")).distinct()
    h = free_name(docs, "h")
    d = docs.withColumn(h, text_hash(text_col))
    d = d.join(gone, d[f"`{id_col}`"].eqNullSafe(gone["gone"]) & (d[h] == gone["gone_h"]), "left_anti").drop(h)
    again = comp.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again"))
    key = d[f"`{id_col}`"].eqNullSafe(again["again"])
    return d.join(again, key, "left_anti").unionByName(d.join(again, key, "left_semi").dropDuplicates([id_col, text_col]))


def oracle(n: int = SHINGLE, percent: int = PARTENUM.percent, more: str = "") -> str:
    """DuckDB SQL of components(): all pairs of texts that share a shingle, and all that links reach; for tables of some thousand texts."""
    return f"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
    SELECT DISTINCT row, array_to_string(list_slice(words, i, i + {n - 1}), ' ') AS shingle FROM (SELECT row, words, unnest(range(1, greatest(len(words) - {n - 1}, 1) + 1)) AS i FROM d WHERE len(words) > 0) x
), size AS (
    SELECT row, count(*) AS n FROM s GROUP BY row
), shared AS (
    SELECT a.row AS a, b.row AS b, count(*) AS n_both FROM s a JOIN s b ON a.shingle = b.shingle AND a.row < b.row GROUP BY ALL
), link AS (
    SELECT a, b FROM shared JOIN size x ON x.row = a JOIN size y ON y.row = b WHERE 100 * n_both >= {percent} * (x.n + y.n - n_both)
), edge AS (
    SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
    SELECT row, row AS at FROM d UNION SELECT r.row, e.b FROM reach r JOIN edge e ON e.a = r.at
), lowest AS (
    SELECT r.row, min(o.doc_id) AS component_id FROM reach r JOIN d o ON o.row = r.at GROUP BY r.row
)
SELECT doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, component_id{more} FROM d JOIN lowest USING (row) LEFT JOIN size USING (row)
"""
