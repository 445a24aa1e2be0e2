"""Benchmark decontamination by winnowing.

Texts are cut into words; a window is ``window`` consecutive words of a
benchmark item (a shorter item that has words is one window). Winnowing keeps,
of each ``window - gram + 1`` consecutive k-gram hashes, the smallest, the
rightmost of equals. Whatever two texts share over ``window`` words or more
holds one such run of k-grams whole, so that both sides keep the same hash:
every sufficiently long shared span is found. Kept document fingerprints that
the benchmark has too are extended to the windows around them, which are
compared whole (as 64-bit hashes of the words' sequence).

Items shorter than a window are outside that guarantee; their own length is
then the gram length and every gram is kept, i.e. winnowing in windows of one.

The benchmark index is broadcast only while it has at most ``limit_words``
words. A larger benchmark takes the other way: the documents' fingerprints are
joined with the distinct ones of all items by a shuffle, extended to windows, and
these joined with the items' by their hashes; a hash that very many documents
have is dealt out over tasks.

Cases: null texts have no words: nothing is hit, and an item of null text has no
window. Items without identifier hit like others, but are not among the items
listed. Rows with one identifier and one text are one document in the join and
come back as often as they were; items with one identifier are one item. Of
equal hashes in a run the rightmost is kept, on both sides. A text of any length
is taken whole. Empty tables on either side give no hits. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.llm.common import free_name, map_column, settle, small
from chronosift.llm.textops import byte_map, grams, mix, splitmix, word_hashes

WINDOW, GRAM = 10, 5
#: Words of a benchmark whose index may be broadcast: some 50 MB.
LIMIT_WORDS = 2_000_000


#: Words are runs of digits, letters (A-Z put into lower case) and bytes beyond ASCII.
WORDS = byte_map(bytes(c for c in range(256) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80))


def hashes_of(texts: pa.Array) -> list[np.ndarray]:
    """The word hashes of each text."""
    h, at = word_hashes(texts, WORDS)
    return [h[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the fingerprints kept: of each run of width hashes the smallest, rightmost of equals."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    low = hashes[:n].copy()
    place = np.zeros(n, dtype=np.int64)
    for i in range(1, width):
        other = hashes[i : i + n]
        better = other <= low
        low[better] = other[better]
        place[better] = i
    place += np.arange(n)
    return np.unique(place)


@dataclass
class Index:
    """Windows of the items. Per length: ascending window hashes and, for each, its items (CSR)."""

    items: list
    fingerprints: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    window: int
    gram: int

    @classmethod
    def of(cls, texts: list[tuple[object, str | None]], window: int = WINDOW, gram: int = GRAM) -> Index:
        found, prints = {}, [np.empty(0, dtype=np.uint64)]
        items = sorted({i for i, _ in texts if i is not None})
        rank = {x: k for k, x in enumerate(items)} | {None: len(items)}
        for (item, _), h in zip(texts, hashes_of(pa.array([t for _, t in texts], type=pa.string())), strict=True):
            if not len(h):
                continue
            length = min(window, len(h))
            found.setdefault(length, []).append((grams(h, length), rank[item]))
            if length == window:
                g = grams(h, gram)
                prints.append(g[winnow(g, window - gram + 1)])
        by_length = {}
        for length, rows in found.items():
            keys = np.concatenate([k for k, _ in rows])
            owner = np.concatenate([np.full(len(k), r, dtype=np.int64) for k, r in rows])
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            keys, owner = keys[new], owner[new]
            distinct, first = np.unique(keys, return_index=True)
            by_length[length] = (distinct, np.append(first, len(keys)), owner)
        return cls(items, np.unique(np.concatenate(prints)), by_length, window, gram)

    def match(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Starts and ends of the merged hit spans of a document's word hashes, and the ranks of its items with identifiers."""
        n, starts, lengths, owners = len(h), [], [], []
        for length, (keys, first, owner) in self.by_length.items():
            if n < length:
                continue
            if length == self.window:
                g = grams(h, self.gram)
                at = winnow(g, length - self.gram + 1)
                at = at[_among(g[at], self.fingerprints)]
                if not len(at):
                    continue
                near = np.unique((at[:, None] - np.arange(length - self.gram + 1)[None, :]).ravel())
                near = near[(near >= 0) & (near <= n - length)]
                w = grams(h, length)[near]
            else:
                near, w = np.arange(n - length + 1), grams(h, length)
            place = np.searchsorted(keys, w)
            ok = place < len(keys)
            ok[ok] = keys[place[ok]] == w[ok]
            near, place = near[ok], np.unique(place[ok])
            starts.append(near)
            lengths.append(np.full(len(near), length, dtype=np.int64))
            owners += [owner[first[p] : first[p + 1]] for p in place]
        if not owners:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), []
        start, length = np.concatenate(starts), np.concatenate(lengths)
        delta = np.zeros(n + 2, dtype=np.int64)
        np.add.at(delta, start + 1, 1)
        np.add.at(delta, start + length + 1, -1)
        edge = np.diff((np.cumsum(delta) > 0).astype(np.int8))
        return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0], [r for r in np.unique(np.concatenate(owners)).tolist() if r < len(self.items)]


def _among(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(x), dtype=bool)
    place = np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)
    return ascending[place] == x


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": int(a), "end": int(b)} for a, b in r] for r in rows], type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, limit_words: int = LIMIT_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_words, spans (merged hit words, end exclusive), items (identifiers as strings, sorted)."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("rows")).first()
    # A word has a character and one beside it, so this bounds the words without cutting them.
    if (size["n"] or 0) // 2 + size["rows"] <= limit_words:
        return _broadcast(docs, items, window, gram, id_col, text_col)
    return _shuffled(docs, items, window, gram, id_col, text_col)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose text has no window of an item. A row is known by its identifier and the hash of its text."""
    text_col, key = options.get("text_col", "text"), free_name(docs, "key")
    keyed = docs.withColumn(key, F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("h")))
    found = find(keyed, benchmark, id_col=key, **options).filter(F.size("spans") > 0)
    hit = found.select(F.col(f"{key}.id").alias("hit_id"), F.col(f"{key}.h").alias("hit_h")).distinct()
    same = keyed[f"{key}.id"].eqNullSafe(hit["hit_id"]) & (keyed[f"{key}.h"] == hit["hit_h"])
    return keyed.join(hit, same, "left_anti").drop(key)


def _broadcast(docs: DataFrame, items: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Index.of([(r["item"], r["text"]) for r in items.collect()], window, gram))

    def kernel(batches: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        index = shared.value
        for texts in batches:
            counts, spans, found = [], [], []
            for h in hashes_of(texts):
                start, end, owners = index.match(h)
                counts.append(len(h))
                spans.append(list(zip(start, end, strict=True)))
                found.append(sorted(index.items[o] for o in owners))
            yield [pa.array(counts, type=pa.int64()), _spans(spans), pa.array(found, type=pa.list_(pa.string()))]

    fields = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    return map_column(docs, text_col, fields, kernel, [id_col])


#: A hash that more rows than HOT have is joined in parts: its rows are dealt out over SALTS tasks.
HOT, SALTS = 10_000, 32


def _met(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """rows joined with known by hash x; the rows of a hash that very many have are dealt out, and what is known of it is copied."""
    hot = rows.groupBy("x").count().filter(F.col("count") > HOT).select("x")  # a row for HOT of rows at most
    if hot.isEmpty():
        return rows.join(known, "x", how)
    hot = small(hot.withColumn("hot", F.lit(True)))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "h"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    parts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    a = rows.join(hot, "x", "left").withColumn("part", part).drop("hot")
    b = known.join(hot, "x", "left").withColumn("part", F.explode(parts)).drop("hot")
    return a.join(b, ["x", "part"], how).drop("part")


def _places(df: DataFrame, text_col: str, keep: list[str], of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """keep, n_words, and x and at: the hashes that of() gives of a text's words, and their places; one row a hash, one with null for a text without any."""

    def kernel(batches: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        for texts in batches:
            counts, found = [], []
            for h in hashes_of(texts):
                x, at = of(h)
                counts.append(len(h))
                found.append([{"x": int(a), "at": int(b)} for a, b in zip(x.astype(np.int64), at, strict=True)])
            yield [pa.array(counts, type=pa.int64()), pa.array(found, type=pa.list_(pa.struct([("x", pa.int64()), ("at", pa.int64())])))]

    pairs = T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("at", T.LongType())]))
    out = map_column(df, text_col, T.StructType([T.StructField("n_words", T.LongType()), T.StructField("found", pairs)]), kernel, keep)
    return out.select(*keep, "n_words", F.explode_outer("found").alias("f")).select(*keep, "n_words", "f.x", "f.at")


def _salted(hashes: np.ndarray, length: int) -> np.ndarray:
    """Grams of a length, told apart from those of other lengths."""
    return mix(grams(hashes, length) ^ np.uint64(splitmix(7000 + length)))


def _shuffled(docs: DataFrame, items: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """Find the documents' fingerprints among the items', extend them to windows, and join these by their hashes.

    Texts meet no items: fingerprints and windows of documents are joined with
    the distinct ones of all items, and a hit document with the items of its
    windows; a hash that very many documents have is dealt out.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))

    def prints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = grams(h, gram)
        at = winnow(g, window - gram + 1)
        return g[at], at

    def own_windows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = min(window, len(h))
        x = _salted(h, n) if n else np.empty(0, dtype=np.uint64)
        return x, np.full(len(x), n, dtype=np.int64)

    of_items = settle(_places(items, "text", ["item"], own_windows).filter("x IS NOT NULL").select("item", "x", F.col("at").alias("length")).distinct(), "windows")
    windows = of_items.select("x", "length").distinct()
    item_prints = _places(items, "text", [], prints).filter(F.col("n_words") >= window).select("x").filter("x IS NOT NULL").distinct()
    once = d.dropDuplicates(["id", "h"])
    marked = settle(_places(once, "text", ["id", "h"], prints), "prints")
    near = _met(marked.filter("x IS NOT NULL").select("id", "h", "x", "at"), item_prints, "left_semi").groupBy("id", "h").agg(F.collect_set("at").alias("ats"))
    texts = once.withColumnRenamed("id", "i").withColumnRenamed("h", "g")
    held = near.join(texts, (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("i"))).select("id", "h", "ats", "text")
    fields = T.StructType([T.StructField(n, T.LongType()) for n in ("x", "start", "length")])
    schema = T.StructType([d.schema["id"], T.StructField("h", T.LongType()), *fields])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, x, start = [], [], []
            for k, (ats, h) in enumerate(zip(b.column(2).to_pylist(), hashes_of(b.column(3)), strict=True)):
                s = np.unique((np.array(ats)[:, None] - np.arange(window - gram + 1)[None, :]).ravel())
                s = s[(s >= 0) & (s <= len(h) - window)]
                row.append(np.full(len(s), k))
                x.append(_salted(h, window)[s].astype(np.int64))
                start.append(s)
            if row:
                at = pa.array(np.concatenate(row))
                n = len(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(x)), pa.array(np.concatenate(start).astype(np.int64)), pa.array(np.full(n, window))], names=schema.names)

    found = held.mapInArrow(extend, schema)
    lengths = [r[0] for r in windows.filter(F.col("length") < window).select("length").distinct().collect()]  # under window of them
    for n in lengths:
        short = _places(once, "text", ["id", "h"], lambda h, n=n: (_salted(h, n), np.arange(max(0, len(h) - n + 1))))
        found = found.unionByName(short.filter("x IS NOT NULL").select("id", "h", "x", F.col("at").alias("start"), F.lit(n).cast("long").alias("length")))
    hits = settle(_met(found, windows.select("x"), "left_semi"), "hits")
    spans = hits.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    merged = F.aggregate("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), _merge)
    owners = _met(hits.select("id", "h", "x").distinct(), of_items.filter("item IS NOT NULL").select("x", "item"), "inner").groupBy("id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    counts = marked.groupBy("id", "h").agg(F.first("n_words").alias("n_words"))
    both = lambda a, b: (a["h"].eqNullSafe(b["g"])) & a["id"].eqNullSafe(b["i"])
    spans = spans.select(F.col("id").alias("i"), F.col("h").alias("g"), merged.alias("spans"))
    owners = owners.select(F.col("id").alias("i"), F.col("h").alias("g"), "items")
    per = counts.join(spans, both(counts, spans), "left").select("id", "h", "n_words", "spans")
    per = per.join(owners, both(per, owners), "left").select(F.col("id").alias("i"), F.col("h").alias("g"), "n_words", "spans", "items")
    rows = d.select("id", "h")
    none = {"spans": "cast(array() as array<struct<start:bigint,end:bigint>>)", "items": "cast(array() as array<string>)"}
    return rows.join(per, both(rows, per), "left").select(F.col("id").alias(id_col), "n_words", *[F.coalesce(c, F.expr(e)).alias(c) for c, e in none.items()])


def _merge(done, x):
    last = F.element_at(done, -1)
    joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
    return F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(F.concat(done, F.array(x)))


def hit_words(spans: str = "spans"):
    """Words in the merged spans."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL of the query: all windows of both sides as text, joined."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-/:-`{-\\x7F]+')"
    return f"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, {words} AS words FROM documents
), items AS (
    SELECT item_id::VARCHAR AS item, words, least({window}, len(words)) AS n FROM (SELECT item_id, {words} AS words FROM benchmark) WHERE len(words) > 0
), item_windows AS (
    SELECT DISTINCT item, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM items)
), doc_windows AS (
    SELECT row, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') AS w
    FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(words) >= n)
), hits AS (
    SELECT row, i, n, item FROM doc_windows JOIN item_windows USING (n, w)
), counted AS (
    SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT row, unnest(range(i, i + n)) AS place FROM hits) GROUP BY row
), listed AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT row, item FROM hits WHERE item IS NOT NULL) GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (row) LEFT JOIN listed USING (row)
"""
