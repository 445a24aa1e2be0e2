"""Trie of conversations' shared prefixes, rolled up by pointer jumping.

A node is a distinct sequence of first turns; its key is its depth and a 128-bit
running digest of the turns, so parents are known by key too: the digest before
the last turn. Texts are read once, for their hashes and words; turns are
numbered and digests summed up over ranges of one sorted order, so that a
conversation of any length is dealt out over tasks (``ordering.placed``).

Leaves and savings of all subtrees take a number of rounds that grows with the
logarithm of the depth. In round k a node knows its sums down to 2 ** k - 1
levels below it and its ancestor 2 ** k levels above; it adds its sums to that
ancestor's and takes over the ancestor's pointer. A node that has heard from
nobody in a round will not in a later one; it leaves once it has nobody left to
tell.

Cases: null role or text count as empty; turns are ordered with null first,
those of one turn by the hash (md5) of role and text; repeated rows are turns
of their own; rows without identifier belong to no conversation; an empty table
has no nodes, not even a root; texts of any length are taken whole; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.llm.common import settle, small_batches
from chronosift.llm.conv_repair import CRC_TABLE, _crc32
from chronosift.llm.ordering import placed
from chronosift.llm.textops import splitmix

WORD = r"[^\x20\x09-\x0D]+"
#: A conversation takes its first turns from the one whose identifier is the next multiple of this towards zero, at most so many less one.
SHARED, HEADS = 20, 4
CHAINS = {"a": splitmix(1301) | 1, "b": splitmix(1302) | 1}


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), the hashes a and b, and the words, of each turn; nothing of the texts is dealt out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.unhex(F.md5(F.concat(role, F.lit(":"), text))).alias("tie"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), role, text).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("tie")]
    return placed(settle(rows, "turns"), "conv_id", order, "placed").select("conv_id", "place", "a", "b", "words")


def heads_of(conv: Column) -> Column:
    """Turns that a conversation takes from the shared one."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("long")


def rebuilt(turns_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their turns (conv_id, seg, place, a, b, words) after the first ones are taken from the shared conversation."""
    convs = settle(turns_.select("conv_id").distinct(), "conversations")
    takes = convs.select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"), heads_of(F.col("conv_id")).alias("h")).filter("h > 0")
    shared = turns_.filter((F.col("conv_id") % SHARED == 0) & (F.col("place") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    heads = takes.join(shared, "base").filter("place < h").select(F.col("c").alias("conv_id"), F.lit(0).alias("seg"), "place", "a", "b", "words")
    own = turns_.filter(F.col("place") >= heads_of(F.col("conv_id"))).select("conv_id", F.lit(1).alias("seg"), "place", "a", "b", "words")
    return convs, own.unionByName(heads)


#: A node's key.
KEY = ["depth", "a", "b"]



def nodes_of(members: DataFrame) -> DataFrame:
    """depth, a, b (the key), up_a, up_b (the parent's), conv_id, n_convs and words of each node but the root, from the turns of all members."""
    named = members.select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "a_before", "b_before", "words")
    return named.groupBy(*KEY).agg(
        F.min("a_before").alias("up_a"), F.min("b_before").alias("up_b"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words")
    )


def rolled_up(live: DataFrame, deepest: int) -> DataFrame:
    """depth, a, b, n_leaves and saved of whole subtrees, from those of nodes (depth, a, b, up_a, up_b, n_leaves, saved).

    deepest: the greatest depth; parents of depth 0 are not rows.
    """
    done, jump = [], 1
    while deepest > jump:
        tells = live.filter(F.col("depth") > jump)
        heard = tells.groupBy((F.col("depth") - jump).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = live.filter(F.col("depth") > jump).select((F.col("depth") + jump).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("up_a").alias("next_a"), F.col("up_b").alias("next_b"))
        far = live.filter(F.col("depth") > 2 * jump).join(above, ["depth", "up_a", "up_b"]).select(*KEY, F.col("next_a").alias("up_a"), F.col("next_b").alias("up_b"), "n_leaves", "saved")
        near = live.filter(F.col("depth") <= 2 * jump)
        told = far.unionByName(near).join(heard, KEY, "left")
        after = settle(
            told.select(
                *KEY, "up_a", "up_b", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                (F.col("more_leaves").isNull() & (F.col("depth") <= 2 * jump)).alias("over"),
            ), "jump",
        )
        done.append(after.filter("over").select(*KEY, "n_leaves", "saved"))
        live, jump = after.filter("NOT over").drop("over"), 2 * jump
    return reduce(DataFrame.unionByName, [*done, live.select(*KEY, "n_leaves", "saved")])


def ends_of(last: DataFrame) -> DataFrame:
    """depth, a, b and ends_sha256: the digest of the identifiers, ascending, of the conversations (conv_id) that end at a node.

    A digest is one chain: the identifiers of a node pass one task, sorted, and are not held.
    """
    ordered = last.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, sha = [*KEY, "ends_sha256"], None, None

        def row(found):
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*found, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], names=names)

        for b in batches:
            found = []
            for *key, conv in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if key != now:
                    if now is not None:
                        found.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(str(conv).encode())
                else:
                    sha.update(f",{conv}".encode())
            if found:
                yield row(found)
        if now is not None:
            yield row([(*now, sha.hexdigest())])

    return ordered.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of rebuilt conversations: conv_id (the smallest member's), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    small_batches(conversations.sparkSession)
    turns_ = turns(conversations)
    convs, parts = rebuilt(turns_)
    members = _members(parts)
    nodes = settle(nodes_of(members), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0

    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    full = settle(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    own = full.select(*KEY, "up_a", "up_b", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = rolled_up(own, deepest)

    last = members.groupBy("conv_id").agg(F.max(F.struct("place", "a", "b")).alias("z")).select("conv_id", (F.col("z.place") + 1).alias("depth"), "z.a", "z.b")
    turnless = convs.join(last.select("conv_id"), "conv_id", "left_anti").select("conv_id", *(F.lit(0).cast("long").alias(c) for c in KEY))
    ends = ends_of(settle(last.unionByName(turnless), "ends"))

    # The root: one row.
    all_ = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    below = full.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.coalesce(F.sum(F.when(F.col("n_children") == 0, 1)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("words")), F.lit(0)).alias("saved"))
    zero = [F.lit(0).cast("long").alias(c) for c in KEY]
    root = all_.join(F.broadcast(below)).select(*zero, F.lit(None).cast(convs.schema["conv_id"].dataType).alias("parent_conv_id"), "conv_id", "n_convs", "n_children", "n_leaves", "saved")

    first = root.select(F.col("conv_id").alias("root_conv_id"))
    parents = full.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    deep = full.filter("depth > 1").join(parents, ["depth", "up_a", "up_b"])
    top = full.filter("depth = 1").join(F.broadcast(first)).withColumnRenamed("root_conv_id", "parent_conv_id")
    columns = [*KEY, "parent_conv_id", "conv_id", "n_convs", "n_children"]
    inner = deep.select(*columns).unionByName(top.select(*columns)).join(sums, KEY)
    out = inner.unionByName(root).join(ends, KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def _members(parts: DataFrame) -> DataFrame:
    """The turns of rebuilt conversations with their place there and the running digests."""
    rows = settle(parts.withColumnRenamed("place", "was"), "rebuilt")
    return placed(rows, "conv_id", [F.col("seg"), F.col("was")], "members", CHAINS)


def oracle() -> str:
    """DuckDB SQL for trie(): prefixes by running texts of hashes, subtrees by each node's ancestors."""
    return f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || ':' || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id AS c, conv_id - conv_id % {SHARED} AS base, {_crc32("conv_id::VARCHAR")} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t) x, crc_table),
parts AS (SELECT c.c, 0 AS seg, p, role, text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h UNION ALL SELECT c.c, 1, p, role, text FROM c JOIN t ON t.conv_id = c.c AND t.p > c.h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY seg, p) AS d, md5(length(role) || ':' || role || ':' || text) AS m, len(regexp_extract_all(text, '{WORD}')) AS words FROM parts),
keyed AS (SELECT c, d, words, md5(string_agg(m, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM r),
member AS (SELECT c, d, k, lag(k, 1, 'root') OVER (PARTITION BY c ORDER BY d) AS parent, words FROM keyed UNION ALL SELECT c, 0, 'root', NULL, 0 FROM c),
node AS (SELECT k, d, min(c) AS conv_id, min(parent) AS parent, count(*) AS n, min(words) AS words FROM member GROUP BY k, d),
children AS (SELECT parent, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent),
ends AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, arg_max(k, d) AS k FROM member GROUP BY c) x GROUP BY k),
sums AS (SELECT a.k, count(*) FILTER (ch.n IS NULL) AS leaves, sum((n.n - 1) * n.words) AS saved
  FROM node n JOIN member a ON a.c = n.conv_id AND a.d <= n.d LEFT JOIN children ch ON ch.parent = n.k GROUP BY a.k)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(ch.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM node n JOIN sums s ON s.k = n.k LEFT JOIN node up ON up.k = n.parent LEFT JOIN children ch ON ch.parent = n.k LEFT JOIN ends e ON e.k = n.k
"""
