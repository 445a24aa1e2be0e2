"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order (a seeded hash of the
identifier); a second copy of the source follows the first, so that a document
is taken at most twice. A document's virtual finish time is the words its
source has sent when all of it is sent, divided by the source's target. The
documents of all queues are sorted by finish time over the whole table, in
ranges; their words are summed up in that order, range by range; and the stream
ends where the budget, the sum of the targets, is spent: a document is in if
the larger part of it is. Documents stay whole.

Targets: sources, by code point and null last, weigh 5, 2, 1, repeating, and
share ``share`` times all words; a target stops at ``most`` times its source's
words and the excess is shared again by weight until none is above.

No task sees a whole source: the words before a document are those of the
hash buckets before its own (a small table of sums) and those before it within
the bucket. The number of buckets follows the number of documents. Repeated
rows are one unit until they are sent; each repeat has its own virtual time.

Cases: a null text has size 0 and is never needed (taken 0); a null source is
a source; of rows with equal identifier, source, size and text some may be
taken more often than others, which ones is the same in every run as far as
they differ at all; ties of finish time go by source, hash and identifier;
sources without words have target 0; a text of any length is one document; an
empty table gives no rows; other columns are ignored, and kept by ``mixed``,
whatever their names and types.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronosift.llm.common import settle

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Documents in a hash bucket of a source, on average.
BUCKET_ROWS = 1024
#: At most 2 ** BUCKET_BITS buckets, so that a source's sums stay a small table at any size.
BUCKET_BITS = 16
SEED = 20240229
#: Repeats of a row that one task sends; more are dealt out.
REPEATS = 4096


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size and content (a hash of the text) of each row."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("content"))


def targets(sized: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: one row a source, filled like linked vessels.

    A source is full at most * its words; the level of the others is what the
    full ones leave, divided by the others' weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = ranked.withColumn("level", level).withColumn("level", F.when(F.col("level") < F.col("cap") / F.col("weight"), F.col("level")))
    # The first source that does not fill up sets the level of all that come after it.
    final = levelled.withColumn("level", F.first("level", ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return final.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


UNIT = ("doc_id", "source", "size", "content")


def units(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each distinct UNIT: rows (how many the table has), h (its place in the shuffle), source_size, target and before (words of its source before it)."""
    found = sizes(docs, id_col, text_col, source_col).groupBy(*UNIT).agg(F.count("*").alias("rows"))
    h = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in UNIT[:3]])), 1, 16)
    kept = settle(found.withColumn("h", h).withColumn("unit", F.col("size") * F.col("rows")), "mix-sizes")
    bits = max(4, min(BUCKET_BITS, math.ceil(math.log2(max(1, kept.count() / BUCKET_ROWS))) + 1))
    bucket = F.shiftright(F.conv(F.substring("h", 1, 4), 16, 10).cast("int"), 16 - bits)
    shuffled = kept.withColumn("bucket", bucket)
    per = targets(shuffled.select("source", F.col("unit").alias("size")), share, most, weights)
    sums = shuffled.groupBy("source", "bucket").agg(F.sum("unit").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    o = offsets.join(per, offsets["source"].eqNullSafe(per["source"])).select(offsets["source"].alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "target")
    joined = shuffled.join(o, shuffled["source"].eqNullSafe(o["s"]) & (shuffled["bucket"] == o["b"]))
    within = Window.partitionBy("bucket", "source").orderBy("h", "doc_id", "size", "content").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("offset") + F.sum("unit").over(within) - F.col("unit")
    return joined.withColumn("before", before).select(*UNIT, "rows", "h", "source_size", "target", "before")


def _numbered(rows: DataFrame, n: Column, partitions: int) -> DataFrame:
    """Each row n times, with i from 0; many repeats of a row are dealt out."""
    parted = rows.withColumn("_n", n).filter("_n > 0").withColumn("_part", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / REPEATS).cast("long"))))
    if not rows.filter(n > REPEATS).isEmpty():
        parted = parted.repartition(partitions)
    first = F.col("_part") * REPEATS
    return parted.withColumn("i", F.explode(F.sequence(first, F.least(first + (REPEATS - 1), F.col("_n") - 1)))).drop("_n", "_part")


def stream(of: DataFrame, partitions: int, budget: float) -> DataFrame:
    """What is sent until the budget is spent, in order: UNIT, i (which of the equal rows), again (0 or 1: its first or second copy), at (finish time) and range."""
    needed = of.filter("size > 0 AND target > 0")
    entries = _numbered(needed, F.col("rows") * 2, partitions).withColumn("again", (F.col("i") >= F.col("rows")).cast("int")).withColumn("i", F.col("i") % F.col("rows"))
    sent = F.col("before") + F.col("again") * F.col("source_size") + (F.col("i") + 1) * F.col("size")
    order = ["at", "source", "h", "doc_id", "size", "content", "i", "again"]
    timed = entries.withColumn("at", sent / F.col("target")).select(*UNIT, "h", "i", "again", "at")
    ranged = settle(timed.repartitionByRange(partitions, *order).withColumn("range", F.spark_partition_id()), "mix-stream")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("words"))
    earlier = sums.withColumn("offset", F.coalesce(F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("words")
    sofar = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.join(earlier, "range").withColumn("sent", F.col("offset") + F.sum("size").over(sofar))
    return summed.filter(F.col("sent") - F.col("size") / 2 <= F.lit(float(budget))).select(*UNIT, "i", "again", "at", "range")


def plan(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The units, with first and again: how many of a unit's rows the mix takes once at least, and twice; and at, the finish time of the first."""
    of = settle(units(docs, share, most, weights, seed, id_col, text_col, source_col), "mix-units")
    words = of.agg(F.sum(F.col("size") * F.col("rows"))).first()[0] or 0
    partitions = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    taken = stream(of, partitions, min(share, most) * words).groupBy(*UNIT).agg(F.count_if(F.col("again") == 0).alias("first"), F.count_if(F.col("again") == 1).alias("again"), F.min("at").alias("at"))
    t = taken.select(F.struct(*UNIT).alias("u"), "first", "again", "at")
    same = F.lit(True)
    for c in UNIT:
        same = same & of[c].eqNullSafe(t["u"][c])
    return settle(of.join(t, same, "left").select(*[of[c] for c in of.columns], F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("again", F.lit(0)).alias("again"), "at"), "mix-plan")


def mixed(docs: DataFrame, partitions: int, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the columns of docs, a row for each copy taken, range-sorted by finish time.

    A row of docs meets its decision by its unit. Where only some of a unit's
    rows are taken (at the end of the stream, one unit of a source at most for
    each copy), its rows are counted by content and the first ones taken. The
    row travels as one column, so that its names meet none of these.
    """
    decided = plan(docs, share, most, weights, seed, id_col, text_col, source_col).filter("first > 0")
    text = F.col(f"`{text_col}`").cast("string")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    key = F.struct(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("content"))
    d = docs.select(row.alias("row"), key.alias("key")).select("row", "key.*")
    p = decided.select(F.struct("*").alias("own"))
    same = [d[c].eqNullSafe(p["own"][c]) for c in UNIT]
    met = d.join(p, same[0] & same[1] & same[2] & same[3]).select("row", "own")
    whole = F.col("own")["first"].isin(0, F.col("own")["rows"]) & F.col("own")["again"].isin(0, F.col("own")["rows"])
    second = F.col("own")["at"] + F.col("own")["source_size"] / F.col("own")["target"]
    times = F.when(F.col("own")["again"] > 0, F.array(F.col("own")["at"], second)).otherwise(F.array(F.col("own")["at"]))
    sent = met.filter(whole).select("row", F.col("own")["doc_id"].alias("id"), F.explode(times).alias("at"))
    if not decided.filter("first NOT IN (0, rows) OR again NOT IN (0, rows)").isEmpty():
        alike = F.md5(F.to_json("row"))
        counted = settle(met.filter(~whole).groupBy("own", alike.alias("alike")).agg(F.first("row").alias("row"), F.count("*").alias("of")), "mix-part")
        upto = Window.partitionBy("own").orderBy("alike").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counted.withColumn("before", F.sum("of").over(upto) - F.col("of"))
        share_of = lambda n: F.greatest(F.lit(0), F.least(F.col("of"), F.col("own")[n] - F.col("before")))
        part = _numbered(placed, share_of("first") + share_of("again"), partitions).select("row", F.col("own")["doc_id"].alias("id"), F.col("own")["at"].alias("at"))
        sent = sent.unionByName(part)
    ordered = sent.repartitionByRange(partitions, "at", "id").sortWithinPartitions("at", "id")
    return ordered.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def taken_rows(planned: DataFrame) -> DataFrame:
    """The plan again as one row for each row of the table, with ``taken`` words."""
    partitions = max(8, int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    copies = (F.col("i") < F.col("first")).cast("int") + (F.col("i") < F.col("again")).cast("int")
    return _numbered(planned, F.col("rows"), partitions).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), "source")


def oracle(share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> str:
    """DuckDB SQL for taken_rows(plan(documents)), where no rows are equal."""
    return f"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), ranked AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {" ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(weights))} END AS weight, source_size * {most}::DOUBLE AS cap FROM per
), filled AS (
    SELECT *, (sum(source_size) OVER () * {share}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), levels AS (
    SELECT level FROM filled WHERE level < cap / weight ORDER BY cap / weight, source NULLS LAST LIMIT 1
), target AS (
    SELECT source, source_size, least(cap, coalesce((SELECT level FROM levels) * weight, cap)) AS target FROM ranked
), queue AS (
    SELECT doc_id, d.source, size, source_size, target, substr(md5(concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, ''), coalesce(d.source, ''), size::VARCHAR)), 1, 16) AS h
    FROM d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
), sent AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead FROM queue
), entries AS (
    SELECT *, (ahead + again * source_size + size) / target AS vtime FROM sent, (VALUES (0), (1)) c(again) WHERE size > 0 AND target > 0
), summed AS (
    SELECT *, sum(size) OVER (ORDER BY vtime, source NULLS FIRST, h, doc_id, size, again ROWS UNBOUNDED PRECEDING) AS words FROM entries
), taken AS (
    SELECT doc_id, source, size, count(*) AS copies FROM summed WHERE words - size / 2::DOUBLE <= {min(share, most)} * (SELECT sum(size) FROM d) GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(copies, 0))::BIGINT AS taken, q.source
FROM queue q LEFT JOIN taken t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.source IS NOT DISTINCT FROM t.source AND q.size = t.size
"""
