"""Mining temporal patterns and rules from interval sequences.

Level by level: the projection of a pattern holds one row for each client that
has it (its first occurrence whose intervals keep the maximal gap), so support
is a row count. All groups (data sets, folds, demographic groups) are mined in
one job, with the group in every key.

A level is cut from its lineage in the shared checkpoint folder. The number of
levels is the pattern size, a small constant.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronosift.functions import exprs
from chronosift.lineage import cut
from chronosift.operators.intervals import positions
from chronosift.operators.ordering import placed

GROUP = "grp"


@dataclass(frozen=True)
class MiningParams:
    """minsup: share of a group's clients; a negative maxgap is none; relations False mines sequences alone."""

    minsup: float = 0.1
    minconf: float = 0.5
    maxgap: float = -1.0
    max_size: int = 5
    relations: bool = True


def group_sizes(seq: DataFrame) -> DataFrame:
    return seq.groupBy(GROUP).agg(F.countDistinct("client_id").alias("n_clients"))


def sequences(intervals: DataFrame, group: str | None = None, order: list[str] | None = None, spread: bool = False) -> DataFrame:
    """grp, client_id, pos, state, start_time, end_time, in_order. order: columns of a given sequence order instead of start, end, state.

    spread: number the intervals over ranges of the whole table and not a client
    in a task, for clients that hold a large part of all intervals.
    """
    g = F.col(group).cast("string") if group else F.lit("all")
    base = intervals.withColumn(GROUP, g).withColumn("client_id", F.col("client_id").cast("string"))
    if spread:
        numbered = placed(base, [GROUP, "client_id"], order or ["start_time", "end_time", "state"], "pos")
    elif order:
        numbered = base.withColumn("pos", F.row_number().over(Window.partitionBy(GROUP, "client_id").orderBy(*order)) - 1)
    else:
        numbered = positions(base, [GROUP, "client_id"])
    return numbered.select(GROUP, "client_id", "pos", "state", "start_time", "end_time", F.lit(not order).alias("in_order"))


def _least_count(minsup: float):
    """floor(minsup * n) in doubles, as in integer conversion."""
    return F.floor(F.lit(minsup) * F.col("n_clients").cast("double"))


def frequent_states(seq: DataFrame, params: MiningParams, sizes: DataFrame | None = None) -> DataFrame:
    """grp, state, support_count, n_clients of the states that enough clients have."""
    sizes = group_sizes(seq) if sizes is None else sizes
    counts = seq.groupBy(GROUP, "state").agg(F.countDistinct("client_id").alias("support_count"))
    return counts.join(sizes, GROUP).filter(F.col("support_count") >= _least_count(params.minsup))


#: Places of a sequence in a block; a client's longer sequence is several.
BLOCK = 4096


def patterns(seq: DataFrame, params: MiningParams) -> DataFrame:
    """grp, size, states, relations (upper triangle, row by row), support_count, support.

    The relations of a pattern are those of its first client in the order of
    identifiers.
    """
    occ = cut(_occurrences(seq, params))
    sizes = cut(group_sizes(occ))
    frequent = _first_level(occ).groupBy(GROUP, "state").agg(F.count("*").alias("n")).join(sizes, GROUP).filter(F.col("n") >= _least_count(params.minsup))
    occ = cut(occ.join(frequent.select(GROUP, "state"), [GROUP, "state"], "left_semi"))
    return _grown(occ, params, lambda level: _counted(level, sizes, params), [GROUP, "states"], filtered=True)


def fold_patterns(seq: DataFrame, params: MiningParams) -> DataFrame:
    """patterns() of the two cells of each group's fold, grp being ``<group>|test`` (the group alone) and ``<group>|train`` (all others together).

    Groups partition the clients, so counts add up: each group is mined once,
    and a cell's count is the group's, or the total less that. A pattern that
    no cell finds frequent is not grown; one that a cell does is frequent in a
    group at least. What is dealt out does not depend on the number of folds.
    """
    occ = cut(_occurrences(seq, params))
    sizes = cut(group_sizes(occ))
    folds = sizes.agg(F.collect_list(F.struct(F.col(GROUP).alias("fold"), F.col("n_clients").alias("own"))).alias("folds"), F.sum("n_clients").alias("total"))  # one row
    return _grown(occ, params, lambda level: _counted_in_folds(level, folds, params), ["states"])


def _grown(occ: DataFrame, params: MiningParams, counted, key: list[str], filtered: bool = False) -> DataFrame:
    """Patterns of all sizes: counted() keeps those of a level that are frequent, key says for whom they are grown; filtered: occ has frequent states alone."""
    first = F.coalesce(F.try_element_at("at", F.lit(1)), "later")
    iv = lambda x: F.struct(x["start_time"].alias("start_time"), x["end_time"].alias("end_time"))
    level = _first_level(occ).select(GROUP, "client_id", F.array("state").alias("states"), first["pos"].alias("pos"), F.array(iv(first)).alias("ivs"), first["end_time"].alias("min_end"), first["block"].alias("block"))
    kept = cut(counted(level))
    found = [kept]
    for size in range(1, params.max_size):
        if size > 1 or not filtered:
            level = level.join(kept.select(*key).distinct(), key, "left_semi")
        nxt = F.col("next")
        grown = level.join(occ, [GROUP, "client_id", "block"]).withColumn("next", _next(params)).filter(nxt.isNotNull())
        level = cut(grown.select(GROUP, "client_id", F.concat("states", F.array("state")).alias("states"), nxt["pos"].alias("pos"), F.concat("ivs", F.array(iv(nxt))).alias("ivs"), F.least("min_end", nxt["end_time"]).alias("min_end"), nxt["block"].alias("block")))
        kept = cut(counted(level))
        if kept.isEmpty():
            break
        found.append(kept)
    return reduce(lambda a, b: a.unionByName(b), found)


def _occurrences(seq: DataFrame, params: MiningParams) -> DataFrame:
    """grp, client_id, in_order, block, state, at (the state's intervals in the block by position), later (its first one in a later block), steps (powers of two up to the size of at).

    Blocks are BLOCK places long, so that no row holds more; those before a
    block with the state have a row that points to its first one there. In a
    sequence whose starts do not follow its places a kept gap has to be looked
    for everywhere: with a gap such a sequence is one block.
    """
    block = F.expr(f"pos div {BLOCK}") if params.maxgap < 0 else F.when(F.col("in_order"), F.expr(f"pos div {BLOCK}")).otherwise(F.lit(0).cast("long"))
    rows = seq.withColumn("block", block.cast("long"))
    item = F.struct("pos", "start_time", "end_time", "block")
    have = rows.groupBy(GROUP, "client_id", "in_order", "state", "block").agg(F.array_sort(F.collect_list(item)).alias("at"))
    w = Window.partitionBy(GROUP, "client_id", "state").orderBy("block")  # a row for each block
    linked = have.withColumn("later", F.lead(F.col("at")[0]).over(w)).withColumn("from", F.coalesce(F.lag("block").over(w) + 1, F.lit(0).cast("long")))
    own = F.struct(F.col("block").alias("block"), F.col("at").alias("at"), F.col("later").alias("later"))
    none = F.filter("at", lambda x: F.lit(False))
    pointing = F.transform(F.sequence("from", F.col("block") - 1), lambda b: F.struct(b.alias("block"), none.alias("at"), F.col("at")[0].alias("later")))
    spread = F.when(F.col("from") < F.col("block"), F.concat(pointing, F.array(own))).otherwise(F.array(own))
    out = linked.select(GROUP, "client_id", "in_order", "state", F.explode(spread).alias("x")).select(GROUP, "client_id", "in_order", "state", "x.*")
    powers = F.transform(F.sequence(F.ceil(F.log2(F.size("at") + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    return out.withColumn("steps", powers)


def _first_level(occ: DataFrame) -> DataFrame:
    """The rows that hold, or point to, the first interval of each client's state: those of the first block."""
    return occ.filter("block = 0")


def _next(params: MiningParams):
    """The first interval of the state beyond pos that keeps the gap, null if there is none.

    Found by halving steps in the block's intervals, else in the pointer to the
    later ones, so that a projection grows by one row for each state and not by
    one for each later interval. Where starts follow positions, no later
    interval keeps a gap that the first one breaks.
    """
    at, pos = F.col("at"), F.col("pos")
    passed = F.aggregate("steps", F.lit(0), lambda n, k: F.when((n + k <= F.size(at)) & (F.try_element_at(at, n + k)["pos"] <= pos), n + k).otherwise(n))
    first = F.coalesce(F.try_element_at(at, passed + 1), F.col("later"))
    if params.maxgap < 0:
        return first
    near = lambda x: x["start_time"] - F.col("min_end") <= params.maxgap
    other = F.try_element_at(F.filter(at, lambda x: (x["pos"] > pos) & near(x)), F.lit(1))
    return F.when(near(first), first).otherwise(F.when(~F.col("in_order"), other))


def _relations(params: MiningParams):
    """The relations of a pattern's intervals ``ivs``."""
    pairs = exprs.pattern_pairs(F.size("states"))
    if not params.relations:
        return F.transform(pairs, lambda p: F.lit("b"))
    of = lambda i: F.try_element_at("ivs", i)
    return F.transform(pairs, lambda p: exprs.interval_relation(of(p["i"])["start_time"], of(p["i"])["end_time"], of(p["j"])["start_time"], of(p["j"])["end_time"]))


def _frequent(counts: DataFrame, params: MiningParams) -> DataFrame:
    """The pattern columns of counts (grp, states, support_count, ivs, n_clients) that are frequent."""
    kept = counts.filter(F.col("support_count") >= _least_count(params.minsup))
    return kept.select(GROUP, F.size("states").alias("size"), "states", F.when(F.size("states") > 1, _relations(params)).otherwise(F.expr("cast(array() as array<string>)")).alias("relations"), "support_count", (F.col("support_count") / F.col("n_clients")).alias("support"))


def _counted_in_folds(level: DataFrame, folds: DataFrame, params: MiningParams) -> DataFrame:
    """Frequent patterns of each fold's cells, from one count for each pattern and group."""
    per = level.groupBy("states", GROUP).agg(F.count("*").alias("n"), F.min(F.struct("client_id", "ivs")).alias("first"))
    all_ = per.groupBy("states").agg(F.collect_list(F.struct(F.col(GROUP).alias("fold"), "n", "first")).alias("in")).join(F.broadcast(folds))  # one row of folds
    cells = all_.select("states", "in", "total", F.explode("folds").alias("f"))
    mine, others = F.filter("in", lambda x: x["fold"] == F.col("f.fold")), F.filter("in", lambda x: x["fold"] != F.col("f.fold"))
    count = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x["n"])
    first = lambda xs: F.array_min(F.transform(xs, lambda x: x["first"]))["ivs"]
    cell = lambda part, xs, n: F.struct(F.concat_ws("|", F.col("f.fold"), F.lit(part)).alias(GROUP), count(xs).alias("support_count"), first(xs).alias("ivs"), n.alias("n_clients"))
    both = cells.select("states", F.explode(F.array(cell("test", mine, F.col("f.own")), cell("train", others, F.col("total") - F.col("f.own")))).alias("c")).select("states", "c.*")
    return _frequent(both.filter("support_count > 0"), params)


def _counted(level: DataFrame, sizes: DataFrame, params: MiningParams) -> DataFrame:
    counts = level.groupBy(GROUP, "states").agg(F.count("*").alias("support_count"), F.min_by("ivs", "client_id").alias("ivs"))
    return _frequent(counts.join(sizes, GROUP), params)


def _triangle(relations, n, first, last):
    """The upper triangle of states first..last (from 1) of a pattern of n."""
    keep = F.filter(F.zip_with(exprs.pattern_pairs(n), relations, lambda p, r: F.struct(p["i"].alias("i"), p["j"].alias("j"), r.alias("r"))), lambda x: (x["i"] >= first) & (x["j"] <= last))
    return F.transform(keep, lambda x: x["r"])


def rules(found: DataFrame, params: MiningParams) -> DataFrame:
    """grp, antecedent and consequent (states, relations), signature, confidence, lift, support, support_count.

    The antecedent is a proper prefix of the consequent, which is the whole
    pattern; both, and the suffix for the lift, are looked up with their
    relations. A prefix that was found with other relations gives no rule; a
    suffix that was not found makes the lift 0.
    """
    wide = found.filter("size >= 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    n = F.col("size")
    cutup = wide.select(
        GROUP, "states", "relations", "support", "support_count",
        F.slice("states", 1, F.col("k")).alias("pre_states"), _triangle(F.col("relations"), n, F.lit(1), F.col("k")).alias("pre_relations"),
        F.slice("states", F.col("k") + 1, n - F.col("k")).alias("suf_states"), _triangle(F.col("relations"), n, F.col("k") + 1, n).alias("suf_relations"),
    )
    pre = found.select(GROUP, F.col("states").alias("pre_states"), F.col("relations").alias("pre_relations"), F.col("support").alias("pre_support"))
    suf = found.select(GROUP, F.col("states").alias("suf_states"), F.col("relations").alias("suf_relations"), F.col("support").alias("suf_support"))
    joined = cutup.join(pre, [GROUP, "pre_states", "pre_relations"]).join(suf, [GROUP, "suf_states", "suf_relations"], "left")
    confident = joined.withColumn("confidence", F.col("support") / F.col("pre_support")).filter(F.col("confidence") >= params.minconf)
    lift = F.coalesce(F.when(F.col("pre_support") * F.col("suf_support") > 0, F.col("support") / (F.col("pre_support") * F.col("suf_support"))), F.lit(0.0))
    ante, cons = exprs.pattern_text(F.col("pre_states"), F.col("pre_relations")), exprs.pattern_text(F.col("states"), F.col("relations"))
    return confident.select(
        GROUP, F.col("pre_states").alias("antecedent_states"), F.col("pre_relations").alias("antecedent_relations"),
        F.col("states").alias("consequent_states"), F.col("relations").alias("consequent_relations"),
        ante.alias("antecedent"), cons.alias("consequent"), exprs.rule_signature(ante, cons).alias("signature"),
        "confidence", lift.alias("lift"), "support", "support_count",
    )


def sequence_rules(found: DataFrame, minconf: float) -> DataFrame:
    """Rules of relation-free patterns: prefixes by their states alone, confidence and support within 0..1, no lift."""
    wide = found.filter("size >= 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cutup = wide.select(GROUP, "states", "support", F.slice("states", 1, F.col("k")).alias("pre_states"))
    pre = found.select(GROUP, F.col("states").alias("pre_states"), F.col("support").alias("pre_support"))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    joined = cutup.join(pre, [GROUP, "pre_states"]).withColumn("confidence", clamp(F.col("support") / F.col("pre_support"))).filter(F.col("confidence") >= minconf)
    return joined.select(GROUP, F.array_join("pre_states", " -> ").alias("antecedent"), F.array_join("states", " -> ").alias("consequent"), "confidence", clamp(F.col("support")).alias("support"))


class IntervalMiner:
    """Facade: from an interval table or a file to patterns and rules."""

    def __init__(self, minsup: float = 0.1, minconf: float = 0.5, maxgap: float = -1.0, max_pattern_size: int = 5):
        self.params = MiningParams(minsup, minconf, maxgap, max_pattern_size)

    def run(self, intervals: DataFrame | None = None, path: str | None = None, spark=None, group: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(patterns, rules) of a table, or of a file: ``.csv``, or else sequence text."""
        if intervals is None:
            if path is None:
                raise ValueError("give intervals or a path")
            from chronosift.sources import readers

            intervals = readers.intervals_csv(spark, path) if path.endswith(".csv") else readers.sequence_text(spark, path)
        found = cut(patterns(sequences(intervals, group), self.params))
        return found, rules(found, self.params)
