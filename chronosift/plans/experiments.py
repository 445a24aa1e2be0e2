"""Analyses over several data sets or groups, each one job of mining with the group in its keys.

A rule table has grp (the data set or group), signature, states and measures.
Parameters travel with the results where these are written.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronosift.functions import exprs
from chronosift.lineage import cut
from chronosift.operators import compare, groups, miner
from chronosift.operators import rules as rule_ops
from chronosift.operators.miner import GROUP, MiningParams

#: Parameters of the comparisons by minimal support 0.3, and of the searches for universal rules.
COMPARISON = MiningParams(0.3, 0.5, 5.0, 4)
UNIVERSAL = MiningParams(0.1, 0.5, 5.0, 2)
CROSS = {"only_cross": True}


def mined_rules(intervals: DataFrame, group: str | None, params: MiningParams, filters: dict | None = None) -> DataFrame:
    """Rules of all groups, filtered by flags of ``rules.rule_filter``."""
    found = miner.rules(cut(miner.patterns(miner.sequences(intervals, group), params)), params)
    return rule_ops.filtered(found, **filters) if filters else found


def compare_datasets(intervals: DataFrame, dataset: str = "dataset", params: MiningParams = COMPARISON) -> dict[str, DataFrame]:
    """Rules of each data set and of all together, what they share and what is theirs alone, and their similarity."""
    rules = cut(mined_rules(intervals, dataset, params).withColumnRenamed(GROUP, "ds"))
    pooled = mined_rules(intervals.withColumn("client_id", F.concat_ws("_", dataset, "client_id")), None, params)
    return {
        "rules": rules, "pooled": pooled, "common_all": compare.universal(rules), "common_3_plus": compare.at_least(rules, 3),
        "pairs": compare.pairwise_common(rules), "unique": compare.unique_to_one(rules), "jaccard": compare.jaccard_matrix(rules), "shared": compare.shared_matrix(rules),
    }


def universal_rules(intervals: DataFrame, scenarios: dict[str, list[str]], dataset: str = "dataset", params: MiningParams = UNIVERSAL, filters: dict | None = None) -> dict[str, DataFrame]:
    """For each scenario (a list of data sets, of two at least) the rules all of them have, with each one's measures. The data sets are mined once for all scenarios."""
    rules = cut(mined_rules(intervals, dataset, params, filters).withColumnRenamed(GROUP, "ds"))
    out = {}
    for name, members in scenarios.items():
        if len(members) < 2:
            continue
        own = rules.filter(F.col("ds").isin(*members))
        shared = compare.universal(own, datasets=len(members)).select("signature")
        out[name] = compare.detail_table(own.join(shared, "signature", "left_semi"), "ds", members)
    return out


def pooled_leave_one_out(intervals: DataFrame, dataset: str = "dataset", params: MiningParams = UNIVERSAL, filters: dict | None = None) -> DataFrame:
    """fold, n_train, n_test, n_general: rules of the pooled others, of the held-out data set, and of both. Each data set is mined once."""
    named = intervals.withColumn("client_id", F.concat_ws("_", dataset, "client_id"))
    found = miner.rules(cut(miner.fold_patterns(miner.sequences(named, dataset), params)), params)
    found = rule_ops.filtered(found, **filters) if filters else found
    rules = found.select(F.split_part(GROUP, F.lit("|"), F.lit(1)).alias("fold"), F.split_part(GROUP, F.lit("|"), F.lit(2)).alias("part"), "signature").distinct()
    p = rules.groupBy("fold", "signature").agg(F.max((F.col("part") == "train").cast("int")).alias("a"), F.max((F.col("part") == "test").cast("int")).alias("b"))
    return p.groupBy("fold").agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"), F.sum(F.col("a") * F.col("b")).alias("n_general"))


def leave_one_out(intervals: DataFrame, dataset: str = "dataset", params: MiningParams = UNIVERSAL, filters: dict | None = None) -> DataFrame:
    rules = cut(mined_rules(intervals, dataset, params, filters).withColumnRenamed(GROUP, "ds"))
    return compare.all_but_one(rules)


def majority(intervals: DataFrame, least: int = 4, dataset: str = "dataset", params: MiningParams = COMPARISON, filters: dict | None = None) -> DataFrame:
    rules = mined_rules(intervals, dataset, params, filters).withColumnRenamed(GROUP, "ds")
    return compare.at_least(rules, least)


def demographic_groups(intervals: DataFrame, demographics: DataFrame, group: str, params: MiningParams = COMPARISON, second: str | None = None, filters: dict | None = None) -> dict[str, DataFrame]:
    """Rules of each group (or pair of groups with 3 clients at least), their similarity, and each group's top 50."""
    rows = groups.interaction_groups(intervals, demographics, group, second) if second else groups.with_group(intervals, demographics, group).withColumn("grp", F.col(group))
    rules = cut(mined_rules(rows, "grp", params, filters).withColumnRenamed(GROUP, "ds"))
    return {"rules": rules, "jaccard": compare.jaccard_matrix(rules), "top": rule_ops.top_in_group(rules, "ds", "confidence", 50)}


def subgroup_universal(intervals: DataFrame, demographics: DataFrame, group: str, dataset: str = "dataset", params: MiningParams = COMPARISON) -> DataFrame:
    """group value, signature of the rules that all data sets have within it."""
    rows = groups.with_group(intervals, demographics, group).withColumn("cell", F.concat_ws("|", group, dataset))
    rules = mined_rules(rows, "cell", params).select(F.split_part(GROUP, F.lit("|"), F.lit(1)).alias(group), F.split_part(GROUP, F.lit("|"), F.lit(2)).alias("ds"), "signature").distinct()
    total = rows.groupBy(F.col(group).cast("string").alias(group)).agg(F.countDistinct(dataset).alias("n"))
    return rules.groupBy(group, "signature").agg(F.count("*").alias("m")).join(total, group).filter("m = n").select(group, "signature")


def labels_compared(dimensional: DataFrame, discrete: DataFrame, dataset: str = "dataset", params: MiningParams = COMPARISON) -> dict[str, DataFrame]:
    """Rules of both kinds of emotion labels by data set: counts, similarities, and those common to all data sets that have any."""
    both = dimensional.withColumn("kind", F.lit("dimensional")).unionByName(discrete.withColumn("kind", F.lit("discrete"))).withColumn("cell", F.concat_ws("|", "kind", dataset))
    rules = cut(mined_rules(both, "cell", params, CROSS).withColumn("kind", F.split_part(GROUP, F.lit("|"), F.lit(1))).withColumn("ds", F.split_part(GROUP, F.lit("|"), F.lit(2))))
    one = lambda k: rules.filter(F.col("kind") == k)
    return {"counts": rules.groupBy("kind", "ds").agg(F.countDistinct("signature").alias("n")), **{f"{n}_{k}": f(one(k)) for k in ("dimensional", "discrete") for n, f in (("jaccard", compare.jaccard_matrix), ("common", compare.universal))}}


def self_and_external(intervals: DataFrame, source: str = "source", a: str = "self", b: str = "external", params: MiningParams = COMPARISON, filters: dict | None = None) -> dict[str, DataFrame]:
    """Set sizes of both sides and the shift of confidence of the rules they share."""
    rules = cut(mined_rules(intervals, source, params, filters).withColumnRenamed(GROUP, "ds"))
    return {"sets": compare.two_sides(rules, "ds", a, b), "shift": compare.confidence_shift(rules, "ds", a, b)}


def multimodality(intervals: DataFrame, dataset: str = "dataset", params: MiningParams = COMPARISON) -> DataFrame:
    """Rule-size statistics by the size told from the text, and by the number of states."""
    rules = cut(mined_rules(intervals, dataset, params, {"no_single_feature": True}))
    by_text = rule_ops.size_stats(rules, [GROUP], exprs.relation_count_size(F.col("signature"))).withColumn("by", F.lit("text"))
    return by_text.unionByName(rule_ops.size_stats(rules, [GROUP]).withColumn("by", F.lit("states")))


def cross_validated(intervals: DataFrame, dataset: str = "dataset", params: MiningParams = replace(COMPARISON, max_size=3), filters: dict | None = None) -> DataFrame:
    rules = cut(mined_rules(intervals, dataset, params, filters).withColumnRenamed(GROUP, "ds"))
    return compare.cross_validation(rules)


def permuted(intervals: DataFrame, by: list[str], seed: int = 42) -> DataFrame:
    """The intervals with the states of each client dealt anew to its intervals: those stay, and so does the count of each state.

    States are ordered by a seeded hash (md5 of seed, keys and position) and given
    to positions by rank: a client's rows are sorted, nothing is collected.
    """
    w = Window.partitionBy(*by)
    placed = intervals.withColumn("_i", F.row_number().over(w.orderBy("start_time", "end_time", "state")))
    dealt = placed.withColumn("_j", F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *by, "_i")), "_i")))
    left = placed.drop("state")
    right = dealt.select(*by, F.col("_j").alias("_i"), "state")
    return left.join(right, [*by, "_i"]).drop("_i")


def permutation_baseline(intervals: DataFrame, dataset: str = "dataset", params: MiningParams = COMPARISON, seed: int = 42, filters: dict | None = None) -> DataFrame:
    """data set, n_original, n_shuffled, reduction_pct (null without original rules). Both are mined in one job."""
    shuffled = permuted(intervals, [dataset, "client_id"], seed)
    cols = [dataset, "client_id", "state", "start_time", "end_time"]
    both = intervals.select(*cols, F.lit("original").alias("kind")).unionByName(shuffled.select(*cols, F.lit("shuffled").alias("kind"))).withColumn("cell", F.concat_ws("|", dataset, "kind"))
    rules = mined_rules(both, "cell", params, filters).select(F.split_part(GROUP, F.lit("|"), F.lit(1)).alias("ds"), F.split_part(GROUP, F.lit("|"), F.lit(2)).alias("kind"), "signature").distinct()
    n = intervals.select(F.col(dataset).cast("string").alias("ds")).distinct().join(rules.groupBy("ds").agg(F.count_if(F.col("kind") == "original").alias("n_original"), F.count_if(F.col("kind") == "shuffled").alias("n_shuffled")), "ds", "left").fillna(0)
    return n.withColumn("reduction_pct", F.when(F.col("n_original") > 0, (1 - F.col("n_shuffled") / F.col("n_original")) * 100))


def permuted_universal(intervals: DataFrame, dataset: str = "dataset", params: MiningParams = UNIVERSAL, seed: int = 42, filters: dict | None = None) -> DataFrame:
    """One row: universal rules of the original and of the shuffled data sets. The intervals are made once, and both are mined in one job."""
    cols = [dataset, "client_id", "state", "start_time", "end_time"]
    rows = cut(intervals.select(*cols))
    both = rows.withColumn("kind", F.lit("original")).unionByName(permuted(rows, [dataset, "client_id"], seed).select(*cols, F.lit("shuffled").alias("kind")))
    rules = mined_rules(both.withColumn("cell", F.concat("kind", F.lit("|"), F.col(dataset).cast("string"))), "cell", params, filters)
    found = cut(rules.select(F.split_part(GROUP, F.lit("|"), F.lit(1)).alias("kind"), GROUP, "signature").distinct())
    sets = found.groupBy("kind").agg(F.countDistinct(GROUP).alias("m"))  # two rows at most
    shared = found.groupBy("kind", "signature").agg(F.count("*").alias("k")).join(F.broadcast(sets), "kind").filter("k = m")
    return shared.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("original", "shuffled")])


def sequence_mining(sequences: DataFrame, order: list[str], group: str | None = None, minsup: float = 0.4, minconf: float = 0.6, max_size: int = 4) -> tuple[DataFrame, DataFrame]:
    """Patterns and rules of state orders alone (client_id, state, order columns)."""
    rows = sequences.withColumn("start_time", F.lit(0.0)).withColumn("end_time", F.lit(0.0))
    found = cut(miner.patterns(miner.sequences(rows, group, order), MiningParams(minsup, minconf, -1.0, max_size, relations=False)))
    return found, miner.sequence_rules(found, minconf)


def run_all(steps: dict, only: list[str] | None = None) -> dict:
    """Run named functions in order, or those named; the first failure ends the run."""
    return {name: step() for name, step in steps.items() if only is None or name in only}


def pooled(frames: dict[str, DataFrame]) -> DataFrame:
    """Interval tables of several data sets as one, clients named by data set."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("dataset", F.lit(n)).withColumn("client_id", F.concat_ws("_", "dataset", "client_id")) for n, df in frames.items()])
