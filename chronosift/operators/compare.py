"""Set algebra over rule signatures of several data sets.

All of it works on one presence table (signature, the sorted data sets that
have it), built with one aggregation; no data set is mined or joined again.
Data sets are few, rules many: combinations of data sets are generated, never
pairs of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MEASURES = ("confidence", "lift", "support")


def presence(rules: DataFrame, ds: str = "ds") -> DataFrame:
    """signature, present (sorted data sets), n_present, and the mean and least of each measure the rules have."""
    have = [m for m in MEASURES if m in rules.columns]
    aggs = [F.array_sort(F.collect_set(ds)).alias("present")]
    for m in have:
        aggs += [F.round(F.avg(m), 4).alias(f"avg_{m}"), F.round(F.min(m), 4).alias(f"min_{m}")]
    return rules.groupBy("signature").agg(*aggs).withColumn("n_present", F.size("present"))


def n_datasets(rules: DataFrame, ds: str = "ds") -> int:
    return rules.agg(F.countDistinct(ds)).first()[0]


def universal(rules: DataFrame, ds: str = "ds", datasets: int | None = None) -> DataFrame:
    """Signatures that all data sets have. datasets counts those without a rule too; by default they are left out."""
    n = n_datasets(rules, ds) if datasets is None else datasets
    return presence(rules, ds).filter(F.col("n_present") == n)


def detail_table(rules: DataFrame, ds: str, names: list[str]) -> DataFrame:
    """A row for each signature with the measures in each of the named data sets, and their mean and least."""
    have = [m for m in MEASURES if m in rules.columns]
    aggs = [F.max(F.when(F.col(ds) == n, F.col(m))).alias(f"{n}_{m}") for n in names for m in have]
    for m in have:
        aggs += [F.round(F.avg(m), 4).alias(f"avg_{m}"), F.round(F.min(m), 4).alias(f"min_{m}")]
    return rules.filter(F.col(ds).isin(*names)).groupBy("signature").agg(*aggs)


def at_least(rules: DataFrame, k: int, ds: str = "ds") -> DataFrame:
    return presence(rules, ds).filter(F.col("n_present") >= k)


#: Orders of the result tables: those of leave-one-out and universal rules, of majority rules, and of shifts.
BY_PRESENCE = ("n_present", "avg_confidence")
BY_MAJORITY = ("n_present", "avg_confidence", "avg_lift")


def ranked(found: DataFrame, by: tuple[str, ...], tie: str = "signature") -> DataFrame:
    """The table with its rank (from 1) by columns, greatest first, then by signature; shifts are ranked by their size (``delta``)."""
    order = [F.abs(F.col(c)).desc() if c == "delta" else F.col(c).desc() for c in by]
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order, tie)))  # a report's table: rules common to data sets


def unique_to_one(rules: DataFrame, ds: str = "ds") -> DataFrame:
    """signature, ds of the only data set that has it."""
    return presence(rules, ds).filter("n_present = 1").select("signature", F.element_at("present", 1).alias(ds))


def pairwise_common(rules: DataFrame, ds: str = "ds") -> DataFrame:
    """left, right, signature for each pair of data sets that have it."""
    p = presence(rules, ds).select("signature", "present")
    two = p.select("signature", F.explode("present").alias("left"), "present").select("signature", "left", F.explode("present").alias("right"))
    return two.filter(F.col("left") < F.col("right")).select("left", "right", "signature")


def all_but_one(rules: DataFrame, ds: str = "ds") -> DataFrame:
    """Signatures that exactly all but one data set have, with the one that has not."""
    names = sorted(r[0] for r in rules.select(ds).distinct().collect())
    p = presence(rules, ds).filter(F.col("n_present") == len(names) - 1)
    return p.withColumn("missing", F.try_element_at(F.array_except(F.array(*[F.lit(n) for n in names]), "present"), F.lit(1)))


def shared_matrix(rules: DataFrame, ds: str = "ds") -> DataFrame:
    """left, right, n: common signatures of each pair of data sets; the diagonal is the own number. Pairs without any are 0."""
    p = presence(rules, ds)
    n = p.select(F.explode("present").alias("left"), "present").select("left", F.explode("present").alias("right")).groupBy("left", "right").agg(F.count("*").alias("n"))
    names = rules.select(F.col(ds).alias("name")).distinct().agg(F.collect_list("name").alias("names"))  # one row
    grid = names.select(F.explode("names").alias("left"), "names").select("left", F.explode("names").alias("right"))
    return grid.join(n, ["left", "right"], "left").fillna(0, ["n"])


def jaccard_of(common: Column, left: Column, right: Column) -> Column:
    """Common over all; two empty sets are equal."""
    return F.when(left + right - common == 0, F.lit(1.0)).otherwise(common / (left + right - common))


def jaccard_matrix(rules: DataFrame, ds: str = "ds") -> DataFrame:
    m = shared_matrix(rules, ds)
    own = m.filter(F.col("left") == F.col("right")).select(F.col("left").alias("name"), F.col("n").alias("own"))
    a, b = own.select(F.col("name").alias("left"), F.col("own").alias("na")), own.select(F.col("name").alias("right"), F.col("own").alias("nb"))
    return m.join(a, "left").join(b, "right").select("left", "right", jaccard_of(F.col("n"), F.col("na"), F.col("nb")).alias("jaccard"))


def superset_counts(sets: DataFrame, n: int) -> DataFrame:
    """mask, m of all sets of bits that some set holds: how many (the m summed up) of the sets (mask, m) of n bits hold it.

    Superset sums, a bit after another: a set that has the bit counts for itself
    and for the set without it. An aggregation for each bit, of at most 2 ** n
    rows.
    """
    for bit in range(n):
        mask = F.col("mask")
        has = mask.bitwiseAND(F.lit(1 << bit)) != 0
        sets = sets.select(F.explode(F.when(has, F.array(mask, mask - F.lit(1 << bit))).otherwise(F.array(mask))).alias("mask"), "m").groupBy("mask").agg(F.sum("m").alias("m"))
    return sets


def _mask(members: Column, names: Column) -> Column:
    """Members as bits of their places among the names."""
    return F.aggregate(members, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(names, x) - 1).cast("int"))))


def combination_matrix(rules: DataFrame, k: int, ds: str = "ds", sparse: bool = False) -> DataFrame:
    """combo, target, n: for each k data sets the signatures common to them that the target has too; n is null if the target is one of them.

    A signature's data sets are bits (63 at most); what a combination and a
    target have in common is one superset sum. sparse leaves out combinations
    and targets that have none anywhere.
    """
    names = rules.select(F.col(ds).alias("name")).distinct().agg(F.array_sort(F.collect_list("name")).alias("names"))  # one row
    n = n_datasets(rules, ds)
    sets = presence(rules, ds).select("present").join(F.broadcast(names)).groupBy(_mask(F.col("present"), F.col("names")).alias("mask")).agg(F.count("*").alias("m"))
    counts = superset_counts(sets, n).withColumnRenamed("mask", "_mask")
    combos = names.select(F.explode(_subsets(F.col("names"), k)).alias("combo"), "names").select("combo", "names", F.explode("names").alias("target"))
    wanted = combos.withColumn("mask", _mask(F.array_union("combo", F.array("target")), F.col("names")))
    counted = wanted.join(counts, F.col("mask") == F.col("_mask"), "left")
    out = counted.select("combo", "target", F.when(~F.array_contains("combo", F.col("target")), F.coalesce("m", F.lit(0))).alias("n"))
    if sparse:
        out = out.join(out.filter("n > 0").select("combo").distinct(), "combo", "left_semi").join(out.filter("n > 0").select("target").distinct(), "target", "left_semi")
    return out.select(F.array_join("combo", "+").alias("combo"), "target", "n")


def top_combinations(matrix: DataFrame, top: int = 5) -> DataFrame:
    """The combinations and targets with the most common signatures; ties by name."""
    return matrix.filter(F.col("n").isNotNull()).orderBy(F.col("n").desc(), "combo", "target").limit(top)


def _subsets(names: Column, k: int) -> Column:
    """All sorted subsets of k elements."""
    found = F.transform(names, lambda x: F.array(x))
    for _ in range(k - 1):
        found = F.flatten(F.transform(found, lambda s: F.transform(F.filter(names, lambda x: x > F.element_at(s, -1)), lambda x: F.concat(s, F.array(x)))))
    return found


def two_sides(rules: DataFrame, side: str, a: str, b: str) -> DataFrame:
    """One row: sizes of the union of two sides, of what they share, and of what either has alone, and their similarity."""
    p = rules.groupBy("signature").agg(F.max(F.when(F.col(side) == a, 1).otherwise(0)).alias("ia"), F.max(F.when(F.col(side) == b, 1).otherwise(0)).alias("ib"))
    n = p.agg(F.count_if(F.expr("ia + ib > 0")).alias("n_union"), F.count_if(F.expr("ia = 1 AND ib = 1")).alias("n_shared"), F.count_if(F.expr("ia = 1 AND ib = 0")).alias(f"n_only_{a}"), F.count_if(F.expr("ia = 0 AND ib = 1")).alias(f"n_only_{b}"))
    return n.withColumn("jaccard", F.when(F.col("n_union") == 0, F.lit(1.0)).otherwise(F.col("n_shared") / F.col("n_union")))


def confidence_shift(rules: DataFrame, side: str, a: str, b: str, tolerance: float = 0.05) -> DataFrame:
    """signature, confidences on either side, delta (b - a) and shift (up, down, same) of the rules that both have."""
    one = lambda s: rules.filter(F.col(side) == s).groupBy("signature").agg(F.max("confidence").alias(f"confidence_{s}"))
    both = one(a).join(one(b), "signature").withColumn("delta", F.col(f"confidence_{b}") - F.col(f"confidence_{a}"))
    return both.withColumn("shift", F.when(F.col("delta") > tolerance, "up").when(F.col("delta") < -tolerance, "down").otherwise("same"))


def cross_validation(rules: DataFrame, ds: str = "ds") -> DataFrame:
    """A row for each held-out data set: rules common to all others, those of them it has, the hit rate in percent, mean differences of confidence and lift (held out less others)."""
    names = rules.select(ds).distinct()
    all_ = names.agg(F.collect_list(ds).alias("names"), F.count("*").alias("total"))  # one row
    per = rules.groupBy("signature").agg(F.collect_list(F.struct(F.col(ds).alias("ds"), "confidence", "lift")).alias("all"))
    cells = per.join(F.broadcast(all_)).select("*", F.explode("names").alias("held_out"))  # a row for each rule and data set, within the task
    train, test = F.filter("all", lambda x: x["ds"] != F.col("held_out")), F.filter("all", lambda x: x["ds"] == F.col("held_out"))
    mean = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x[f]) / F.size(xs)
    c = cells.select("held_out", "total", train.alias("train"), test.alias("test")).filter(F.size("train") == F.col("total") - 1)
    hit = F.size("test") > 0
    agg = c.groupBy("held_out").agg(F.count("*").alias("n_common"), F.count_if(hit).alias("n_validated"), F.avg(F.when(hit, mean(F.col("test"), "confidence") - mean(F.col("train"), "confidence"))).alias("confidence_diff"), F.avg(F.when(hit, mean(F.col("test"), "lift") - mean(F.col("train"), "lift"))).alias("lift_diff"))
    out = names.withColumnRenamed(ds, "held_out").join(agg, "held_out", "left").fillna(0, ["n_common", "n_validated"])
    return out.withColumn("hit_rate", F.when(F.col("n_common") > 0, F.col("n_validated") / F.col("n_common") * 100).otherwise(F.lit(0.0)))
