"""Filters, statistics and renderings of rule tables (grp, signature, states, confidence, lift, support, support_count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronosift.functions import exprs


def signatures(rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rules.select(*(by or []), "signature").distinct()


def rule_filter(states: Column, no_heart_only: bool = False, no_skin_only: bool = False, only_cross: bool = False, no_single_feature: bool = False) -> Column:
    """Whether a rule stays. A rule without states always does."""
    drop = F.lit(False)
    if no_heart_only:
        drop = drop | exprs.heart_only(states)
    if no_skin_only:
        drop = drop | exprs.skin_only(states)
    if only_cross:
        drop = drop | exprs.not_cross(states)
    if no_single_feature:
        drop = drop | exprs.single_feature(states)
    return ~drop


def filtered(rules: DataFrame, states: str = "consequent_states", **flags: bool) -> DataFrame:
    return rules.filter(rule_filter(F.col(states), **flags))


def details(rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, signature and its measures, one row each; of repeated signatures the one that is last by support and confidence."""
    last = F.max(F.struct("support", "confidence", "lift", "support_count"))
    return rules.groupBy(*(by or []), "signature").agg(last.alias("m")).select(*(by or []), "signature", "m.confidence", "m.lift", "m.support", "m.support_count")


def top_rules(rules: DataFrame, k: int = 1000, tie: list[str] | None = None) -> DataFrame:
    """The k rules of greatest confidence times support."""
    return rules.orderBy((F.col("confidence") * F.col("support")).desc(), *(tie or ["signature"])).limit(k)


def top_by(df: DataFrame, measure: str, k: int, tie: str = "signature") -> DataFrame:
    return df.orderBy(F.col(measure).desc(), tie).limit(k)


def top_in_group(df: DataFrame, by: str, measure: str, k: int, tie: str = "signature") -> DataFrame:
    """The first k of each group."""
    w = Window.partitionBy(by).orderBy(F.col(measure).desc(), tie)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def by_size(patterns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Patterns of each size."""
    return patterns.groupBy(*(by or []), "size").agg(F.count("*").alias("n_patterns"))


def size_stats(rules: DataFrame, by: list[str], size: Column | None = None, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """by, size, n, mean and max confidence, mean support, mean and max lift for the given sizes, zeros where there are no rules."""
    size = F.size("consequent_states") if size is None else size
    agg = rules.groupBy(*by, size.alias("size")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("max_confidence"), F.avg("support").alias("mean_support"), F.avg("lift").alias("mean_lift"), F.max("lift").alias("max_lift"))
    grid = rules.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
    return grid.join(agg, [*by, "size"], "left").fillna(0).fillna(0.0)


def with_emotion(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("signature").contains("emo_"))


def in_words(rules: DataFrame) -> DataFrame:
    return rules.withColumn("words", exprs.rule_words(F.col("signature")))
