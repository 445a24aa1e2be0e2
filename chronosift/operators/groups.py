"""Intervals by groups of clients: demographic joins, distributions, cross-tabulation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.functions import exprs


def with_group(intervals: DataFrame, demographics: DataFrame, group: str) -> DataFrame:
    """The intervals of clients that have the group, with it."""
    d = demographics.filter(F.col(group).isNotNull()).select("client_id", group).dropDuplicates(["client_id"])
    return intervals.join(d, "client_id")


def interaction_groups(intervals: DataFrame, demographics: DataFrame, a: str, b: str, least: int = 3) -> DataFrame:
    """The intervals with grp ``a_b``; groups of fewer than least clients are left out."""
    d = demographics.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select("client_id", F.concat_ws("_", a, b).alias("grp")).dropDuplicates(["client_id"])
    rows = intervals.join(d, "client_id")
    large = rows.groupBy("grp").agg(F.countDistinct("client_id").alias("n")).filter(F.col("n") >= least).select("grp")
    return rows.join(large, "grp", "left_semi")


def state_per_client(intervals: DataFrame, group: str) -> DataFrame:
    """group, state, mean count over the clients that have the state."""
    counts = intervals.groupBy(group, "state", "client_id").agg(F.count("*").alias("n"))
    return counts.groupBy(group, "state").agg(F.avg("n").alias("mean_count"), F.count("*").alias("n_clients"))


def feature_share(intervals: DataFrame, group: str) -> DataFrame:
    """group, feature, share of the group's intervals; 0 for features it does not have."""
    f = intervals.select(group, exprs.state_feature(F.col("state")).alias("feature"))
    n, total = f.groupBy(group, "feature").agg(F.count("*").alias("n")), f.groupBy(group).agg(F.count("*").alias("total"))
    names = f.select("feature").distinct().agg(F.collect_list("feature").alias("names"))  # one row
    grid = total.join(F.broadcast(names)).select(group, "total", F.explode("names").alias("feature"))
    return grid.join(n, [group, "feature"], "left").select(group, "feature", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def distributions(intervals: DataFrame, group: str) -> DataFrame:
    """The counts of A10 for several groupings at once: each group, and all clients together (group null), with grouping sets."""
    counts = intervals.groupBy(group, "state", "client_id").agg(F.count("*").alias("n"))
    return counts.rollup("state", group).agg(F.avg("n").alias("mean_count"), F.count("*").alias("n_clients")).filter(F.col("state").isNotNull())


def crosstab(demographics: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Clients by row and column value, 0 where there are none."""
    return demographics.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def first_row(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """The values of the first row of each key."""
    return rows.groupBy(by).agg(*[F.min_by(F.col(c), F.col(order)).alias(c) for c in columns])
