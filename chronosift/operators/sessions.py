"""Grids of sessions: windows between the ends that several sources have in common.

A session (a condition, a video) has label and signal sources with clocks of
their own. Its grid starts where all labels and the first of the key signals
have begun, and ends with the first label that ends; windows are whole. Sessions
of a client are grids of their own, whether they follow one another, overlap,
or each start at 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronosift.lineage import cut
from chronosift.operators.quantiles import joined, small


def bounds(samples: DataFrame, by: list[str], labels: list[str], signals: list[str], source: str = "source", ts: str = "ts") -> DataFrame:
    """by, origin, bound of each session that has all labels and one of the signals, and any time between.

    One aggregation by session and source: latest start and earliest end.
    """
    per = samples.filter(F.col(source).isin(*labels, *signals)).groupBy(*by, source).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    is_label, is_signal = F.col(source).isin(*labels), F.col(source).isin(*signals)
    one = per.groupBy(*by).agg(
        F.count_if(is_label).alias("_n"), F.max(F.when(is_label, F.col("_a"))).alias("_labels"), F.min(F.when(is_label, F.col("_z"))).alias("bound"), F.min(F.when(is_signal, F.col("_a"))).alias("_signals")
    )
    ready = one.filter((F.col("_n") == len(set(labels))) & F.col("_signals").isNotNull())
    return ready.select(*by, F.greatest("_labels", "_signals").alias("origin"), "bound").filter("bound > origin")


def restarted(samples: DataFrame, by: list[str], labels: list[str], source: str = "source", ts: str = "ts") -> DataFrame:
    """by, origin, bound of sessions whose clock starts anew: from 0 to the last label."""
    return samples.filter(F.col(source).isin(*labels)).groupBy(*by).agg(F.max(ts).cast("double").alias("bound")).select(*by, F.lit(0.0).alias("origin"), "bound")


def grid(bounds_: DataFrame, by: list[str], width: float) -> DataFrame:
    """by, window (from 0), seconds (its end) of each session's whole windows."""
    n = F.floor((F.col("bound") - F.col("origin")) / width)
    wins = bounds_.withColumn("_n", n).filter("_n > 0").select(*by, "origin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("window"))
    return wins.select(*by, "window", (F.col("origin") + (F.col("window") + 1) * float(width)).alias("seconds"))


def session_windows(samples: DataFrame, bounds_: DataFrame, by: list[str], width: float, sources: list[str], source: str = "source", ts: str = "ts", value: str = "value") -> DataFrame:
    """by, window, seconds, and n and mean of each source's known values in [start, end) of each whole window; a window without a sample has n 0 and a null mean."""
    inside = joined(samples.filter(F.col(source).isin(*sources)).select(*by, F.col(source).alias("_source"), F.col(ts).alias("_ts"), F.col(value).alias("_value")), small(bounds_), by)
    at = F.floor((F.col("_ts") - F.col("origin")) / float(width))
    placed = inside.withColumn("_window", at).filter((F.col("_ts") >= F.col("origin")) & (F.col("_window") < F.floor((F.col("bound") - F.col("origin")) / float(width))))
    of = lambda name: F.when(F.col("_source") == name, F.col("_value"))
    aggs: list[Column] = reduce(lambda a, b: a + b, [[F.count(of(n)).alias(f"{n}_n"), F.avg(of(n)).alias(f"{n}_mean")] for n in sources])
    found = placed.groupBy(*by, F.col("_window").alias("window")).agg(*aggs)
    return joined(grid(bounds_, by, width), found, [*by, "window"], "left").fillna(0, [f"{n}_n" for n in sources])


def chained_labels(samples: DataFrame, segments: DataFrame, by: list[str], ts: str = "ts", order: str = "no", label: str = "label", duration: str = "duration") -> DataFrame:
    """samples with label: a client's segments follow one another, each ending at the sample nearest to the end before plus its duration.

    Of two samples equally near the earlier is the end; samples after the last
    end have no label; samples of one time have one label. A step finds one end
    for all clients at once, from the nearest samples on either side; there are
    as many steps as a client has segments. A client's ends are few, and meet
    its samples in one join.
    """
    rows = segments.select(*by, F.row_number().over(_by_order(by, order)).alias("_no"), F.col(label).alias("_label"), F.col(duration).cast("double").alias("_long"))
    steps = rows.agg(F.max("_no")).first()[0] or 0
    times = samples.select(*by, F.col(ts).cast("double").alias("_ts"))
    ends = rows.select(*by).distinct().withColumn("_end", F.lit(0.0))
    found = None
    for no in range(1, steps + 1):
        due = joined(ends, rows.filter(F.col("_no") == no), by).withColumn("_due", F.col("_end") + F.col("_long"))
        near = joined(times, small(due.select(*by, "_due")), by).groupBy(*by).agg(F.max(F.when(F.col("_ts") <= F.col("_due"), F.col("_ts"))).alias("_before"), F.min(F.when(F.col("_ts") >= F.col("_due"), F.col("_ts"))).alias("_after"))
        at = joined(due, near, by)
        nearest = F.when(F.col("_before").isNull() | (F.col("_after") - F.col("_due") < F.col("_due") - F.col("_before")), F.col("_after")).otherwise(F.col("_before"))
        at = cut(at.select(*by, "_no", "_label", F.col("_end").alias("_from"), nearest.alias("_to")))
        found = at if found is None else found.unionByName(at)
        ends = at.select(*by, F.col("_to").alias("_end"))
    if found is None:
        return samples.withColumn(label, F.lit(None).cast("string"))
    all_ = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_no", "_from", "_to", "_label"))).alias("_ends"))
    t = F.col(ts).cast("double")
    mine = F.filter("_ends", lambda x: (t <= x["_to"]) & ((t > x["_from"]) | (x["_no"] == 1)))
    return joined(samples, small(all_), by, "left").withColumn(label, F.try_element_at(mine, F.lit(-1))["_label"]).drop("_ends")


def _by_order(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)
