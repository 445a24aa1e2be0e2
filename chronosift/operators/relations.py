"""Counts of the relations of all pairs of a client's intervals, without the pairs.

For intervals in order of start and end the seven relations follow from five
counts: pairs of equal intervals, of equal starts, those where the first ends
before or when the second starts, and those with equal ends; what is left either
overlaps or contains, and the containing ones are a dominance count (start
before, end after).

A client of up to WHOLE distinct intervals is counted in one task. A longer one
is cut into blocks by starts and by ends: pairs within a block of starts, pairs
within a block of ends, and the rest from the numbers of intervals in each cell of
the two cuts. So the rows that are dealt out are a multiple of the intervals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.lineage import cut
from chronosift.operators.ordering import placed
from chronosift.operators.quantiles import joined, small
from chronosift.shipping import ship

#: Distinct intervals of a client that one task counts, and distinct values in a block.
WHOLE = 50_000
KINDS = ("b", "m", "o", "fi", "c", "=", "s")


def dominated(x: np.ndarray, y: np.ndarray, first: np.ndarray, second: np.ndarray) -> int:
    """Sum of first[i] * second[j] over pairs with x[i] < x[j] and y[i] > y[j], level by level of a merge tree over the ranks of x."""
    rank = np.unique(x, return_inverse=True)[1]
    total = 0
    for level in range(int(rank.max()).bit_length() if len(rank) else 0):
        node, right = rank >> (level + 1), (rank >> level) & 1
        # By node, greatest y first; of equal ones those to the right come first.
        order = np.lexsort((right == 0, -y, node))
        n, add = node[order], np.where(right[order] == 0, first[order], 0)
        above = np.cumsum(add) - add
        begins = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
        above -= np.repeat(above[begins], np.diff(np.append(begins, len(n))))
        total += int((above * np.where(right[order] == 1, second[order], 0)).sum())
    return total


def _twice(x: np.ndarray, y_first: np.ndarray, y_second: np.ndarray, n: np.ndarray) -> int:
    """dominated() where a row has another y as the second of a pair than as the first."""
    zero = np.zeros_like(n)
    return dominated(np.concatenate([x, x]), np.concatenate([y_first, y_second]), np.concatenate([n, zero]), np.concatenate([zero, n]))


def _pairs(n) -> int:
    return int((n * (n - 1) // 2).sum())


def _summed(values: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Sums of n by equal rows of values."""
    if not len(n):
        return n
    order = np.lexsort(values)
    new = np.zeros(len(n), dtype=bool)
    new[0] = True
    for v in values:
        new[1:] |= v[order][1:] != v[order][:-1]
    return np.add.reduceat(n[order], np.flatnonzero(new))


def counted(s: np.ndarray, e: np.ndarray, n: np.ndarray) -> dict[str, int]:
    """Pairs of each relation among distinct intervals, each there n times."""
    out = {"=": _pairs(n)}
    same_start = _pairs(_summed([s], n))
    out["s"] = same_start - out["="]
    later = np.maximum(s, e)
    order, starts = np.argsort(later, kind="stable"), np.argsort(s, kind="stable")
    ended = np.concatenate([[0], np.cumsum(n[order])])
    out["b"] = int((ended[np.searchsorted(later[order], s[starts])] * n[starts]).sum())
    real = s < e
    ends, started = np.sort(e[real]), np.concatenate([[0], np.cumsum(n[starts])])
    of_end = n[real][np.argsort(e[real], kind="stable")]
    out["m"] = int((of_end * (started[np.searchsorted(s[starts], ends, "right")] - started[np.searchsorted(s[starts], ends)])).sum())
    out["fi"] = _pairs(_summed([e[real]], n[real])) - _pairs(n[real])
    out["c"] = _twice(s, e, later, n)
    all_ = int(n.sum())
    out["o"] = all_ * (all_ - 1) // 2 - same_start - out["b"] - out["m"] - out["fi"] - out["c"]
    return out


def relation_counts(intervals: DataFrame, by: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """by, relation (its sign), n of all pairs of a client's sequence by start and end; relations without a pair are missing."""
    ship(intervals.sparkSession)
    key = list(by)
    points = cut(intervals.groupBy(*key, F.col("start_time").cast("double").alias("s"), F.col("end_time").cast("double").alias("e")).agg(F.count("*").alias("n")))
    sizes = points.groupBy(*key).agg(F.count("*").alias("_points"))
    long = sizes.filter(F.col("_points") > WHOLE).select(*key)
    schema = T.StructType([*[intervals.schema[c] for c in key], T.StructField("relation", T.StringType()), T.StructField("n", T.LongType())])

    def whole(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = counted(rows["s"].to_numpy(), rows["e"].to_numpy(), rows["n"].to_numpy())
        return pd.DataFrame([(*keys, k, found[k]) for k in KINDS if found[k]], columns=schema.names)

    if long.isEmpty():
        return points.groupBy(*key).applyInPandas(whole, schema)
    long = small(long)
    short = joined(points, long, key, "left_anti").groupBy(*key).applyInPandas(whole, schema)
    return short.unionByName(_of_long(joined(points, long, key), key).select(*schema.names))


def _tally(rows: DataFrame, key: list[str], of: list[str]) -> DataFrame:
    """key and the pairs of rows that are equal in of, as c."""
    n = rows.groupBy(*key, *of).agg(F.sum("n").alias("n"))
    return n.groupBy(*key).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("c"))


def _dominance(rows: DataFrame, key: list[str], part: list[str], x: str) -> DataFrame:
    """key and c: pairs within each part where x of the first is less and y greater. rows: key, part, x, y, first, second."""
    names = [*key, *part]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("c", T.LongType())])

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*keys, dominated(rows[x].to_numpy(), rows["y"].to_numpy(), rows["first"].to_numpy(), rows["second"].to_numpy()))], columns=schema.names)

    return rows.select(*names, *([x] if x not in names else []), "y", "first", "second").groupBy(*names).applyInPandas(run, schema).groupBy(*key).agg(F.sum("c").alias("c"))


def _of_long(points: DataFrame, key: list[str]) -> DataFrame:
    """key, relation, n of clients that no task takes whole."""
    points = points.withColumn("last", F.greatest("s", "e"))
    size = WHOLE
    # Blocks of distinct starts and of distinct later values, the same number in each: equal values are never parted.
    xs = placed(points.select(*key, "s").distinct(), key, ["s"]).select(*key, "s", F.expr(f"place div {size}").alias("xb"))
    values = points.select(*key, F.explode(F.array("s", "e", "last")).alias("v")).distinct()
    ys = cut(placed(values, key, ["v"]).select(*key, "v", F.expr(f"place div {size}").alias("yb")))
    block = lambda column, name: ys.select(*key, F.col("v").alias(column), F.col("yb").alias(name))
    p = joined(joined(joined(joined(points, xs, [*key, "s"]), block("e", "eb"), [*key, "e"]), block("last", "lb"), [*key, "last"]), block("s", "sb"), [*key, "s"])
    p = cut(p)
    zero = F.lit(0).cast("long")
    as_first = p.select(*key, "xb", F.col("eb").alias("yb"), F.col("s").alias("x"), F.col("e").alias("y"), F.col("n").alias("first"), zero.alias("second"))
    as_second = p.select(*key, "xb", F.col("lb").alias("yb"), F.col("s").alias("x"), F.col("last").alias("y"), zero.alias("first"), F.col("n").alias("second"))
    both = as_first.unionByName(as_second)
    cells = both.groupBy(*key, "xb", "yb").agg(F.sum("first").alias("first"), F.sum("second").alias("second"))
    contains = [
        _dominance(both, key, ["xb"], "x"),
        _dominance(both.withColumn("x", F.col("xb").cast("double")), key, ["yb"], "x"),
        _dominance(cells.withColumn("x", F.col("xb").cast("double")).withColumn("y", F.col("yb").cast("double")), key, [], "x"),
    ]
    # Before: those that ended in an earlier block of values, and those within the block.
    at = p.select(*key, F.col("lb").alias("yb"), F.col("last").alias("v"), F.col("n").alias("ended"), zero.alias("started")).unionByName(p.select(*key, F.col("sb").alias("yb"), F.col("s").alias("v"), zero.alias("ended"), F.col("n").alias("started")))
    timed = at.select(*key, "yb", F.col("v").alias("x"), (-F.col("v")).alias("y"), F.col("ended").alias("first"), F.col("started").alias("second"))
    blocks = at.groupBy(*key, "yb").agg(F.sum("ended").alias("first"), F.sum("started").alias("second")).select(*key, F.col("yb").cast("double").alias("x"), (-F.col("yb")).cast("double").alias("y"), "first", "second")
    # x rises where -y rises: a pair counts if the first's value is less.
    less = lambda rows, part: _dominance(rows.withColumn("y", -F.col("x")), key, part, "x")
    before = [less(timed, ["yb"]), less(blocks, [])]
    ended = p.filter("s < e").groupBy(*key, F.col("e").alias("v")).agg(F.sum("n").alias("_ended"))
    started = p.groupBy(*key, F.col("s").alias("v")).agg(F.sum("n").alias("_started"))
    meets = joined(ended, started, [*key, "v"]).groupBy(*key).agg(F.sum(F.col("_ended") * F.col("_started")).alias("c"))
    real = p.filter("s < e")
    tallies = {"=": [_tally(p, key, ["s", "e"])], "start": [_tally(p, key, ["s"])], "m": [meets], "b": before, "c": contains, "end": [_tally(real, key, ["e"])], "real": [_tally(real, key, ["s", "e"])], "all": [_tally(p, key, [])]}
    rows = None
    for name, frames in tallies.items():
        for f in frames:
            named = f.select(*key, F.lit(name).alias("k"), "c")
            rows = named if rows is None else rows.unionByName(named)
    of = lambda name: F.coalesce(F.sum(F.when(F.col("k") == name, F.col("c"))), F.lit(0)).alias(f"_{name}")
    one = rows.groupBy(*key).agg(*[of(n) for n in tallies])
    n = {"=": F.col("_="), "s": F.col("_start") - F.col("_="), "b": F.col("_b"), "m": F.col("_m"), "c": F.col("_c"), "fi": F.col("_end") - F.col("_real")}
    n["o"] = F.col("_all") - F.col("_start") - n["b"] - n["m"] - n["fi"] - n["c"]
    return one.select(*key, F.explode(F.array(*[F.struct(F.lit(k).alias("relation"), n[k].alias("n")) for k in KINDS])).alias("r")).select(*key, "r.relation", "r.n").filter("n > 0")
