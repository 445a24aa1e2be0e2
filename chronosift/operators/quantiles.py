"""Exact interpolated quantiles of keys of any size, by distributed selection.

A round sketches a key's values, takes two values that should enclose a wanted
rank, and counts exactly how many values lie below, at, between and above them;
the part that holds the rank is treated so again, until it is one value or
small. A part has some hundredth of the values before, however these are
distributed, and a wrong guess of the sketch costs a round, not the result. No
task holds a key's values. Keys of at most LIMIT values are taken by one
aggregation with their values in a buffer, as that is shorter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronosift.lineage import cut

#: Values of a key that one aggregation buffer may hold, and that are ranked in one window.
LIMIT = 1024
#: Steps of the sketch, and one in how many values a rank of it may be wrong by.
STEPS, ACCURACY = 512, 10_000
#: Frames of at most so many rows of a few numbers, some 16 MB, are broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, with a hint to broadcast it if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def joined(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a with what b has for its key, null equal to null; b's other columns have names of their own."""
    names = {c: f"_on{i}" for i, c in enumerate(by)}
    found = a.join(b.withColumnsRenamed(names), reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]), how)
    return found.drop(*names.values())


def quantiles(rows: DataFrame, by: list[str], value: str, probabilities: tuple[float, ...], limit: int | None = None) -> DataFrame:
    """by, n and p, the quantiles of each key's values, linear between ranks; nulls are left out, keys without a value missing.

    Keys may be null; equal values, of any number, are one bucket's; the columns
    v, n, p and those in use here (names with ``_``) are not to be keys.
    """
    limit = LIMIT if limit is None else limit
    values = cut(rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v")))
    ends = cut(values.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("_lo"), F.max("v").alias("_hi")))
    large = ends.filter(F.col("n") > limit)
    levels = F.array(*[F.lit(float(p)) for p in probabilities])
    if large.isEmpty():
        return values.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("v", levels).alias("p"))
    keys = small(large.select(*by))
    few = joined(values, keys, by, "left_anti").groupBy(*by).agg(F.count("*").alias("n"), F.percentile("v", levels).alias("p"))
    return few.unionByName(_selected(values, large, by, probabilities, limit))


def _selected(values: DataFrame, ends: DataFrame, by: list[str], probabilities: tuple[float, ...], limit: int) -> DataFrame:
    """by, n and p of the keys of ends (by, n, _lo, _hi)."""
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in places])))
    # Wanted ranks (from 0), each with the ends of the bucket it is in, the values below that, and those in it.
    wanted = cut(ends.select(*by, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("n").alias("_size")))
    is_open = (F.col("_lo") < F.col("_hi")) & (F.col("_size") > limit)
    while not (open_ := wanted.filter(is_open)).isEmpty():
        inside = _within(values, open_, by)
        sketch = inside.groupBy(*by, "_lo").agg(F.percentile_approx("v", [i / STEPS for i in range(STEPS + 1)], ACCURACY).alias("_q"))
        share = F.floor((F.col("_rank") - F.col("_below")) / F.col("_size") * STEPS).cast("int") + 1
        ends_of = [F.element_at("_q", F.greatest(share - 1, F.lit(1))), F.element_at("_q", F.least(share + 2, F.lit(STEPS + 1)))]
        cuts = joined(open_, sketch, [*by, "_lo"]).groupBy(*by, "_lo").agg(F.array_distinct(F.flatten(F.collect_list(F.array(*ends_of)))).alias("_cuts"))  # two a wanted rank
        part = F.aggregate("_cuts", F.lit(0), lambda n, c: n + (F.col("v") >= c).cast("int") + (F.col("v") > c).cast("int"))
        cells = joined(inside, small(cuts), [*by, "_lo"]).groupBy(*by, "_lo", "_below", part.alias("_bucket")).agg(F.count("*").alias("_c"), F.min("v").alias("_min"), F.max("v").alias("_max"))
        before = F.sum("_c").over(Window.partitionBy(*by, "_lo").orderBy("_bucket")) - F.col("_c") + F.col("_below")
        cells = cells.select(*by, "_lo", before.alias("_before"), "_c", "_min", "_max")
        moved = joined(open_, cells, [*by, "_lo"]).filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
        moved = moved.select(*by, "_rank", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_before").alias("_below"), F.col("_c").alias("_size"))
        wanted = cut(wanted.filter(~is_open).unionByName(moved))
    done = wanted.filter("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("v"))
    rest = wanted.filter("_lo < _hi")
    place = F.row_number().over(Window.partitionBy(*by, "_lo").orderBy("v")) - 1 + F.col("_below")  # of limit values at most
    ranked = _within(values, rest, by).select(*by, "_lo", place.alias("_place"), "v")
    found = joined(rest.select(*by, "_lo", "_rank"), ranked, [*by, "_lo"]).filter("_rank = _place").select(*by, "_rank", "v")
    at = done.unionByName(found).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "v"))).alias("_at"))  # two ranks a quantile
    both = joined(ends.select(*by, "n"), at, by)
    value_at = lambda x: F.element_at("_at", x)
    p = [value_at(F.floor(x)) + (value_at(F.ceil(x)) - value_at(F.floor(x))) * (x - F.floor(x)) for x in places]
    return both.select(*by, "n", F.array(*p).alias("p"))


def _within(values: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The values in the buckets of wanted ranks, once for each bucket."""
    spans = small(wanted.select(*by, "_lo", "_hi", "_below").distinct())
    return joined(values, spans, by).filter((F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi")))

