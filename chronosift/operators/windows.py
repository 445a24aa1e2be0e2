"""Time windows over sampled signals: tumbling grids, window features, heart rate, interval joins.

Windows are [start, end) and labelled by their end. On a grid a sample's window
is an expression of its time, so that features are one aggregation without a
join; windows that follow annotations are joined by equal buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronosift.functions import exprs

FAST, SLOW = 5.0, 30.0


def window_id(ts: Column, width: float, origin: float | Column = 0.0) -> Column:
    origin = origin if isinstance(origin, Column) else F.lit(float(origin))
    return F.floor((ts - origin) / F.lit(float(width))).cast("long")


def window_end(wid: Column, width: float, origin: float | Column = 0.0) -> Column:
    origin = origin if isinstance(origin, Column) else F.lit(float(origin))
    return origin + (wid + 1) * F.lit(float(width))


def spread(v: Column | str) -> Column:
    """Sample deviation; 0 of one value."""
    return F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v))


def window_stats(samples: DataFrame, by: list[str], width: float, ts: str = "ts", value: str = "value", origin: float | Column = 0.0, complete_until: Column | None = None) -> DataFrame:
    """by, seconds (window end), n, mean, std, min, max, sum; with complete_until only windows that end by then."""
    wid = window_id(F.col(ts), width, origin)
    rows = samples.withColumn("_w", wid)
    if complete_until is not None:
        rows = rows.filter(window_end(F.col("_w"), width, origin) <= complete_until)
    v = exprs.known(F.col(value))
    agg = rows.groupBy(*by, "_w").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), spread(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"))
    return agg.withColumn("seconds", window_end(F.col("_w"), width, origin)).drop("_w")


def slope(values: Column, times: Column) -> Column:
    """Least-squares slope; 0 with fewer than two samples or equal times."""
    return F.coalesce(F.regr_slope(values, times), F.lit(0.0))


def temperature_features(samples: DataFrame, by: list[str], width: float, ts: str = "ts", value: str = "value") -> DataFrame:
    """by, seconds, temp_mean, temp_slope."""
    w = samples.withColumn("_w", window_id(F.col(ts), width))
    agg = w.groupBy(*by, "_w").agg(F.avg(value).alias("temp_mean"), slope(F.col(value), F.col(ts)).alias("temp_slope"))
    return agg.withColumn("seconds", window_end(F.col("_w"), width)).drop("_w")


def acceleration_features(samples: DataFrame, by: list[str], width: float, ts: str = "ts", axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """by, seconds, mean and deviation of each axis and of the magnitude."""
    x, y, z = (F.col(a) for a in axes)
    rows = samples.withColumn("_w", window_id(F.col(ts), width)).withColumn("_m", F.sqrt(x * x + y * y + z * z))
    aggs = [f(c).alias(f"acc_{n}_{k}") for n, c in ((*((a, a) for a in axes), ("magnitude", "_m"))) for k, f in (("mean", F.avg), ("std", spread))]
    return rows.groupBy(*by, "_w").agg(*aggs).withColumn("seconds", window_end(F.col("_w"), width)).drop("_w")


def one_hertz_features(rows: DataFrame, by: list[str], second: str = "sec", width: int = 5, emotions: tuple[str, ...] = tuple(exprs.CIRCUMPLEX)) -> DataFrame:
    """by, seconds, EDA mean, deviation and maximum, mean temperature, heart rate mean and deviation, emotion means and the arousal and valence they give.

    Rows are one a second from 1; the last window may be partial.
    """
    have = [e for e in emotions if e in rows.columns]
    w = F.floor((F.col(second) - 1) / width).cast("long")
    aggs = [F.avg("EDA").alias("eda_mean"), spread("EDA").alias("eda_std"), F.max("EDA").alias("eda_max"), F.avg("TEMP").alias("temp_mean"), F.avg("HR").alias("hr_mean"), spread("HR").alias("hr_std"), *[F.avg(e).alias(e) for e in have]]
    out = rows.groupBy(*by, w.alias("_w")).agg(*aggs)
    arousal, valence = exprs.circumplex({e: F.col(e) for e in have})
    return out.withColumn("seconds", ((F.col("_w") + 1) * width).cast("double")).withColumn("arousal", arousal).withColumn("valence", valence).drop("_w", *have)


def both_resolutions(fast: DataFrame, slow: DataFrame) -> DataFrame:
    """Rows of both resolutions in one table, each null in the other's features; fast comes first where times are equal."""
    return fast.withColumn("window_type", F.lit("fast")).unionByName(slow.withColumn("window_type", F.lit("slow")), allowMissingColumns=True)


def positional_join(a: DataFrame, b: DataFrame, by: list[str], order_a: str, order_b: str) -> DataFrame:
    """Rows of equal place within by, as far as the shorter goes; sec is the place from 1."""
    wa, wb = Window.partitionBy(*by).orderBy(order_a), Window.partitionBy(*by).orderBy(order_b)
    x, y = a.withColumn("sec", F.row_number().over(wa)), b.withColumn("sec", F.row_number().over(wb))
    return x.join(y, [*by, "sec"])


def range_join(samples: DataFrame, spans: DataFrame, by: list[str], bucket: float, ts: str = "ts", start: str = "start", end: str = "end") -> DataFrame:
    """Samples with each span [start, end) of their key that holds them.

    Spans are given to all buckets of time that they touch, samples to one, so
    that the join is one of equal keys. bucket: about the spans' usual length.
    """
    s = samples.withColumn("_b", window_id(F.col(ts), bucket))
    # The end itself is outside: a span up to a bucket's edge does not touch the next.
    last = F.ceil(F.col(end) / F.lit(float(bucket))).cast("long") - 1
    p = spans.filter(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(window_id(F.col(start), bucket), last)))
    return s.join(p, [*by, "_b"]).filter((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_b")


def annotation_windows(annotations: DataFrame, by: list[str], per: int, step: float = 5.0, seconds: str = "seconds") -> DataFrame:
    """by, start, end, seconds, mean arousal and valence of each ``per`` annotations in order; a rest of fewer is dropped. A window spans from the first annotation less a step to the last."""
    w = Window.partitionBy(*by).orderBy(seconds)
    rows = annotations.withColumn("_g", F.floor((F.row_number().over(w) - 1) / per))
    agg = rows.groupBy(*by, "_g").agg(F.count("*").alias("_n"), (F.min(seconds) - step).alias("start"), F.max(seconds).alias("end"), F.avg("arousal").alias("arousal"), F.avg("valence").alias("valence"))
    return agg.filter(F.col("_n") == per).withColumn("seconds", F.col("end")).drop("_g", "_n")


def ibi_unit_factor(ibi: Column) -> Column:
    """1000 if the mean of the first intervals says seconds, 1 if milliseconds."""
    return F.when(ibi > 100, F.lit(1.0)).otherwise(F.lit(1000.0))


def first_ibi_mean(beats: DataFrame, by: list[str], ts: str = "ts", ibi: str = "ibi", first: int = 10) -> DataFrame:
    """by, factor to milliseconds, from the mean of the first intervals."""
    w = Window.partitionBy(*by).orderBy(ts)
    few = beats.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first)
    return few.groupBy(*by).agg(ibi_unit_factor(F.avg(ibi)).alias("factor"))


def rr_intervals(peaks: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """by, ts (midpoint), ibi in ms between consecutive peaks, ts in seconds."""
    w = Window.partitionBy(*by).orderBy(ts)
    nxt = F.lead(ts).over(w)
    return peaks.select(*by, ((F.col(ts) + nxt) / 2).alias("ts"), ((nxt - F.col(ts)) * 1000).alias("ibi")).filter(F.col("ibi").isNotNull())


def heart_rate_grid(beats: DataFrame, by: list[str], ts: str = "ts", ibi: str = "ibi", step: float = 1.0) -> DataFrame:
    """by, ts, hr: 60000 / ibi of plausible beats, interpolated linearly on a grid from 0; null outside the beats.

    Each beat yields the grid points up to the next one, so that no table of
    grid points is joined. Beats at one time are averaged.
    """
    grid = _stretches(beats, by, ts, ibi, step).withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("ts", F.col("_k") * F.lit(step))
    return grid.select(*by, "ts", (F.col("h0") + F.col("_rise") * (F.col("ts") - F.col("t0")) / F.col("_long")).alias("hr"))


def _beats_and_next(beats: DataFrame, by: list[str], ts: str, ibi: str, keep: tuple[str, ...] = (), order: tuple[str, ...] = ("t0",)) -> DataFrame:
    """by, keep, t0, h0, t1, h1 and _first: each plausible beat with the next one; beats at one time are averaged, those without a time dropped.

    All of it is windows over one order of the key, so that beats are dealt out
    and sorted once; keep are columns that are constant within a key and time,
    and order is one by time: columns of keep may go before it that grow with it.
    """
    order = Window.partitionBy(*by).orderBy(*order)
    good = beats.filter(exprs.valid_ibi(F.col(ibi)) & F.col(ts).isNotNull()).select(*by, *keep, F.col(ts).cast("double").alias("t0"), (60000.0 / F.col(ibi)).alias("_hr"))
    mean = F.avg("_hr").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    ranked = good.select("*", mean.alias("h0"), F.row_number().over(order).alias("_no"), F.rank().over(order).alias("_rank")).filter("_no = _rank")
    return ranked.select(*by, *keep, "t0", "h0", F.lead("t0").over(order).alias("t1"), F.lead("h0").over(order).alias("h1"), (F.col("_no") == 1).alias("_first"))


def _first_point(t: Column, step: float) -> Column:
    return F.ceil(F.greatest(t, F.lit(0.0)) / step).cast("long")


def _stretches(beats: DataFrame, by: list[str], ts: str, ibi: str, step: float, keep: tuple[str, ...] = (), order: tuple[str, ...] = ("t0",)) -> DataFrame:
    """by, keep, t0, h0, _rise over _long and the grid points _low to _high of each beat that has any: those up to, but without, the next beat; the last beat has its own point only."""
    seg = _beats_and_next(beats, by, ts, ibi, keep, order)
    last = F.when(F.col("t1").isNull(), F.floor(F.col("t0") / step)).otherwise(F.ceil(F.col("t1") / step) - 1).cast("long")
    rise, long = F.coalesce(F.col("h1") - F.col("h0"), F.lit(0.0)), F.coalesce(F.col("t1") - F.col("t0"), F.lit(1.0))
    return seg.select(*by, *keep, "t0", "h0", rise.alias("_rise"), long.alias("_long"), _first_point(F.col("t0"), step).alias("_low"), last.alias("_high")).filter("_low <= _high")


def heart_rate_windows(beats: DataFrame, by: list[str], width: float, ts: str = "ts", ibi: str = "ibi", step: float = 1.0) -> DataFrame:
    """by, seconds, hr_mean, hr_std: ``hr_window_features`` of ``heart_rate_grid``, without its points.

    The points of one beat in one window are an arithmetic progression, of which
    number, mean and squared deviations are known. A window has points of the
    beats whose first point is in it (_f), and of one beat before these at most,
    so that it is told from windows over the one order in which beats are
    sorted; the further windows that a beat reaches are its own, and are made
    last. There is no aggregation of them, however far apart beats are.
    """
    window = lambda k: F.floor(k * F.lit(step) / F.lit(float(width))).cast("long")

    def edges(rows: DataFrame, w: Column) -> DataFrame:
        """With _a and _e, the first and last point of window w, as window_id places points: the quotient may be wrong by one."""
        near = lambda w: F.ceil(w * F.lit(float(width)) / F.lit(step)).cast("long")
        first = lambda k, w: k - (window(k - 1) >= w).cast("long") + (window(k) < w).cast("long")
        return rows.withColumns({"_a": near(w), "_e": near(w + 1)}).withColumns({"_a": first(F.col("_a"), w), "_e": first(F.col("_e"), w + 1) - 1})

    def points(a: str, z: str, beat=F.col) -> Column:
        """n, m (mean) and d (squared deviations from it) of a beat's points a to z; null where there are none."""
        n, slope = (F.col(z) - F.col(a) + 1).cast("double"), beat("_rise") * F.lit(step) / beat("_long")
        m = beat("h0") + beat("_rise") * ((F.col(a) + F.col(z)) / F.lit(2.0) * F.lit(step) - beat("t0")) / beat("_long")
        return F.when(F.col(a) <= F.col(z), F.struct(n.alias("n"), m.alias("m"), (slope * slope * n * (n * n - 1) / 12).alias("d")))

    # Columns are named step by step: written as one expression they are a method too large for the JVM to compile.
    placed = beats.repartition(*by).withColumn("_f", window(_first_point(F.col(ts).cast("double"), step)))
    order, same = Window.partitionBy(*by).orderBy("_f", "t0"), Window.partitionBy(*by, "_f")
    beat = F.struct("t0", "h0", "_rise", "_long", "_high", "_f")
    rows = _stretches(placed, by, ts, ibi, step, ("_f",), ("_f", "t0")).select("*", F.lag(beat).over(order).alias("_b"), F.lead("_f").over(order).alias("_next"))
    rows = edges(rows, F.col("_f")).withColumns({"_z": F.least("_high", "_e"), "_y": F.when(F.col("_b._f") < F.col("_f"), F.least("_b._high", "_e"))})
    rows = rows.withColumns({"_p": points("_low", "_z"), "_q": points("_a", "_y", lambda c: F.col(f"_b.{c}"))})
    both = lambda f: F.sum(f("_p") + F.coalesce(f("_q"), F.lit(0.0))).over(same)
    rows = rows.withColumns({"_n": both(lambda p: F.col(f"{p}.n")), "_s": both(lambda p: F.col(f"{p}.n") * F.col(f"{p}.m"))}).withColumn("_m", F.col("_s") / F.col("_n"))
    off = lambda p: F.col(f"{p}.m") - F.col("_m")
    rows = rows.withColumn("_d", both(lambda p: F.col(f"{p}.d") + F.col(f"{p}.n") * off(p) * off(p)))
    # The last beat of a window goes on to the window in which the next beat begins, which is that one's.
    reach = F.least(window(F.col("_high")), F.col("_next") - 1)
    lasts = rows.filter("_next IS NULL OR _next > _f").select(*by, "t0", "h0", "_rise", "_long", "_high", "_f", F.struct(F.col("_n").alias("n"), F.col("_m").alias("m"), F.col("_d").alias("d")).alias("_own"), reach.alias("_reach"))
    wid = F.col("_w")
    parts = edges(lasts.withColumn("_w", F.explode(F.sequence("_f", "_reach"))), wid).withColumn("_z", F.least("_high", "_e")).filter("_w = _f OR _a <= _z")
    found = parts.select(*by, "_w", F.when(wid == F.col("_f"), F.col("_own")).otherwise(points("_a", "_z")).alias("_p"))
    std = F.when(F.col("_p.n") == 1, F.lit(0.0)).otherwise(F.sqrt(F.col("_p.d") / (F.col("_p.n") - 1)))
    return found.select(*by, window_end(wid, width).alias("seconds"), F.col("_p.m").alias("hr_mean"), std.alias("hr_std"))


def grid_of_beats(beats: DataFrame, ends: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """by, start, step, n of the grid of each recording (ends: by, max_time) with beats (valid ones).

    The clock is told from the last time: beyond 10000 it counts milliseconds.
    Beyond 100000 it may be absolute: the grid then starts with the first beat if
    that is as late, and else one step before the end; other grids start at 0.
    Recordings of fewer than 2 beats, and those that end before their first
    absolute beat, have none.
    """
    first = beats.groupBy(*by).agg(F.min(ts).alias("_begin"), F.count("*").alias("_n"))
    return _points(_told(ends.join(first, by)), by)


def _told(recordings: DataFrame) -> DataFrame:
    """The recordings (max_time, _begin of _n beats) that have a grid, with step and start, as ``grid_of_beats`` tells them."""
    step = F.when(F.col("max_time") > 10_000, F.lit(1000.0)).otherwise(F.lit(1.0))
    absolute = F.when(F.col("_begin") > 100_000, F.when(F.col("max_time") > F.col("_begin"), F.floor(F.col("_begin") / F.col("step")) * F.col("step"))).otherwise(F.col("max_time") - F.col("step"))
    known = recordings.filter("max_time > 0 AND _n >= 2").withColumn("step", step)
    return known.withColumn("start", F.when(F.col("max_time") > 100_000, absolute).otherwise(F.lit(0.0)))


def grid_of_signal(signal: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """by, start, step, n of the grid from a signal's first time to its last; beyond 10000 times are milliseconds."""
    ends = signal.groupBy(*by).agg(F.min(ts).cast("double").alias("start"), F.max(ts).cast("double").alias("max_time"))
    return _points(ends.withColumn("step", F.when(F.col("max_time") > 10_000, F.lit(1000.0)).otherwise(F.lit(1.0))), by)


def _points(grids: DataFrame, keep: list[str]) -> DataFrame:
    return grids.filter("start < max_time").select(*keep, F.col("start").cast("double").alias("start"), "step", F.ceil((F.col("max_time") - F.col("start")) / F.col("step")).cast("long").alias("n"))


def heart_rate_on(beats: DataFrame, grids: DataFrame, by: list[str], ts: str = "ts", ibi: str = "ibi") -> DataFrame:
    """by, ts, hr on each recording's own grid (by, start, step, n): 60000 / ibi of beats (ibi in ms), interpolated linearly, null before the first and after the last beat.

    A beat yields the points up to the next one, the first those before it and
    the last those behind; beats at one time are averaged. A recording without
    a plausible beat has its points too, all null.
    """
    return _on_points(grids.join(_beats_and_next(beats, by, ts, ibi), by, "left"), by)


def heart_rate_told(beats: DataFrame, by: list[str], ts: str = "ts", ibi: str = "ibi", first: int = 10) -> DataFrame:
    """by, ts, hr of recordings in either unit and clock: ``heart_rate_on`` of ``grid_of_beats``, the unit being that of ``first_ibi_mean``.

    The unit, the end and the grid of a recording come from windows over its
    beats, which are dealt out and sorted once, and joined with nothing.
    """
    whole, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("t0")
    rows = beats.dropna(subset=by).select(*by, F.col(ts).cast("double").alias("t0"), F.col(ibi).alias("_ibi"))
    early = F.avg(F.when(F.col("_r") <= first, F.col("_ibi"))).over(whole)
    clocked = rows.withColumn("_r", F.row_number().over(order)).select(*by, "t0", (F.col("_ibi") * ibi_unit_factor(early)).alias("_ibi"), F.max("t0").over(whole).alias("max_time"))
    seg = _beats_and_next(clocked, by, "t0", "_ibi", ("max_time",))
    told = _told(seg.select("*", F.min("t0").over(whole).alias("_begin"), F.count("*").over(whole).alias("_n")))
    return _on_points(_points(told, [*by, "t0", "h0", "t1", "h1", "_first"]), by)


def _on_points(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, ts, hr: the grid points (start, step, n) that each beat (t0, h0, t1, h1, _first) yields; t0 is null in recordings without beats."""
    point = lambda k: F.col("start") + k * F.col("step")
    near = lambda t: F.ceil((F.col(t) - F.col("start")) / F.col("step")).cast("long")
    # The first point that is not before t: the quotient may be wrong by one.
    at = lambda t: near(t) - (point(near(t) - 1) >= F.col(t)).cast("long") + (point(near(t)) < F.col(t)).cast("long")
    low = F.when(F.coalesce("_first", F.lit(True)), F.lit(0).cast("long")).otherwise(F.greatest(at("t0"), F.lit(0).cast("long")))
    high = F.least(F.when(F.col("t1").isNull(), F.col("n")).otherwise(at("t1")), F.col("n")) - 1
    rows = rows.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
    points = rows.withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("ts", point(F.col("_k")))
    between = F.col("h0") + (F.col("h1") - F.col("h0")) * (F.col("ts") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    hr = F.when(F.col("ts") == F.col("t0"), F.col("h0")).when(F.col("ts") > F.col("t0"), between)
    return points.select(*by, "ts", hr.alias("hr"))


def hr_window_features(grid: DataFrame, by: list[str], width: float) -> DataFrame:
    return window_stats(grid, by, width, "ts", "hr").select(*by, "seconds", F.col("mean").alias("hr_mean"), F.col("std").alias("hr_std"))


def hrv_time_domain(beats: DataFrame, by: list[str], ts: str = "ts", ibi: str = "ibi") -> DataFrame:
    """Time-domain variability of plausible intervals (ms) by key; null with fewer than 3.

    Differences are those of consecutive kept intervals. pNNx is the share of
    differences above x ms, in percent of the differences; MAD is scaled by
    1.4826.
    """
    good = beats.filter(exprs.valid_ibi(F.col(ibi)))
    w = Window.partitionBy(*by).orderBy(ts)
    d = good.withColumn("_d", F.col(ibi) - F.lag(ibi).over(w)).withColumn("_med", F.percentile(ibi, 0.5).over(Window.partitionBy(*by)))
    q = F.percentile(ibi, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    agg = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(ibi).alias("hrv_mean_nn"), F.stddev_samp(ibi).alias("hrv_sdnn"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("hrv_rmssd"), F.stddev_samp("_d").alias("hrv_sdsd"),
        q.alias("_q"), (F.percentile(F.abs(F.col(ibi) - F.col("_med")), 0.5) * 1.4826).alias("hrv_mad_nn"),
        (F.count_if(F.abs("_d") > 50) / F.count("_d") * 100).alias("hrv_pnn50"), (F.count_if(F.abs("_d") > 20) / F.count("_d") * 100).alias("hrv_pnn20"),
    ).filter("n >= 3")
    return agg.withColumns({
        "hrv_cvnn": F.col("hrv_sdnn") / F.col("hrv_mean_nn"), "hrv_cvsd": F.col("hrv_rmssd") / F.col("hrv_mean_nn"), "hrv_median_nn": F.col("_q")[1],
        "hrv_mcvnn": F.col("hrv_mad_nn") / F.col("_q")[1], "hrv_iqrnn": F.col("_q")[2] - F.col("_q")[0],
    }).drop("_q")


def hrv_in_windows(beats: DataFrame, by: list[str], width: float, ts: str = "ts", ibi: str = "ibi") -> DataFrame:
    """by, seconds (window end) and the time-domain variability of each window's beats; windows of fewer than 3 plausible ones are left out."""
    placed = beats.withColumn("seconds", window_end(window_id(F.col(ts), width), width))
    return hrv_time_domain(placed, [*by, "seconds"], ts, ibi)


def nearest(left: DataFrame, right: DataFrame, by: list[str], ts: str, right_ts: str, value: str) -> DataFrame:
    """Each left row with the value of the right row nearest in time (the earlier of two), by one sort of both sides."""
    a = left.select(*by, F.col(ts).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("double").alias("_rt"), F.struct(*left.columns).alias("_row"))
    b = right.select(*by, F.col(right_ts).alias("_t"), F.col(value).alias("_v"), F.col(right_ts).cast("double").alias("_rt"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    both = a.unionByName(b)
    past = Window.partitionBy(*by).orderBy("_t", F.col("_rt").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy("_t", F.col("_rt").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    s = F.when(F.col("_rt").isNotNull(), F.struct("_rt", "_v"))
    found = both.withColumn("_p", F.last(s, ignorenulls=True).over(past)).withColumn("_n", F.first(s, ignorenulls=True).over(ahead)).filter(F.col("_row").isNotNull())
    before = F.col("_n").isNull() | (F.col("_p").isNotNull() & (F.col("_t") - F.col("_p._rt") <= F.col("_n._rt") - F.col("_t")))
    return found.select("_row.*", F.when(before, F.col("_p._v")).otherwise(F.col("_n._v")).alias(value))


def outer_merge(series: DataFrame, key: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Series below one another to one row a key with a column for each name: a full outer merge as one aggregation. Of repeated points the least value counts."""
    return series.groupBy(*key).agg(*[F.min(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def merged_series(series: DataFrame, by: list[str], frame: str, name: str, value: str, names: list[str], context: list[str]) -> DataFrame:
    """by, frame, a column for each of names, and context: the full outer merge of the series of all keys at once.

    The context columns are those of the first series a key has, in the order of
    names, and null in frames it lacks; of repeated points the least counts.
    """
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(name))
    known = series.filter(F.col(name).isin(*names)).withColumn("_order", order)
    first = known.groupBy(*by).agg(F.min("_order").alias("_lead"))
    leading = F.col("_order") == F.col("_lead")
    aggs = [F.min(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names] + [F.min(F.when(leading, F.col(c))).alias(c) for c in context]
    return known.join(first, by).groupBy(*by, frame).agg(*aggs)
