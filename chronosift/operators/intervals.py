"""From feature rows to state intervals: normalisation, level thresholds, run-length encoding, validation.

Feature tables are long here: one row for each (client, variable, time), the
variable's value null where a row of the wide table has none. So all variables
of all clients are encoded by one window over (client, variable).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronosift.functions import exprs
from chronosift.operators import relations
from chronosift.operators.quantiles import joined, quantiles, small

#: Seconds after the last row at which the last interval of a variable ends.
CLOSING = 30.0
#: A spread below this is flat.
FLAT = 1e-10


def to_long(wide: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """keys, var, value: the wide rows' variables below one another; missing columns are left out."""
    have = [v for v in variables if v in wide.columns]
    return wide.select(*keys, *[exprs.known(F.col(v)).alias(v) for v in have]).unpivot(keys, have, "var", "value")


def personal_minmax(long: DataFrame, by: list[str], value: str = "value") -> Column:
    """Min-max within a client: null with fewer than 2 values, 0.5 for all rows (null ones too) if they are flat."""
    w = Window.partitionBy(*by)
    v = F.col(value)
    low, high, n = F.min(v).over(w), F.max(v).over(w), F.count(v).over(w)
    return F.when(n >= 2, F.when(high - low < FLAT, F.lit(0.5)).otherwise((v - low) / (high - low)))


def with_norms(wide: DataFrame, by: list[str], columns: tuple[str, ...] = exprs.SKIN_COLUMNS) -> DataFrame:
    """The rows with ``<column>_norm``, min-max scaled within by, of each column there is."""
    return wide.withColumns({f"{c}_norm": personal_minmax(wide, by, c) for c in columns if c in wide.columns})


def global_terciles(long: DataFrame, client: list[str], by: list[str], least: int = 10) -> DataFrame:
    """by, p33, p67: exact interpolated quantiles of the clients' min-max values; clients with fewer than 2 values are left out, keys with fewer than least values have none.

    Neither a client's nor a variable's values meet in a task: ends are
    aggregated and joined, quantiles found by distributed selection.
    """
    known = long.filter(F.col("value").isNotNull()).select(*client, *by, "value")
    ends = known.groupBy(*client, *by).agg(F.min("value").alias("_low"), F.max("value").alias("_high"), F.count("*").alias("_n")).filter("_n >= 2")
    both = joined(known, ends, [*client, *by])
    width = F.col("_high") - F.col("_low")
    units = both.select(*by, F.when(width < FLAT, F.lit(0.5)).otherwise((F.col("value") - F.col("_low")) / width).alias("unit"))
    cut = quantiles(units, by, "unit", (0.33, 0.67))
    return cut.filter(F.col("n") >= least).select(*by, F.col("p")[0].alias("p33"), F.col("p")[1].alias("p67"))


def subject_terciles(long: DataFrame, by: list[str]) -> DataFrame:
    """by, low, p33, p67, high: terciles of raw values of keys with 3 values or more; the upper end is beyond the largest by 0.001."""
    known = long.filter(F.col("value").isNotNull())
    ends = known.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    cut = quantiles(known, by, "value", (0.33, 0.67)).filter("n >= 3")
    return joined(cut, ends, by).select(*by, "low", F.col("p")[0].alias("p33"), F.col("p")[1].alias("p67"), (F.col("high") + 0.001).alias("high"))


def tercile_cuts(p33: Column, p67: Column) -> dict:
    return {"low": (F.lit(0.0), p33), "medium": (p33, p67), "high": (p67, F.lit(1.001))}


def runs(rows: DataFrame, by: list[str], label: str, time: str, ties: list[str], closing: float = CLOSING) -> DataFrame:
    """by, label, start_time, end_time: runs of equal labels; a null label closes a run.

    A run ends where the next (or a null) begins, the last one ``closing`` after
    the last row of its key. Rows of equal time are ordered by ties. Runs
    without length are dropped. Two window passes over one sort order.
    """
    w = Window.partitionBy(*by).orderBy(time, *ties)
    whole = Window.partitionBy(*by)
    marked = rows.withColumn("_first", (F.row_number().over(w) == 1) | ~F.col(label).eqNullSafe(F.lag(label).over(w))).withColumn("_last", F.max(time).over(whole))
    starts = marked.filter("_first").withColumn("_end", F.coalesce(F.lead(time).over(w), F.col("_last") + F.lit(closing)))
    return starts.filter(F.col(label).isNotNull() & (F.col(time) < F.col("_end"))).select(*by, label, F.col(time).alias("start_time"), F.col("_end").alias("end_time"))


def state_intervals(wide: DataFrame, thresholds: DataFrame | None, scale: tuple[float, float] | None = None, client: str = "client_id", time: str = "seconds", ties: list[str] | None = None, physio: tuple[str, ...] = exprs.PHYSIO_VARIABLES) -> DataFrame:
    """client, state, start_time, end_time of one feature table.

    Arousal and valence are rescaled and cut at fixed levels; physiological
    variables with thresholds (var, p33, p67) are min-max scaled within the
    client (a column ``<var>_norm`` is taken as it is) and cut at these; others
    at the client's own terciles.
    """
    ties = ties or []
    parts, keys = [], [client, time, *ties]
    rated = [v for v in ("arousal", "valence") if v in wide.columns]
    if rated and scale:
        long = to_long(wide, keys, rated)
        parts.append(long.select(*keys, "var", exprs.level_cut(exprs.rescale(F.col("value"), *scale)).alias("level")))
    have = [v for v in physio if v in wide.columns]
    if have:
        ready = {v: f"{v}_norm" for v in have if f"{v}_norm" in wide.columns}
        raw = to_long(wide, keys, have)
        if ready:
            given = to_long(wide.select(*keys, *[F.col(c).alias(v) for v, c in ready.items()]), keys, list(ready)).withColumnRenamed("value", "given")
            raw = raw.join(given, [*keys, "var"], "left")
        unit = F.when(F.col("var").isin(*ready), F.col("given")).otherwise(personal_minmax(raw, [client, "var"])) if ready else personal_minmax(raw, [client, "var"])
        scaled = raw.withColumn("unit", unit)
        names = F.create_map(*[F.lit(x) for v in have for x in (v, exprs.STATE_NAMES.get(v, v))])
        own = subject_terciles(raw, [client, "var"])
        cut = scaled.join(small(thresholds.select("var", "p33", "p67")), "var", "left") if thresholds is not None else scaled.withColumn("p33", F.lit(None).cast("double")).withColumn("p67", F.lit(None).cast("double"))
        cut = cut.join(own.select(client, "var", *[F.col(c).alias(f"own_{c}") for c in ("low", "p33", "p67", "high")]), [client, "var"], "left")
        by_all = exprs.level_cut(F.col("unit"), tercile_cuts(F.col("p33"), F.col("p67")))
        by_own = exprs.level_cut(F.col("value"), {"low": (F.col("own_low"), F.col("own_p33")), "medium": (F.col("own_p33"), F.col("own_p67")), "high": (F.col("own_p67"), F.col("own_high"))})
        parts.append(cut.select(*keys, F.element_at(names, F.col("var")).alias("var"), F.when(F.col("p33").isNotNull(), by_all).otherwise(by_own).alias("level")))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    found = runs(rows, [client, "var"], "level", time, ties)
    return found.select(client, F.concat_ws("_", "var", "level").alias("state"), "start_time", "end_time").distinct()


def emotion_intervals(rows: DataFrame, arousal_scale: tuple[float, float], valence_scale: tuple[float, float], client: str = "client_id", time: str = "seconds", ties: list[str] | None = None) -> DataFrame:
    """Runs of one of nine emotion labels, as states ``emo_<label>``; a null rating closes a run."""
    a = exprs.level_cut_simple(exprs.rescale(exprs.known(F.col("arousal")), *arousal_scale))
    v = exprs.level_cut_simple(exprs.rescale(exprs.known(F.col("valence")), *valence_scale))
    labelled = rows.select(client, time, *(ties or []), F.concat(F.lit("emo_"), exprs.emotion_label(a, v)).alias("state"))
    return runs(labelled, [client], "state", time, ties or [])


def frame_runs(frames: DataFrame, by: list[str], columns: list[str], frame: str = "FrameMillis", ties: list[str] | None = None) -> DataFrame:
    """by, columns, StartTime, EndTime: runs of frames equal in all columns; a run ends with its last frame, and rows with a null never merge."""
    w = Window.partitionBy(*by).orderBy(frame, *(ties or []))
    same = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) == F.lag(c).over(w), F.lit(False)) for c in columns])
    numbered = frames.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    firsts = [F.min_by(F.col(c), F.struct(frame, *(ties or []))).alias(c) for c in columns]
    return numbered.groupBy(*by, "_run").agg(*firsts, F.min(frame).alias("StartTime"), F.max(frame).alias("EndTime")).drop("_run")


def reduction(frames: DataFrame, runs_: DataFrame, by: list[str]) -> DataFrame:
    """by, n_frames, n_intervals, reduction_pct."""
    a, b = frames.groupBy(*by).agg(F.count("*").alias("n_frames")), runs_.groupBy(*by).agg(F.count("*").alias("n_intervals"))
    return a.join(b, by, "left").fillna(0, ["n_intervals"]).withColumn("reduction_pct", (1 - F.col("n_intervals") / F.col("n_frames")) * 100)


# --- validation and statistics -------------------------------------------------------------------


def validate(intervals: DataFrame) -> DataFrame:
    """One row: rows, clients, states, rows of no length, rows beyond the first of equal ones, negative times, valid."""
    flags = intervals.agg(F.count("*").alias("n_rows"), F.countDistinct("client_id").alias("n_clients"), F.countDistinct("state").alias("n_states"), F.count_if(F.col("start_time") >= F.col("end_time")).alias("n_empty"), F.count_if((F.col("start_time") < 0) | (F.col("end_time") < 0)).alias("n_negative"))
    again = intervals.groupBy("client_id", "state", "start_time", "end_time").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))
    return flags.crossJoin(F.broadcast(again)).withColumn("valid", (F.col("n_empty") == 0) & (F.col("n_negative") == 0) & (F.col("n_duplicates") == 0))


def duration_stats(intervals: DataFrame, by: str = "state") -> DataFrame:
    d = F.col("end_time") - F.col("start_time")
    return intervals.groupBy(by).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"))


def length_stats(intervals: DataFrame) -> DataFrame:
    """One row: mean, std, min, max of intervals a client."""
    n = intervals.groupBy("client_id").agg(F.count("*").alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"))


def summary(intervals: DataFrame) -> DataFrame:
    """metric, value: totals, distinct clients and states, mean duration."""
    one = intervals.agg(F.count("*").cast("double").alias("total_intervals"), F.countDistinct("client_id").cast("double").alias("clients"), F.countDistinct("state").cast("double").alias("states"), F.avg(F.col("end_time") - F.col("start_time")).alias("mean_duration"))
    return one.unpivot([], list(one.columns), "metric", "value")


def positions(intervals: DataFrame, by: list[str]) -> DataFrame:
    """The intervals with pos: their place in the client's sequence by start, end and state, from 0."""
    return intervals.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("start_time", "end_time", "state")) - 1)


def relation_counts(intervals: DataFrame, checked: bool = False, first: int | None = None, by: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """by, relation, n over all pairs of a client's sequence, or its first pairs in row order.

    All pairs are counted without being made (``relations``); checked names them
    as the validator does, for intervals that have a length. The first pairs are
    few and are made.
    """
    if first is None:
        found = relations.relation_counts(intervals, by)
        words = F.create_map(*[F.lit(x) for pair in exprs.RELATIONS.items() for x in pair])
        return found.withColumn("relation", F.element_at(words, F.col("relation"))) if checked else found
    p = positions(intervals, list(by))
    a = p.select(*by, *[F.col(c).alias(f"a_{c}") for c in ("pos", "start_time", "end_time")])
    b = p.select(*by, *[F.col(c).alias(f"b_{c}") for c in ("pos", "start_time", "end_time")])
    kind = (exprs.interval_relation_checked if checked else exprs.interval_relation)(F.col("a_start_time"), F.col("a_end_time"), F.col("b_start_time"), F.col("b_end_time"))
    # Pair (i, j) is number i * n - i * (i + 1) / 2 + j - i - 1: no ranking of all pairs is needed.
    n = p.groupBy(*by).agg(F.count("*").alias("n"))
    near = b.filter(F.col("b_pos") <= 2 * first)  # one row gives first pairs, unless the sequence is shorter
    pairs = a.filter(F.col("a_pos") < first).join(near, list(by)).filter("a_pos < b_pos").join(n, list(by)).filter(F.expr(f"a_pos * n - a_pos * (a_pos + 1) div 2 + b_pos - a_pos - 1 < {first}"))
    return pairs.groupBy(*by, kind.alias("relation")).agg(F.count("*").alias("n"))
