"""Named queries of the temporal engine with their SQL counterparts.

Doubles are rounded to 6 digits on both sides, arrays flattened to text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.functions import exprs
from chronosift.operators import compare, graph, groups, kernels, miner, windows
from chronosift.operators import intervals as iv
from chronosift.operators import rules as rule_ops
from chronosift.operators.miner import GROUP, MiningParams
from chronosift.plans import experiments
from chronosift.plans.stand_ins import (
    CLOSING,
    EVENTS_SQL,
    FAST,
    INTERVALS_SQL,
    LEVELS_SQL,
    MAXGAP,
    PEOPLE_SQL,
    SLOW,
    TRIPLES_SQL,
    events,
    people,
    runs_sql,
    state_intervals,
    table,
    triples,
)
from chronosift.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


# --- expressions ---------------------------------------------------------------------------------


@query("rescale", f"WITH {EVENTS_SQL} SELECT event_id, round((value - 0.5) / 9.0, 6) AS unit FROM ev")
def _rescale(spark, d):
    return events(spark, d).select("event_id", r6(exprs.rescale(F.col("value"), 0.5, 9.5), "unit"))


@query(
    "level_cut",
    f"""WITH {EVENTS_SQL} SELECT event_id, CASE WHEN u >= 0 AND u < 0.33 THEN 'low' WHEN u >= 0.33 AND u < 0.66 THEN 'medium' WHEN (u >= 0.66 AND u < 1.0) OR u >= CAST(1.0 AS DOUBLE) - CAST(0.001 AS DOUBLE) THEN 'high' END AS level,
  CASE WHEN u < 0.33 THEN 'low' WHEN u < 0.66 THEN 'medium' WHEN u IS NOT NULL THEN 'high' END AS simple FROM (SELECT event_id, k / 100 - 0.05 AS u FROM ev)""",
)
def _level_cut(spark, d):
    u = F.col("k") / 100 - F.lit(0.05)
    return events(spark, d).select("event_id", exprs.level_cut(u).alias("level"), exprs.level_cut_simple(u).alias("simple"))


_GRID_SQL = "CASE a || '|' || v " + " ".join(f"WHEN '{a}|{v}' THEN '{name}'" for (a, v), name in exprs.EMOTION_GRID.items()) + " END"
_SIMPLE_SQL = "CASE WHEN {0} < 0.33 THEN 'low' WHEN {0} < 0.66 THEN 'medium' WHEN {0} IS NOT NULL THEN 'high' END"


@query("emotion_grid", f"WITH l AS (SELECT p_partkey, {_SIMPLE_SQL.format('p_size / 50.0')} AS a, {_SIMPLE_SQL.format('p_retailprice / 2000.0')} AS v FROM part) SELECT p_partkey, {_GRID_SQL} AS label FROM l")
def _emotion_grid(spark, d):
    level = exprs.level_cut_simple
    return table(spark, d, "part").select("p_partkey", exprs.emotion_label(level(F.col("p_size") / 50.0), level(F.col("p_retailprice") / 2000.0)).alias("label"))


@query(
    "circumplex",
    """WITH x AS (SELECT l_orderkey, l_linenumber, 1.0 * l_quantity + 0.2 * (l_tax * 100) - 1.0 * (l_discount * 100) AS v, 0.5 * l_quantity + 1.0 * (l_tax * 100) - 1.0 * (l_discount * 100) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, (a + 100) / 200)), 6) AS arousal, round(greatest(0.0, least(1.0, (v + 100) / 200)), 6) AS valence FROM x""",
)
def _circumplex(spark, d):
    a, v = exprs.circumplex({"Happy": F.col("l_quantity"), "Surprised": F.col("l_tax") * 100, "Sad": F.col("l_discount") * 100})
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(a, "arousal"), r6(v, "valence"))


@query("calibrate", f"WITH {EVENTS_SQL} SELECT event_id, round((value - 2.8) / 50 * 1000, 6) AS ecg, round(24.0 * value - 49.2, 6) + 0.0 AS gsr, round(21.341 * value - 32.085, 6) AS skt, round((value - 2) / 4000 * 1e6, 6) + 0.0 AS emg, round(0.5 + 9 * (value + 26225) / 52450, 6) AS joystick FROM ev")
def _calibrate(spark, d):
    return events(spark, d).select("event_id", *[r6(exprs.calibrate(k, F.col("value")), k) for k in ("ecg", "gsr", "skt", "emg", "joystick")])


@query("demographics", f"WITH {PEOPLE_SQL} SELECT client_id, gender, age, age_group, binary_age_group FROM people")
def _demographics(spark, d):
    return people(spark, d).drop("segment")


# --- thresholds and intervals --------------------------------------------------------------------


@query("personal_minmax", f"WITH {LEVELS_SQL} SELECT event_id, round(unit, 6) AS unit FROM nm")
def _personal_minmax(spark, d):
    e = events(spark, d)
    return e.select("event_id", r6(iv.personal_minmax(e, ["client_id", "var"]), "unit"))


@query("global_terciles", f"WITH {LEVELS_SQL} SELECT var, round(p33, 6) AS p33, round(p67, 6) AS p67 FROM tc")
def _global_terciles(spark, d):
    return iv.global_terciles(events(spark, d), ["client_id"], ["var"]).select("var", r6("p33"), r6("p67"))


@query("dataset_terciles", f"WITH {LEVELS_SQL} SELECT user_id % 4 AS ds, var, round(quantile_cont(unit, 0.33), 6) AS p33, round(quantile_cont(unit, 0.67), 6) AS p67 FROM nm WHERE unit IS NOT NULL AND value IS NOT NULL GROUP BY ALL HAVING count(*) >= 10")
def _dataset_terciles(spark, d):
    e = events(spark, d).withColumn("ds", F.col("user_id") % 4)
    return iv.global_terciles(e, ["client_id"], ["ds", "var"]).select("ds", "var", r6("p33"), r6("p67"))


@query("subject_terciles", f"WITH {EVENTS_SQL} SELECT client_id, var, round(min(value), 6) AS low, round(quantile_cont(value, 0.33), 6) AS p33, round(quantile_cont(value, 0.67), 6) AS p67, round(max(value) + 0.001, 6) AS high FROM ev WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 3")
def _subject_terciles(spark, d):
    return iv.subject_terciles(events(spark, d), ["client_id", "var"]).select("client_id", "var", *map(r6, ("low", "p33", "p67", "high")))


@query("state_intervals", f"WITH {INTERVALS_SQL} SELECT client_id, dataset, state, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM iv")
def _state_intervals(spark, d):
    return state_intervals(spark, d).select("client_id", "dataset", "state", r6("start_time"), r6("end_time"))


_LABELS_SQL = f"""WITH {EVENTS_SQL}, lb AS (SELECT client_id, seconds, event_id, 'emo_' || {_GRID_SQL} AS state FROM (SELECT *, {_SIMPLE_SQL.format("((k - 0.0) / 100.0)")} AS a, {_SIMPLE_SQL.format("((value - 0.0) / 100.0)")} AS v FROM ev)), {runs_sql("lb", "client_id", "state", "seconds", "event_id", CLOSING)}
SELECT client_id, state, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM rn"""


@query("label_intervals", _LABELS_SQL)
def _label_intervals(spark, d):
    rows = events(spark, d).withColumnsRenamed({"k": "arousal", "value": "valence"})
    level = exprs.level_cut_simple
    label = exprs.emotion_label(level(exprs.rescale(exprs.known(F.col("arousal")), 0, 100)), level(exprs.rescale(exprs.known(F.col("valence")), 0, 100)))
    labelled = rows.select("client_id", "seconds", "event_id", F.concat(F.lit("emo_"), label).alias("state"))
    return iv.runs(labelled, ["client_id"], "state", "seconds", ["event_id"], CLOSING).select("client_id", "state", r6("start_time"), r6("end_time"))


@query(
    "frame_runs",
    f"""WITH {EVENTS_SQL}, f AS (SELECT client_id, seconds, event_id, var, CASE WHEN k >= 20 THEN k >= 60 END AS hot FROM ev),
m AS (SELECT *, CASE WHEN coalesce(var = lag(var) OVER w AND hot = lag(hot) OVER w, false) THEN 0 ELSE 1 END AS n FROM f WINDOW w AS (PARTITION BY client_id ORDER BY seconds, event_id)),
r AS (SELECT *, sum(n) OVER (PARTITION BY client_id ORDER BY seconds, event_id) AS run FROM m)
SELECT client_id, min_by(var, event_id) AS var, round(min(seconds), 6) AS start_s, round(max(seconds), 6) AS end_s FROM r GROUP BY client_id, run""",
)
def _frame_runs(spark, d):
    f = events(spark, d).select("client_id", "seconds", "event_id", "var", F.when(F.col("k") >= 20, F.col("k") >= 60).alias("hot"))
    return iv.frame_runs(f, ["client_id"], ["var", "hot"], "seconds", ["event_id"]).select("client_id", "var", r6("StartTime", "start_s"), r6("EndTime", "end_s"))


@query(
    "interval_validate",
    f"""WITH {INTERVALS_SQL}, z AS (SELECT client_id, state, start_time - 3600 AS start_time, end_time - 7200 AS end_time FROM iv UNION ALL SELECT client_id, state, start_time - 3600, end_time - 7200 FROM iv WHERE user_id % 5 = 0),
d AS (SELECT count(*) - count(DISTINCT (client_id, state, start_time, end_time)) AS n FROM z)
SELECT count(*) AS n_rows, count(DISTINCT client_id) AS n_clients, count(DISTINCT state) AS n_states, count(*) FILTER (start_time >= end_time) AS n_empty, count(*) FILTER (start_time < 0 OR end_time < 0) AS n_negative, (SELECT n FROM d) AS n_duplicates FROM z""",
)
def _interval_validate(spark, d):
    i = state_intervals(spark, d)
    shifted = lambda x: x.select("client_id", "state", (F.col("start_time") - 3600).alias("start_time"), (F.col("end_time") - 7200).alias("end_time"))
    return iv.validate(shifted(i).unionByName(shifted(i.filter("user_id % 5 = 0")))).drop("valid")


@query("interval_stats", f"WITH {INTERVALS_SQL} SELECT state, count(*) AS n, round(avg(end_time - start_time), 4) AS mean, round(stddev_samp(end_time - start_time), 4) AS std, round(min(end_time - start_time), 4) AS min, round(max(end_time - start_time), 4) AS max FROM iv GROUP BY state")
def _interval_stats(spark, d):
    return iv.duration_stats(state_intervals(spark, d)).select("state", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")])


@query(
    "interval_summary",
    f"""WITH {INTERVALS_SQL} SELECT unnest(['total_intervals', 'clients', 'states', 'mean_duration']) AS metric, unnest([CAST(n AS DOUBLE), CAST(c AS DOUBLE), CAST(s AS DOUBLE), round(m, 4)]) AS value
FROM (SELECT count(*) AS n, count(DISTINCT client_id) AS c, count(DISTINCT state) AS s, avg(end_time - start_time) AS m FROM iv)""",
)
def _interval_summary(spark, d):
    return iv.summary(state_intervals(spark, d)).select("metric", F.round("value", 4).alias("value"))


def _relation_sql(s1: str, e1: str, s2: str, e2: str) -> str:
    """For intervals in order of start and end."""
    return f"CASE WHEN {s1} < {s2} THEN CASE WHEN {e1} < {s2} THEN 'b' WHEN {e1} = {s2} THEN 'm' WHEN {e1} < {e2} THEN 'o' WHEN {e1} = {e2} THEN 'fi' ELSE 'c' END WHEN {e1} = {e2} THEN '=' WHEN {e1} < {e2} THEN 's' ELSE 'fi' END"


_POS_SQL = f"{INTERVALS_SQL}, ps AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY start_time, end_time, state) - 1 AS pos FROM iv)"


@query("relation_counts", f"WITH {_POS_SQL} SELECT a.client_id, {_relation_sql('a.start_time', 'a.end_time', 'b.start_time', 'b.end_time')} AS relation, count(*) AS n FROM ps a JOIN ps b ON a.client_id = b.client_id AND a.pos < b.pos GROUP BY ALL")
def _relation_counts(spark, d):
    return iv.relation_counts(state_intervals(spark, d))


@query(
    "relation_sample",
    f"""WITH {_POS_SQL}, pr AS (SELECT a.client_id, a.start_time AS s1, a.end_time AS e1, b.start_time AS s2, b.end_time AS e2, row_number() OVER (PARTITION BY a.client_id ORDER BY a.pos, b.pos) AS no FROM ps a JOIN ps b ON a.client_id = b.client_id AND a.pos < b.pos)
SELECT client_id, CASE WHEN e1 < s2 THEN 'before' WHEN e1 = s2 THEN 'meets' WHEN s1 < s2 AND e1 > s2 AND e1 < e2 THEN 'overlaps' WHEN s1 = s2 AND e1 = e2 THEN 'equals' WHEN s1 = s2 AND e1 < e2 THEN 'starts' WHEN s1 < s2 AND e1 = e2 THEN 'is-finished-by' WHEN s1 < s2 AND e1 > e2 THEN 'contains' ELSE 'other' END AS relation, count(*) AS n FROM pr WHERE no <= 100 GROUP BY ALL""",
)
def _relation_sample(spark, d):
    return iv.relation_counts(state_intervals(spark, d), checked=True, first=100)


# --- windows -------------------------------------------------------------------------------------

_WINDOW_SQL = "SELECT client_id, var, (w + 1) * CAST({0} AS DOUBLE) AS seconds, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END, 6) AS std, round(max(value), 6) AS max FROM (SELECT *, CAST(floor(seconds / CAST({0} AS DOUBLE)) AS BIGINT) AS w FROM ev) GROUP BY client_id, var, w"


def _window_query(width):
    return lambda spark, d: windows.window_stats(events(spark, d), ["client_id", "var"], width, "seconds").select("client_id", "var", "seconds", "n", r6("mean"), r6("std"), r6("max"))


query("window_features_fast", f"WITH {EVENTS_SQL} " + _WINDOW_SQL.format(FAST))(_window_query(FAST))
query("window_features_slow", f"WITH {EVENTS_SQL} " + _WINDOW_SQL.format(SLOW))(_window_query(SLOW))


@query("temp_slope", f"WITH {EVENTS_SQL} SELECT client_id, (w + 1) * CAST({SLOW} AS DOUBLE) AS seconds, round(avg(value), 6) AS temp_mean, round(coalesce(CASE WHEN count(*) > 1 AND max(seconds) > min(seconds) THEN regr_slope(value, seconds) END, 0), 6) AS temp_slope FROM (SELECT *, CAST(floor(seconds / CAST({SLOW} AS DOUBLE)) AS BIGINT) AS w FROM ev) GROUP BY client_id, w")
def _temp_slope(spark, d):
    return windows.temperature_features(events(spark, d), ["client_id"], SLOW, "seconds").select("client_id", "seconds", r6("temp_mean"), r6("temp_slope"))


@query("acc_magnitude", "SELECT l_suppkey, (w + 1) * CAST(10 AS DOUBLE) AS seconds, round(avg(x), 6) AS acc_x_mean, round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(x) END, 6) AS acc_x_std, round(avg(m), 6) AS acc_magnitude_mean FROM (SELECT l_suppkey, l_discount AS x, sqrt(l_discount * l_discount + l_tax * l_tax + l_linenumber * l_linenumber) AS m, CAST(floor(l_quantity / 10) AS BIGINT) AS w FROM lineitem) GROUP BY l_suppkey, w")
def _acc_magnitude(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("ts"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.col("l_linenumber").cast("double").alias("z"))
    return windows.acceleration_features(rows, ["l_suppkey"], 10).select("l_suppkey", "seconds", r6("acc_x_mean"), r6("acc_x_std"), r6("acc_magnitude_mean"))


def _beats(spark, d):
    """Inter-event gaps of a user in place of inter-beat intervals, in 320..1919 ms."""
    return events(spark, d).select("client_id", (F.col("event_id") * 1.0).alias("ts"), (F.lit(290) + F.col("event_id") * 7919 % 1730).cast("double").alias("ibi"))


_BEATS_SQL = "bt AS (SELECT CAST(user_id AS VARCHAR) AS client_id, event_id * 1.0 AS ts, CAST(290 + event_id * 7919 % 1730 AS DOUBLE) AS ibi FROM events)"


@query(
    "hrv_time_domain",
    f"""WITH {_BEATS_SQL}, g AS (SELECT *, ibi - lag(ibi) OVER (PARTITION BY client_id ORDER BY ts) AS d, median(ibi) OVER (PARTITION BY client_id) AS med FROM bt WHERE ibi > 300 AND ibi < 2000)
SELECT client_id, count(*) AS n, round(avg(ibi), 4) AS hrv_mean_nn, round(stddev_samp(ibi), 4) AS hrv_sdnn, round(sqrt(avg(d * d)), 4) AS hrv_rmssd, round(stddev_samp(d), 4) AS hrv_sdsd, round(quantile_cont(ibi, 0.75) - quantile_cont(ibi, 0.25), 4) AS hrv_iqrnn, round(median(abs(ibi - med)) * 1.4826, 4) AS hrv_mad_nn, round(count(*) FILTER (abs(d) > 50) * 100.0 / count(d), 4) AS hrv_pnn50 FROM g GROUP BY client_id HAVING count(*) >= 3""",
)
def _hrv(spark, d):
    return windows.hrv_time_domain(_beats(spark, d), ["client_id"]).select("client_id", "n", *[F.round(c, 4).alias(c) for c in ("hrv_mean_nn", "hrv_sdnn", "hrv_rmssd", "hrv_sdsd", "hrv_iqrnn", "hrv_mad_nn", "hrv_pnn50")])


@query(
    "hr_interpolate",
    f"""WITH b AS (SELECT client_id, ts / 7 AS t, avg(60000.0 / ibi) AS hr FROM (SELECT client_id, CAST(ts AS DOUBLE) AS ts, ibi FROM ({_BEATS_SQL.removeprefix("bt AS (").removesuffix(")")})) WHERE ibi > 300 AND ibi < 2000 GROUP BY ALL),
s AS (SELECT client_id, t AS t0, hr AS h0, lead(t) OVER w AS t1, lead(hr) OVER w AS h1 FROM b WINDOW w AS (PARTITION BY client_id ORDER BY t)),
g AS (SELECT *, unnest(range(CAST(ceil(t0) AS BIGINT), CAST(CASE WHEN t1 IS NULL THEN floor(t0) + 1 ELSE ceil(t1) END AS BIGINT))) AS k FROM s)
SELECT client_id, CAST(k AS DOUBLE) AS ts, round(CASE WHEN t1 IS NULL THEN h0 ELSE h0 + (h1 - h0) * (k - t0) / (t1 - t0) END, 6) AS hr FROM g""",
)
def _hr_interpolate(spark, d):
    return windows.heart_rate_grid(_beats(spark, d).withColumn("ts", F.col("ts") / 7), ["client_id"]).select("client_id", "ts", r6("hr"))


@query(
    "one_hertz_windows",
    """WITH x AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_tax) AS sec, l_quantity, l_discount, l_tax FROM lineitem)
SELECT l_suppkey, CAST((sec - 1) // 5 * 5 + 5 AS DOUBLE) AS seconds, round(avg(l_quantity), 6) AS eda_mean, round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(l_quantity) END, 6) AS eda_std, round(avg(l_tax), 6) AS hr_mean, round(greatest(0.0, least(1.0, (0.5 * avg(l_quantity) + 100) / 200)), 6) AS arousal FROM x GROUP BY l_suppkey, (sec - 1) // 5""",
)
def _one_hertz(spark, d):
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax"))
    rows = table(spark, d, "lineitem").select("l_suppkey", place.alias("sec"), F.col("l_quantity").alias("EDA"), F.col("l_discount").alias("TEMP"), F.col("l_tax").alias("HR"), F.col("l_quantity").alias("Happy"))
    return windows.one_hertz_features(rows, ["l_suppkey"]).select("l_suppkey", "seconds", r6("eda_mean"), r6("eda_std"), r6("hr_mean"), r6("arousal"))


@query("range_join", f"WITH {INTERVALS_SQL} SELECT e.event_id, i.state, round(i.start_time, 6) AS start_time FROM ev e JOIN iv i ON e.client_id = i.client_id AND e.seconds >= i.start_time AND e.seconds < i.end_time")
def _range_join(spark, d):
    spans = state_intervals(spark, d).select("client_id", "state", F.col("start_time").alias("start"), F.col("end_time").alias("end"))
    return windows.range_join(events(spark, d), spans, ["client_id"], 43200.0, "seconds").select("event_id", "state", r6("start", "start_time"))


@query(
    "nearest_event",
    f"""WITH {EVENTS_SQL}, a AS (SELECT * FROM ev), b AS (SELECT client_id, seconds, value FROM ev WHERE var = (SELECT max(var) FROM ev)),
c AS (SELECT a.event_id, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.seconds - b.seconds), b.seconds, b.value) AS no FROM a JOIN b ON a.client_id = b.client_id)
SELECT a.event_id, round(c.value, 6) AS nearest FROM a LEFT JOIN c ON a.event_id = c.event_id AND c.no = 1""",
)
def _nearest(spark, d):
    e = events(spark, d)
    last = e.agg(F.max("var").alias("last"))  # one row: the type whose samples are the references of all events
    left, right = e.select("client_id", "seconds", "event_id"), e.join(F.broadcast(last), F.col("var") == F.col("last")).select("client_id", F.col("seconds").alias("at"), F.col("value").alias("nearest"))
    return windows.nearest(left, right, ["client_id"], "seconds", "at", "nearest").select("event_id", r6("nearest"))


@query(
    "series_outer_merge",
    f"WITH {EVENTS_SQL}, h AS (SELECT client_id, CAST(floor(seconds / 3600) AS BIGINT) AS hour, var, min(value) AS value FROM ev GROUP BY ALL) SELECT client_id, hour, count(value) AS n_series, round(sum(value), 4) AS total FROM h GROUP BY client_id, hour",
)
def _series_outer_merge(spark, d):
    """A row for each client and hour with a column for each event type; of these the number known, and the sum."""
    names = sorted(r[0] for r in table(spark, d, "events").select("event_type").distinct().collect())
    h = events(spark, d).select("client_id", F.floor(F.col("seconds") / 3600).alias("hour"), "var", "value")
    m = windows.outer_merge(h, ["client_id", "hour"], "var", "value", names)
    known = F.array_compact(F.array(*[F.col(f"`{n}`") for n in names]))
    return m.select("client_id", "hour", F.size(known).cast("long").alias("n_series"), F.round(F.aggregate(known, F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query(
    "series_outer_merge_all",
    f"WITH {EVENTS_SQL}, h AS (SELECT client_id, CAST(floor(seconds / 3600) AS BIGINT) AS hour, var, value FROM ev), k AS (SELECT DISTINCT client_id, hour FROM h), n AS (SELECT DISTINCT var FROM h), m AS (SELECT client_id, hour, var, min(value) AS value FROM h GROUP BY client_id, hour, var) SELECT k.client_id, k.hour, n.var, round(m.value, 6) AS value FROM k CROSS JOIN n LEFT JOIN m ON m.client_id = k.client_id AND m.hour = k.hour AND m.var = n.var",
)
def _series_outer_merge_all(spark, d):
    """series_outer_merge over all event types, in long form: a row for each client, hour and type, null where the merge has no value."""
    h = events(spark, d).select("client_id", F.floor(F.col("seconds") / 3600).alias("hour"), "var", "value")
    names = sorted(r[0] for r in h.select("var").distinct().collect())
    m = windows.outer_merge(h, ["client_id", "hour"], "var", "value", names)
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("var"), F.col(f"`{n}`").alias("value")) for n in names])).alias("s")
    return m.select("client_id", "hour", long).select("client_id", "hour", "s.var", r6("s.value", "value"))


@query(
    "positional_join",
    """WITH a AS (SELECT l_suppkey AS k, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_tax)) AS sec FROM lineitem),
b AS (SELECT o_custkey AS k, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sec FROM orders) SELECT k, sec, l_quantity, round(o_totalprice, 2) AS o_totalprice FROM a JOIN b USING (k, sec)""",
)
def _positional(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_quantity", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax").alias("oa"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice", F.col("o_orderkey").alias("ob"))
    return windows.positional_join(a, b, ["k"], "oa", "ob").select("k", F.col("sec").cast("long").alias("sec"), "l_quantity", F.round("o_totalprice", 2).alias("o_totalprice"))


# --- mining --------------------------------------------------------------------------------------

PARAMS = MiningParams(0.1, 0.3, MAXGAP, 3)
PAIRS = MiningParams(0.2, 0.4, MAXGAP, 2)


def _floor_sql(minsup: float) -> str:
    return f"floor(CAST({minsup} AS DOUBLE) * n)"


def mining_sql(params: MiningParams, source: str, group: str) -> str:
    """CTEs p1, p2, p3 (patterns of one, two, three states) of an interval table, by chained joins."""
    gap, least = f"<= {params.maxgap}" if params.maxgap >= 0 else "IS NOT NULL", _floor_sql(params.minsup)
    rel = _relation_sql
    return f"""
sq AS (SELECT {group} AS grp, client_id, state, start_time, end_time, row_number() OVER (PARTITION BY {group}, client_id ORDER BY start_time, end_time, state) - 1 AS pos FROM {source}),
nc AS (SELECT grp, count(DISTINCT client_id) AS n FROM sq GROUP BY grp),
p1 AS (SELECT grp, state AS s1, count(DISTINCT client_id) AS c, any_value(n) AS n FROM sq JOIN nc USING (grp) GROUP BY grp, state HAVING count(DISTINCT client_id) >= floor(CAST({params.minsup} AS DOUBLE) * any_value(n))),
uq AS (SELECT sq.* FROM sq JOIN p1 ON sq.grp = p1.grp AND sq.state = p1.s1),
l1 AS (SELECT grp, client_id, state AS s1, min(pos) AS p, arg_min(start_time, pos) AS b1, arg_min(end_time, pos) AS e1 FROM uq GROUP BY ALL),
l2 AS (SELECT grp, client_id, s1, state AS s2, b1, e1, min(pos) AS p, arg_min(start_time, pos) AS b2, arg_min(end_time, pos) AS e2 FROM (SELECT l1.grp, l1.client_id, s1, b1, e1, pos, state, start_time, end_time FROM l1 JOIN uq ON l1.grp = uq.grp AND l1.client_id = uq.client_id AND uq.pos > l1.p AND uq.start_time - e1 {gap}) GROUP BY ALL),
k2 AS (SELECT grp, s1, s2, count(*) AS c, arg_min({rel("b1", "e1", "b2", "e2")}, client_id) AS r12 FROM l2 GROUP BY grp, s1, s2),
p2 AS (SELECT k2.*, n FROM k2 JOIN nc USING (grp) WHERE c >= {least}),
l3 AS (SELECT grp, client_id, s1, s2, state AS s3, b1, e1, b2, e2, min(pos) AS p, arg_min(start_time, pos) AS b3, arg_min(end_time, pos) AS e3 FROM (SELECT l2.grp, l2.client_id, l2.s1, l2.s2, b1, e1, b2, e2, pos, state, start_time, end_time FROM l2 JOIN p2 ON l2.grp = p2.grp AND l2.s1 = p2.s1 AND l2.s2 = p2.s2 JOIN uq ON l2.grp = uq.grp AND l2.client_id = uq.client_id AND uq.pos > l2.p AND uq.start_time - least(e1, e2) {gap}) GROUP BY ALL),
k3 AS (SELECT grp, s1, s2, s3, count(*) AS c, arg_min({rel("b1", "e1", "b2", "e2")}, client_id) AS r12, arg_min({rel("b1", "e1", "b3", "e3")}, client_id) AS r13, arg_min({rel("b2", "e2", "b3", "e3")}, client_id) AS r23 FROM l3 GROUP BY grp, s1, s2, s3),
p3 AS (SELECT k3.*, n FROM k3 JOIN nc USING (grp) WHERE c >= {least})"""


_WORD = lambda r: "CASE " + r + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in exprs.RELATIONS.items()) + " END"


def rules_sql(params: MiningParams) -> str:
    """CTE ru (grp, signature, confidence, lift, support, support_count, size) after mining_sql."""
    d2 = f"s1 || ' ' || {_WORD('r12')} || ' ' || s2"
    d3 = f"{d2} || ' AND ' || s1 || ' ' || {_WORD('r13')} || ' ' || s3 || ' AND ' || s2 || ' ' || {_WORD('r23')} || ' ' || s3"
    three = params.max_size > 2
    parts = [f"SELECT y.grp, '(' || y.s1 || ')' AS ante, {d2.replace('s1', 'y.s1', 1).replace('r12', 'y.r12').replace('|| s2', '|| y.s2')} AS cons, y.c, y.n, x.c AS cx, coalesce(z.c, 0) AS cz, 2 AS size FROM p2 y JOIN p1 x ON y.grp = x.grp AND y.s1 = x.s1 LEFT JOIN p1 z ON y.grp = z.grp AND y.s2 = z.s1"]
    if three:
        parts.append("SELECT y.grp, '(' || y.s1 || ')', y.d, y.c, y.n, x.c, coalesce(z.c, 0), 3 FROM d3 y JOIN p1 x ON y.grp = x.grp AND y.s1 = x.s1 LEFT JOIN p2 z ON y.grp = z.grp AND y.s2 = z.s1 AND y.s3 = z.s2 AND y.r23 = z.r12")
        parts.append("SELECT y.grp, x.d, y.d, y.c, y.n, x.c, coalesce(z.c, 0), 3 FROM d3 y JOIN d2 x ON y.grp = x.grp AND y.s1 = x.s1 AND y.s2 = x.s2 AND y.r12 = x.r12 LEFT JOIN p1 z ON y.grp = z.grp AND y.s3 = z.s1")
    return f"""d2 AS (SELECT *, {d2} AS d FROM p2), d3 AS (SELECT *, {d3} AS d FROM p3),
rw AS ({" UNION ALL ".join(parts)}),
ru AS (SELECT grp, ante, cons, ante || ' => ' || cons AS signature, (c / n) / (cx / n) AS confidence, CASE WHEN cz > 0 THEN (c / n) / ((cx / n) * (cz / n)) ELSE 0.0 END AS lift, c / n AS support, c AS support_count, size FROM rw WHERE (c / n) / (cx / n) >= {params.minconf})"""


_MINED = f"WITH {INTERVALS_SQL}, {mining_sql(PARAMS, 'iv', chr(39) + 'all' + chr(39))}"
_MINED_DS = f"WITH {INTERVALS_SQL}, {mining_sql(PAIRS, 'iv', 'dataset')}, {rules_sql(PAIRS)}"


def _patterns(spark, d, params=PARAMS, group=None):
    return miner.patterns(miner.sequences(state_intervals(spark, d), group), params)


def _rules(spark, d, params=PARAMS, group=None):
    return experiments.mined_rules(state_intervals(spark, d), group, params)


def _rules_by_ds(spark, d):
    return _rules(spark, d, PAIRS, "dataset").withColumnRenamed(GROUP, "ds")


def _pattern_rows(df, size):
    return df.filter(F.col("size") == size).select(F.array_join("states", ",").alias("states"), F.array_join("relations", ",").alias("relations"), "support_count", r6("support"))


@query("frequent_states", f"{_MINED} SELECT s1 AS states, '' AS relations, c AS support_count, round(c / n, 6) AS support FROM p1")
def _frequent_states(spark, d):
    return _pattern_rows(_patterns(spark, d, MiningParams(0.1, 0.3, MAXGAP, 1)), 1)


@query("patterns2", f"{_MINED} SELECT s1 || ',' || s2 AS states, r12 AS relations, c AS support_count, round(c / n, 6) AS support FROM p2")
def _patterns2(spark, d):
    return _pattern_rows(_patterns(spark, d, MiningParams(0.1, 0.3, MAXGAP, 2)), 2)


@query("patterns3", f"{_MINED} SELECT s1 || ',' || s2 || ',' || s3 AS states, r12 || ',' || r13 || ',' || r23 AS relations, c AS support_count, round(c / n, 6) AS support FROM p3")
def _patterns3(spark, d):
    return _pattern_rows(_patterns(spark, d), 3)


@query("patterns2_no_gap", f"WITH {INTERVALS_SQL}, {mining_sql(MiningParams(0.5, 0.5, -1.0, 2), 'iv', chr(39) + 'all' + chr(39))} SELECT s1 || ',' || s2 AS states, r12 AS relations, c AS support_count, round(c / n, 6) AS support FROM p2")
def _patterns2_no_gap(spark, d):
    return _pattern_rows(_patterns(spark, d, MiningParams(0.5, 0.5, -1.0, 2)), 2)


_RULE_COLUMNS = "signature, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(support, 6) AS support, support_count"


def _rule_rows(df):
    return df.select("signature", r6("confidence"), r6("lift"), r6("support"), "support_count")


@query("rules", f"{_MINED}, {rules_sql(PARAMS)} SELECT {_RULE_COLUMNS} FROM ru")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Events to state intervals to temporal patterns to rules."""
    return _rule_rows(_rules(spark, d))


@query("top_rules", f"{_MINED}, {rules_sql(PARAMS)} SELECT {_RULE_COLUMNS} FROM ru ORDER BY ru.confidence * ru.support DESC, signature LIMIT 1000")
def _top_rules(spark, d):
    return _rule_rows(rule_ops.top_rules(_rules(spark, d)))


@query("rules_by_dataset", f"{_MINED_DS} SELECT grp AS ds, {_RULE_COLUMNS} FROM ru")
def _rules_by_dataset(spark, d):
    r = _rules_by_ds(spark, d)
    return r.select("ds", "signature", r6("confidence"), r6("lift"), r6("support"), "support_count")


_SEQ_SQL = f"WITH sv AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS client_id, role AS state, CAST(turn AS DOUBLE) AS start_time, CAST(turn AS DOUBLE) AS end_time FROM conversations), {mining_sql(MiningParams(0.4, 0.6, -1.0, 3), 'sv', chr(39) + 'all' + chr(39))}"


def _turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("client_id"), F.col("role").alias("state"), "turn")


@query("seq_patterns", f"{_SEQ_SQL} SELECT s1 AS states, c AS support_count FROM p1 UNION ALL SELECT s1 || ',' || s2, c FROM p2 UNION ALL SELECT s1 || ',' || s2 || ',' || s3, c FROM p3")
def _seq_patterns(spark, d):
    found, _ = experiments.sequence_mining(_turns(spark, d), ["turn", "state"], max_size=3)
    return found.select(F.array_join("states", ",").alias("states"), "support_count")


@query(
    "seq_rules",
    f"""{_SEQ_SQL}, y AS (SELECT s1 AS ante, s1 || ' -> ' || s2 AS cons, p2.c / p2.n AS sup, p1.c / p1.n AS sx FROM p2 JOIN p1 USING (grp, s1)
UNION ALL SELECT s1, s1 || ' -> ' || s2 || ' -> ' || s3, p3.c / p3.n, p1.c / p1.n FROM p3 JOIN p1 USING (grp, s1) UNION ALL SELECT s1 || ' -> ' || s2, s1 || ' -> ' || s2 || ' -> ' || s3, p3.c / p3.n, p2.c / p2.n FROM p3 JOIN p2 USING (grp, s1, s2))
SELECT ante AS antecedent, cons AS consequent, round(greatest(0.0, least(1.0, sup / sx)), 6) AS confidence, round(greatest(0.0, least(1.0, sup)), 6) AS support FROM y WHERE greatest(0.0, least(1.0, sup / sx)) >= 0.6""",
)
def _seq_rules(spark, d):
    _, rules = experiments.sequence_mining(_turns(spark, d), ["turn", "state"], max_size=3)
    return rules.select("antecedent", "consequent", r6("confidence"), r6("support"))


# --- rules as text and sets ----------------------------------------------------------------------


@query(
    "rule_filters",
    """WITH x AS (SELECT unnest([['hr_low','hrv_sdnn_high'],['eda_low','eda_peaks_high'],['arousal_low','temp_high'],['valence_high','eda_low'],['emo_sad','bvp_std_low'],['hr_low','hr_high'],['eda_scr_amp_low','arousal_medium'],['steps_low']]) AS s, unnest(range(1, 9)) AS id)
SELECT p_partkey, id, len(list_filter(s, lambda v: NOT regexp_matches(v, '^(bvp_std|bvp_peak_to_peak|bvp_spectral_power|hrv_(sdnn|rmssd|pnn50|pnn20|cvnn|cvsd|lf_hf|lfn|hfn)|hr_)'))) = 0 AS heart_only, len(list_filter(s, lambda v: NOT starts_with(v, 'eda'))) = 0 AS skin_only,
len(list_filter(s, lambda v: regexp_matches(v, '^(arousal|valence|emo_)'))) = 0 OR len(list_filter(s, lambda v: starts_with(v, 'temp'))) > 0 AS not_cross, len(list_distinct(list_transform(s, lambda v: regexp_replace(v, '_(high|medium|low)$', '')))) = 1 AS single FROM part JOIN x ON id = p_partkey % 8 + 1""",
)
def _rule_filters(spark, d):
    sets = [["hr_low", "hrv_sdnn_high"], ["eda_low", "eda_peaks_high"], ["arousal_low", "temp_high"], ["valence_high", "eda_low"], ["emo_sad", "bvp_std_low"], ["hr_low", "hr_high"], ["eda_scr_amp_low", "arousal_medium"], ["steps_low"]]
    arr = F.array(*[F.array(*[F.lit(v) for v in s]) for s in sets])
    i = (F.col("p_partkey") % 8 + 1).cast("int")
    s = F.element_at(arr, i)
    return table(spark, d, "part").select("p_partkey", i.cast("long").alias("id"), exprs.heart_only(s).alias("heart_only"), exprs.skin_only(s).alias("skin_only"), exprs.not_cross(s).alias("not_cross"), exprs.single_feature(s).alias("single"))


@query("rule_size", f"{_MINED}, {rules_sql(PARAMS)} SELECT signature, CAST(2 + len(regexp_extract_all(signature, ' meets | contains ')) AS BIGINT) AS size_by_text, CAST(size AS BIGINT) AS size_by_states FROM ru")
def _rule_size(spark, d):
    return _rules(spark, d).select("signature", exprs.relation_count_size(F.col("signature")).cast("long").alias("size_by_text"), F.size("consequent_states").cast("long").alias("size_by_states"))


def _words_sql(col: str) -> str:
    out = col
    for state, words in exprs.STATE_WORDS.items():
        out = f"replace({out}, '{state}', '**{state}** ({words})')"
    for relation, words in exprs.RELATION_WORDS.items():
        out = f"replace({out}, '{relation}', '*{words}*')"
    return out


_PHRASE_SQL = "'(hr_' || CASE WHEN p_size % 3 = 0 THEN 'low' WHEN p_size % 3 = 1 THEN 'medium' ELSE 'high' END || ')'"


@query("rule_text", f"WITH x AS (SELECT p_partkey, {_PHRASE_SQL} AS a, 'hr_low ' || CASE WHEN p_size % 2 = 0 THEN 'before' ELSE 'is-finished-by' END || ' eda_scr_amp_high' AS c FROM part) SELECT p_partkey, 'If ' || {_words_sql('a')} || ', then ' || {_words_sql('c')} AS words FROM x")
def _rule_text(spark, d):
    size = F.col("p_size")
    a = F.concat(F.lit("(hr_"), F.when(size % 3 == 0, "low").when(size % 3 == 1, "medium").otherwise("high"), F.lit(")"))
    c = F.concat(F.lit("hr_low "), F.when(size % 2 == 0, "before").otherwise("is-finished-by"), F.lit(" eda_scr_amp_high"))
    return table(spark, d, "part").select("p_partkey", exprs.rule_words(exprs.rule_signature(a, c)).alias("words"))


_PRESENCE = f"{_MINED_DS}, pr AS (SELECT signature, list_sort(list(DISTINCT grp)) AS present, count(DISTINCT grp) AS k, avg(confidence) AS conf, min(confidence) AS min_conf FROM ru GROUP BY signature)"


@query("universal", f"{_PRESENCE} SELECT signature, round(conf, 4) AS avg_confidence, round(min_conf, 4) AS min_confidence FROM pr WHERE k = (SELECT count(DISTINCT grp) FROM ru)")
def _universal(spark, d):
    return compare.universal(experiments.cut(_rules_by_ds(spark, d))).select("signature", "avg_confidence", "min_confidence")


@query("unique_per_ds", f"{_PRESENCE} SELECT signature, present[1] AS ds FROM pr WHERE k = 1")
def _unique(spark, d):
    return compare.unique_to_one(_rules_by_ds(spark, d))


@query("leave_one_out", f"{_PRESENCE} SELECT signature, array_to_string(present, '+') AS present, list_filter((SELECT list_sort(list(DISTINCT grp)) FROM ru), lambda x: NOT list_contains(present, x))[1] AS missing FROM pr WHERE k = (SELECT count(DISTINCT grp) FROM ru) - 1")
def _leave_one_out(spark, d):
    return compare.all_but_one(experiments.cut(_rules_by_ds(spark, d))).select("signature", F.array_join("present", "+").alias("present"), "missing")


@query("majority", f"{_PRESENCE} SELECT signature, CAST(k AS BIGINT) AS n_present, round(conf, 4) AS avg_confidence FROM pr WHERE k >= 3")
def _majority(spark, d):
    return compare.at_least(_rules_by_ds(spark, d), 3).select("signature", F.col("n_present").cast("long").alias("n_present"), "avg_confidence")


@query("pairwise_common", f"{_MINED_DS}, u AS (SELECT DISTINCT grp, signature FROM ru) SELECT a.grp AS \"left\", b.grp AS \"right\", signature FROM u a JOIN u b USING (signature) WHERE a.grp < b.grp")
def _pairwise(spark, d):
    return compare.pairwise_common(_rules_by_ds(spark, d))


_SHARED = f"{_MINED_DS}, u AS (SELECT DISTINCT grp, signature FROM ru), g AS (SELECT DISTINCT grp FROM u), m AS (SELECT a.grp AS l, b.grp AS r, (SELECT count(*) FROM u x JOIN u y USING (signature) WHERE x.grp = a.grp AND y.grp = b.grp) AS n FROM g a, g b)"


@query("shared_matrix", f'{_SHARED} SELECT l AS "left", r AS "right", n FROM m')
def _shared(spark, d):
    return compare.shared_matrix(experiments.cut(_rules_by_ds(spark, d)))


@query("jaccard_matrix", f'{_SHARED} SELECT m.l AS "left", m.r AS "right", round(m.n / (a.n + b.n - m.n), 6) AS jaccard FROM m JOIN m a ON a.l = m.l AND a.r = m.l JOIN m b ON b.l = m.r AND b.r = m.r')
def _jaccard(spark, d):
    return compare.jaccard_matrix(experiments.cut(_rules_by_ds(spark, d))).select("left", "right", r6("jaccard"))


@query(
    "combo_matrix",
    f"""{_PRESENCE}, g AS (SELECT DISTINCT grp FROM ru), c AS (SELECT a.grp AS x, b.grp AS y, t.grp AS target FROM g a, g b, g t WHERE a.grp < b.grp)
SELECT x || '+' || y AS combo, target, CASE WHEN target <> x AND target <> y THEN (SELECT count(*) FROM pr WHERE list_contains(present, x) AND list_contains(present, y) AND list_contains(present, target)) END AS n FROM c""",
)
def _combo(spark, d):
    return compare.combination_matrix(experiments.cut(_rules_by_ds(spark, d)), 2)


@query("two_sides", f"{_MINED_DS}, p AS (SELECT signature, max(CASE WHEN grp = 'ds0' THEN 1 ELSE 0 END) AS a, max(CASE WHEN grp = 'ds1' THEN 1 ELSE 0 END) AS b FROM ru GROUP BY signature) SELECT count(*) FILTER (a + b > 0) AS n_union, count(*) FILTER (a = 1 AND b = 1) AS n_shared, count(*) FILTER (a = 1 AND b = 0) AS n_only_ds0, count(*) FILTER (a = 0 AND b = 1) AS n_only_ds1, round(count(*) FILTER (a = 1 AND b = 1) / count(*) FILTER (a + b > 0), 6) AS jaccard FROM p")
def _two_sides(spark, d):
    out = compare.two_sides(_rules_by_ds(spark, d), "ds", "ds0", "ds1")
    return out.withColumn("jaccard", F.round("jaccard", 6))


@query("confidence_shift", f"{_MINED_DS} SELECT a.signature, round(b.confidence - a.confidence, 6) AS delta FROM ru a JOIN ru b USING (signature) WHERE a.grp = 'ds0' AND b.grp = 'ds1'")
def _confidence_shift(spark, d):
    return compare.confidence_shift(experiments.cut(_rules_by_ds(spark, d)), "ds", "ds0", "ds1").select("signature", r6("delta"))


@query(
    "cross_validate",
    f"""{_MINED_DS}, g AS (SELECT DISTINCT grp AS held_out FROM ru), c AS (SELECT held_out, signature, count(*) FILTER (grp <> held_out) AS k, max(CASE WHEN grp = held_out THEN confidence END) AS own, avg(confidence) FILTER (grp <> held_out) AS others FROM g, ru GROUP BY held_out, signature),
t AS (SELECT held_out, count(*) AS n_common, count(own) AS n_validated, avg(own - others) AS diff FROM c WHERE k = (SELECT count(*) FROM g) - 1 GROUP BY held_out)
SELECT held_out, coalesce(n_common, 0) AS n_common, coalesce(n_validated, 0) AS n_validated, round(diff, 6) AS confidence_diff, round(CASE WHEN n_common > 0 THEN n_validated / n_common * 100 ELSE 0.0 END, 6) AS hit_rate FROM g LEFT JOIN t USING (held_out)""",
)
def _cross_validate(spark, d):
    out = compare.cross_validation(experiments.cut(_rules_by_ds(spark, d)))
    return out.select("held_out", "n_common", "n_validated", r6("confidence_diff"), r6("hit_rate"))


@query("size_stats", f"{_MINED}, {rules_sql(PARAMS)}, z AS (SELECT unnest([2, 3, 4]) AS size) SELECT z.size, count(signature) AS n, round(coalesce(avg(confidence), 0), 6) AS mean_confidence, round(coalesce(max(lift), 0), 6) AS max_lift FROM z LEFT JOIN ru USING (size) GROUP BY z.size")
def _size_stats(spark, d):
    return rule_ops.size_stats(experiments.cut(_rules(spark, d)), [GROUP]).select("size", "n", r6("mean_confidence"), r6("max_lift"))


# --- groups --------------------------------------------------------------------------------------

_GROUPED = f"WITH {INTERVALS_SQL}, {PEOPLE_SQL}"


@query("group_split", f"{_GROUPED} SELECT gender, state, count(*) AS n, count(DISTINCT client_id) AS n_clients FROM iv JOIN people USING (client_id) WHERE gender IS NOT NULL GROUP BY gender, state")
def _group_split(spark, d):
    rows = groups.with_group(state_intervals(spark, d), people(spark, d), "gender")
    return rows.groupBy("gender", "state").agg(F.count("*").alias("n"), F.countDistinct("client_id").alias("n_clients"))


@query("interaction_groups", f"{_GROUPED}, x AS (SELECT iv.*, gender || '_' || age_group AS grp FROM iv JOIN people USING (client_id) WHERE gender IS NOT NULL) SELECT grp, count(*) AS n FROM x WHERE grp IN (SELECT grp FROM x GROUP BY grp HAVING count(DISTINCT client_id) >= 3) GROUP BY grp")
def _interaction(spark, d):
    rows = groups.interaction_groups(state_intervals(spark, d), people(spark, d), "gender", "age_group")
    return rows.groupBy("grp").agg(F.count("*").alias("n"))


@query("crosstab", f"WITH {PEOPLE_SQL} SELECT segment, count(*) FILTER (gender = 'M') AS \"M\", count(*) FILTER (gender = 'F') AS \"F\" FROM people GROUP BY segment")
def _crosstab(spark, d):
    return groups.crosstab(people(spark, d), "segment", "gender", ["M", "F"])


@query("state_per_client", f"{_GROUPED}, c AS (SELECT dataset, state, client_id, count(*) AS n FROM iv GROUP BY ALL) SELECT dataset, state, round(avg(n), 6) AS mean_count, count(*) AS n_clients FROM c GROUP BY dataset, state")
def _state_per_client(spark, d):
    return groups.state_per_client(state_intervals(spark, d), "dataset").select("dataset", "state", r6("mean_count"), "n_clients")


@query("feature_share", f"{_GROUPED}, f AS (SELECT dataset, regexp_replace(state, '_(high|medium|low)$', '') AS feature FROM iv), g AS (SELECT dataset, count(*) AS total FROM f GROUP BY dataset), h AS (SELECT DISTINCT feature FROM f) SELECT g.dataset, h.feature, round((SELECT count(*) FROM f WHERE f.dataset = g.dataset AND f.feature = h.feature) / g.total, 6) AS share FROM g, h")
def _feature_share(spark, d):
    return groups.feature_share(state_intervals(spark, d), "dataset").select("dataset", "feature", r6("share"))


_GENDER_RULES = f"{_GROUPED}, gi AS (SELECT iv.*, gender FROM iv JOIN people USING (client_id) WHERE gender IS NOT NULL), {mining_sql(PAIRS, 'gi', 'gender')}, {rules_sql(PAIRS)}"


@query("gender_rules", f"{_GENDER_RULES} SELECT grp AS gender, {_RULE_COLUMNS} FROM ru")
def _gender_rules(spark, d):
    rows = groups.with_group(state_intervals(spark, d), people(spark, d), "gender")
    r = experiments.mined_rules(rows, "gender", PAIRS)
    return r.select(F.col(GROUP).alias("gender"), "signature", r6("confidence"), r6("lift"), r6("support"), "support_count")


# --- graphs, pages, text -------------------------------------------------------------------------


@query("triples_clean", f"WITH {TRIPLES_SQL}, gone AS (SELECT s FROM tr WHERE p = 'urn#timeSeriesSource' AND o NOT IN ('file1.csv', 'file2.csv', 'file3.csv')) SELECT s, p, o FROM tr WHERE s NOT IN (SELECT s FROM gone) AND o NOT IN (SELECT s FROM gone)")
def _triples_clean(spark, d):
    links = spark.createDataFrame([("file1.csv",), ("file2.csv",), ("file3.csv",)], "link string")
    return graph.clean_series(triples(spark, d), links)


@query("triples_bgp", f"WITH {TRIPLES_SQL} SELECT a.s AS customer, b.o AS region, c.o AS source FROM tr a JOIN tr b ON a.o = b.s AND b.p = 'urn#hasRegion' LEFT JOIN tr c ON a.s = c.s AND c.p = 'urn#timeSeriesSource' WHERE a.p = 'urn#hasNation'")
def _triples_bgp(spark, d):
    t = triples(spark, d)
    nation, region, source = graph.objects(t, "hasNation", "nation"), graph.objects(t, "hasRegion", "region").withColumnRenamed("s", "nation"), graph.objects(t, "timeSeriesSource", "source")
    return nation.join(region, "nation").join(source, "s", "left").select(F.col("s").alias("customer"), "region", "source")


@query(
    "subgraph",
    f"""WITH {TRIPLES_SQL}, n1 AS (SELECT DISTINCT s FROM tr WHERE o = 'urn#R1'), n2 AS (SELECT DISTINCT s FROM tr WHERE o IN (SELECT s FROM n1)), v AS (SELECT 'urn#R1' AS s UNION SELECT s FROM n1 UNION SELECT s FROM n2)
SELECT DISTINCT s, p, o FROM tr WHERE s IN (SELECT s FROM v) OR o IN (SELECT s FROM v)""",
)
def _subgraph(spark, d):
    return graph.subgraph(triples(spark, d), "urn#R1", 2)


@query("href_links", "WITH x AS (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) SELECT DISTINCT CASE WHEN starts_with(link, 'http') THEN link ELSE 'http://base/' || link END AS link FROM x")
def _href_links(spark, d):
    return readers.href_links(table(spark, d, "pages"), "html", "http://base/", 'href="([^"]*)"')


@query("sequence_text", f"WITH {INTERVALS_SQL} SELECT client_id, CAST(count(*) AS BIGINT) AS n_lines, string_agg(state, ' ' ORDER BY start_time, end_time, state) AS states FROM iv GROUP BY client_id")
def _sequence_text(spark, d):
    """The table through the sequence text format and back, as lines."""
    lines = sinks.sequence_lines(state_intervals(spark, d)).select("client_id", F.posexplode(F.split("value", "\n")).alias("no", "line")).filter("no > 0 AND line <> ''")
    return lines.groupBy("client_id").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", F.split("line", " ")[0].alias("s")))), lambda x: x["s"]), " ").alias("states"))


# --- no SQL counterpart --------------------------------------------------------------------------


def _signal(spark, d):
    """Embeddings in place of signals: one participant a vector, 8 samples a second."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("participant"), F.posexplode("embedding").alias("i", "v"))
    return e.select("participant", (F.col("i") / 8.0).alias("ts"), F.col("v").cast("double").alias("value"))


@query("bvp_power")
def _bvp_power(spark, d):
    return kernels.pulse_windows(_signal(spark, d), ["participant"], 8.0, 4.0)


@query("r_peaks")
def _r_peaks(spark, d):
    return kernels.peaks(_signal(spark, d), ["participant"], 8.0, "bvp")


@query("eda_windows")
def _eda_windows(spark, d):
    return kernels.skin_windows(_signal(spark, d), ["participant"], 8.0, 4.0)


@query("hrv_frequency")
def _hrv_frequency(spark, d):
    return kernels.hrv_frequency(_beats(spark, d), ["client_id"])
