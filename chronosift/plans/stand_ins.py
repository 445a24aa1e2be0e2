"""The engine's inputs made from the star-schema tables, in DataFrames and in SQL.

Clients are users, variables event types, data sets the users' number mod 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.functions import exprs
from chronosift.operators import intervals as iv
from chronosift.operators.quantiles import small

#: Users have some 67 events in 30 days: gaps and closing times follow.
CLOSING, MAXGAP = 3600.0, 43200.0
FAST, SLOW = 3600.0, 21600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, user_id, var, seconds since the first event, value, k, event_id."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t0"))  # one row
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.join(F.broadcast(first)).select(F.col("user_id").cast("string").alias("client_id"), "user_id", F.col("event_type").alias("var"), ((us - F.col("t0")).cast("double") / 1e6).alias("seconds"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"), "event_id")


EVENTS_SQL = """ev AS (SELECT CAST(user_id AS VARCHAR) AS client_id, user_id, event_type AS var,
  CAST(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS DOUBLE) / CAST(1e6 AS DOUBLE) AS seconds, value,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_id FROM events)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with unit (min-max within client and variable) and level (global terciles of the variable)."""
    long = events(spark, sf_dir)
    cut = iv.global_terciles(long, ["client_id"], ["var"])
    scaled = long.withColumn("unit", iv.personal_minmax(long, ["client_id", "var"]))
    return scaled.join(small(cut), "var").withColumn("level", exprs.level_cut(F.col("unit"), iv.tercile_cuts(F.col("p33"), F.col("p67"))))


LEVELS_SQL = (
    EVENTS_SQL
    + """,
nm AS (SELECT *, CASE WHEN count(value) OVER w >= 2 THEN CASE WHEN max(value) OVER w - min(value) OVER w < CAST(1e-10 AS DOUBLE) THEN 0.5
  ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END END AS unit FROM ev WINDOW w AS (PARTITION BY client_id, var)),
tc AS (SELECT var, quantile_cont(unit, 0.33) AS p33, quantile_cont(unit, 0.67) AS p67 FROM nm WHERE unit IS NOT NULL AND value IS NOT NULL GROUP BY var HAVING count(*) >= 10),
lv AS (SELECT nm.*, CASE WHEN unit >= 0 AND unit < p33 THEN 'low' WHEN unit >= p33 AND unit < p67 THEN 'medium'
  WHEN (unit >= p67 AND unit < 1.001) OR unit >= CAST(1.001 AS DOUBLE) - CAST(0.001 AS DOUBLE) THEN 'high' END AS level FROM nm JOIN tc USING (var))"""
)


def state_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, user_id, dataset, state, start_time, end_time."""
    runs = iv.runs(levels(spark, sf_dir), ["client_id", "user_id", "var"], "level", "seconds", ["event_id"], CLOSING)
    return runs.select("client_id", "user_id", F.concat(F.lit("ds"), (F.col("user_id") % 4).cast("string")).alias("dataset"), F.concat_ws("_", "var", "level").alias("state"), "start_time", "end_time").distinct()


def runs_sql(source: str, by: str, label: str, time: str, tie: str, closing: float, name: str = "rn") -> str:
    return f"""{name}_m AS (SELECT *, row_number() OVER w = 1 OR {label} IS DISTINCT FROM lag({label}) OVER w AS is_first,
  max({time}) OVER (PARTITION BY {by}) AS last_t FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY {time}, {tie})),
{name}_s AS (SELECT *, coalesce(lead({time}) OVER (PARTITION BY {by} ORDER BY {time}, {tie}), last_t + CAST({closing} AS DOUBLE)) AS end_t FROM {name}_m WHERE is_first),
{name} AS (SELECT {by}, {label}, {time} AS start_time, end_t AS end_time FROM {name}_s WHERE {label} IS NOT NULL AND {time} < end_t)"""


INTERVALS_SQL = (
    LEVELS_SQL
    + ",\n"
    + runs_sql("lv", "client_id, user_id, var", "level", "seconds", "event_id", CLOSING)
    + """,
iv AS (SELECT DISTINCT client_id, user_id, 'ds' || CAST(user_id % 4 AS VARCHAR) AS dataset, var || '_' || level AS state, start_time, end_time FROM rn)"""
)


def spelled_gender():
    """Genders of customers as different sources spell them."""
    return F.element_at(F.array(*[F.lit(x) for x in ("M", "female", "1", "WOMAN", " male ", "2", "x")]), (F.col("c_custkey") % 7 + 1).cast("int"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demographics: client_id, grp (market segment), gender, age, age_group, binary_age_group."""
    c = table(spark, sf_dir, "customer")
    age = (F.lit(18) + F.col("c_custkey") % 40).cast("double")
    spelled = spelled_gender()
    return c.select(F.col("c_custkey").cast("string").alias("client_id"), F.col("c_mktsegment").alias("segment"), exprs.clean_gender(spelled).alias("gender"), age.alias("age"), exprs.age_group(age).alias("age_group"), exprs.young_or_old(age).alias("binary_age_group"))


PEOPLE_SQL = """pp AS (SELECT CAST(c_custkey AS VARCHAR) AS client_id, c_mktsegment AS segment,
  CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'M' WHEN 3 THEN 'F' WHEN 4 THEN 'M' WHEN 5 THEN 'F' END AS gender,
  CAST(18 + c_custkey % 40 AS DOUBLE) AS age FROM customer),
people AS (SELECT *, CASE WHEN age < 20 THEN '19-19' WHEN age < 25 THEN '20-24' WHEN age < 30 THEN '25-29' WHEN age < 35 THEN '30-34' WHEN age < 40 THEN '35-39' ELSE '40+' END AS age_group,
  CASE WHEN age <= 25 THEN 'young' ELSE 'old' END AS binary_age_group FROM pp)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, nations and regions as triples."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    node = lambda kind, key: F.concat(F.lit(f"urn#{kind}"), F.col(key).cast("string"))
    a = c.select(node("C", "c_custkey").alias("s"), F.lit("urn#hasNation").alias("p"), node("N", "c_nationkey").alias("o"))
    b = n.select(node("N", "n_nationkey").alias("s"), F.lit("urn#hasRegion").alias("p"), node("R", "n_regionkey").alias("o"))
    t = c.select(node("C", "c_custkey").alias("s"), F.lit("urn#type").alias("p"), F.lit("urn#TimeSeries").alias("o"))
    names = r.select(node("R", "r_regionkey").alias("s"), F.lit("urn#hasName").alias("p"), F.col("r_name").alias("o"))
    src = c.filter("c_custkey % 3 <> 0").select(node("C", "c_custkey").alias("s"), F.lit("urn#timeSeriesSource").alias("p"), F.concat(F.lit("file"), (F.col("c_custkey") % 50).cast("string"), F.lit(".csv")).alias("o"))
    return a.unionByName(b).unionByName(t).unionByName(names).unionByName(src)


TRIPLES_SQL = """tr AS (SELECT 'urn#C' || c_custkey AS s, 'urn#hasNation' AS p, 'urn#N' || c_nationkey AS o FROM customer
  UNION ALL SELECT 'urn#N' || n_nationkey, 'urn#hasRegion', 'urn#R' || n_regionkey FROM nation
  UNION ALL SELECT 'urn#C' || c_custkey, 'urn#type', 'urn#TimeSeries' FROM customer
  UNION ALL SELECT 'urn#R' || r_regionkey, 'urn#hasName', r_name FROM region
  UNION ALL SELECT 'urn#C' || c_custkey, 'urn#timeSeriesSource', 'file' || (c_custkey % 50) || '.csv' FROM customer WHERE c_custkey % 3 <> 0)"""
