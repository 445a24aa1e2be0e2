"""Named queries of whole analyses: data sets compared, groups, labels, permutations, sessions, subgraphs, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.lineage import cut, fresh_path
from chronosift.operators import compare, graph, sessions, windows
from chronosift.operators import intervals as iv
from chronosift.operators import rules as rule_ops
from chronosift.plans import experiments
from chronosift.plans.catalogue import _GRID_SQL, _RULE_COLUMNS, _SIMPLE_SQL, PAIRS, _patterns, mining_sql, query, r6, rules_sql
from chronosift.plans.stand_ins import CLOSING, EVENTS_SQL, INTERVALS_SQL, PEOPLE_SQL, TRIPLES_SQL, events, levels, people, runs_sql, state_intervals, table, triples
from chronosift.sources import readers
from chronosift.streaming import windows as streams

# --- inputs: intervals named after features, in two to six data sets -----------------------------

#: Event types in place of features.
FEATURES = {"click": "arousal", "error": "eda", "purchase": "hr", "signup": "temp", "view": "bvp_std"}
_FEATURE_SQL = "CASE split_part(state, '_', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURES.items()) + " END"
NAMED_SQL = f"""{INTERVALS_SQL}, fi AS (SELECT client_id, user_id, dataset, 'd' || CAST(user_id % 6 AS VARCHAR) AS six, CASE WHEN user_id % 2 = 0 THEN 'self' ELSE 'external' END AS side,
  {_FEATURE_SQL} || '_' || split_part(state, '_', 2) AS state, start_time, end_time FROM iv)"""


def named(spark, d) -> DataFrame:
    """State intervals with states of features, the data set, one of six data sets, and one of two sides."""
    names = F.create_map(*[F.lit(x) for pair in FEATURES.items() for x in pair])
    part = lambda i: F.split_part("state", F.lit("_"), F.lit(i))
    state = F.concat_ws("_", F.element_at(names, part(1)), part(2))
    six = F.concat(F.lit("d"), (F.col("user_id") % 6).cast("string"))
    return state_intervals(spark, d).withColumn("state", state).withColumn("six", six).withColumn("side", F.when(F.col("user_id") % 2 == 0, "self").otherwise("external"))


def _filter_sql(no_heart_only=False, no_skin_only=False, only_cross=False, no_single_feature=False) -> str:
    """Whether a rule stays, from the states in its text."""
    states = "regexp_extract_all(cons, 'emo_[a-z]+|[a-z_]+_(?:low|medium|high)')"
    none = lambda test: f"len(list_filter(l, lambda v: NOT {test})) = 0"
    drops = []
    if no_heart_only:
        drops.append(none("regexp_matches(v, '^(bvp_std|bvp_peak_to_peak|bvp_spectral_power|hrv_(sdnn|rmssd|pnn50|pnn20|cvnn|cvsd|lf_hf|lfn|hfn)|hr_)')"))
    if no_skin_only:
        drops.append(none("starts_with(v, 'eda')"))
    if only_cross:
        drops.append("len(list_filter(l, lambda v: regexp_matches(v, '^(arousal|valence|emo_)'))) = 0 OR len(list_filter(l, lambda v: starts_with(v, 'temp'))) > 0")
    if no_single_feature:
        drops.append("len(list_distinct(list_transform(l, lambda v: regexp_replace(v, '_(high|medium|low)$', '')))) = 1")
    return f"SELECT * EXCLUDE (l) FROM (SELECT *, {states} AS l FROM ru) x WHERE NOT ({' OR '.join(f'({x})' for x in drops)})"


_ALL = {"no_heart_only": True, "no_skin_only": True, "only_cross": True, "no_single_feature": True}


def _mined(group: str, source: str = "fi", flags: dict | None = None, more: str = "") -> str:
    """CTEs up to rf, the filtered rules (grp, signature, measures) of a source's groups."""
    return f"WITH {NAMED_SQL}{more}, {mining_sql(PAIRS, source, group)}, {rules_sql(PAIRS)}, rf AS ({_filter_sql(**flags) if flags else 'SELECT * FROM ru'})"


# --- E1, W2: feature rows to intervals through the operators --------------------------------------

_FEATURE_INTERVALS = f"""WITH {EVENTS_SQL}, fr AS (SELECT client_id, seconds, event_id, k AS arousal, CASE WHEN var IN ('click', 'view') THEN value END AS hr_mean, CASE WHEN var = 'error' THEN value END AS eda_mean FROM ev),
ar AS (SELECT client_id, seconds, event_id, 'arousal' AS var, CASE WHEN u >= 0 AND u < 0.33 THEN 'low' WHEN u >= 0.33 AND u < 0.66 THEN 'medium' WHEN (u >= 0.66 AND u < 1.0) OR u >= CAST(1.0 AS DOUBLE) - CAST(0.001 AS DOUBLE) THEN 'high' END AS level FROM (SELECT *, (arousal - 0.0) / 100.0 AS u FROM fr) x),
hv AS (SELECT client_id, seconds, event_id, hr_mean AS v, CASE WHEN count(hr_mean) OVER w >= 2 THEN CASE WHEN max(hr_mean) OVER w - min(hr_mean) OVER w < CAST(1e-10 AS DOUBLE) THEN 0.5 ELSE (hr_mean - min(hr_mean) OVER w) / (max(hr_mean) OVER w - min(hr_mean) OVER w) END END AS u FROM fr WINDOW w AS (PARTITION BY client_id)),
hc AS (SELECT quantile_cont(u, 0.33) AS p33, quantile_cont(u, 0.67) AS p67 FROM hv WHERE u IS NOT NULL AND v IS NOT NULL HAVING count(*) >= 10),
hl AS (SELECT client_id, seconds, event_id, 'hr' AS var, CASE WHEN u >= 0 AND u < p33 THEN 'low' WHEN u >= p33 AND u < p67 THEN 'medium' WHEN (u >= p67 AND u < 1.001) OR u >= CAST(1.001 AS DOUBLE) - CAST(0.001 AS DOUBLE) THEN 'high' END AS level FROM hv, hc),
et AS (SELECT client_id, min(eda_mean) AS lo, quantile_cont(eda_mean, 0.33) AS p33, quantile_cont(eda_mean, 0.67) AS p67, max(eda_mean) + 0.001 AS hi FROM fr WHERE eda_mean IS NOT NULL GROUP BY client_id HAVING count(*) >= 3),
el AS (SELECT fr.client_id, seconds, event_id, 'eda' AS var, CASE WHEN eda_mean >= lo AND eda_mean < p33 THEN 'low' WHEN eda_mean >= p33 AND eda_mean < p67 THEN 'medium' WHEN (eda_mean >= p67 AND eda_mean < hi) OR eda_mean >= hi - 0.001 THEN 'high' END AS level FROM fr LEFT JOIN et ON et.client_id = fr.client_id),
al AS (SELECT * FROM ar UNION ALL SELECT * FROM hl UNION ALL SELECT * FROM el), {runs_sql("al", "client_id, var", "level", "seconds", "event_id", 30.0)}
SELECT DISTINCT client_id, var || '_' || level AS state, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM rn"""


@query("feature_intervals", _FEATURE_INTERVALS)
def _feature_intervals(spark, d):
    """Wide feature rows to intervals: arousal at fixed levels, hr_mean at its global terciles, eda_mean at each client's own."""
    kind = F.col("var")
    wide = events(spark, d).select("client_id", "seconds", "event_id", F.col("k").alias("arousal"), F.when(kind.isin("click", "view"), F.col("value")).alias("hr_mean"), F.when(kind == "error", F.col("value")).alias("eda_mean"))
    cuts = iv.global_terciles(iv.to_long(wide, ["client_id"], ["hr_mean"]), ["client_id"], ["var"])
    return iv.state_intervals(wide, cuts, (0.0, 100.0), ties=["event_id"]).select("client_id", "state", r6("start_time"), r6("end_time"))


_EMOTIONS = f"""em AS (SELECT client_id, user_id, seconds, event_id, 'emo_' || {_GRID_SQL} AS state FROM (SELECT *, {_SIMPLE_SQL.format("((k - 0.0) / 100.0)")} AS a, {_SIMPLE_SQL.format("((value - 0.0) / 100.0)")} AS v FROM ev) x), {runs_sql("em", "client_id, user_id", "state", "seconds", "event_id", 30.0, "er")}"""


def _emotions(spark, d):
    rows = events(spark, d).withColumnsRenamed({"k": "arousal", "value": "valence"})
    return iv.emotion_intervals(rows, (0, 100), (0, 100), ties=["event_id"])


@query("emotion_intervals", f"WITH {EVENTS_SQL}, {_EMOTIONS} SELECT client_id, state, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM er")
def _emotion_intervals(spark, d):
    return _emotions(spark, d).select("client_id", "state", r6("start_time"), r6("end_time"))


@query("length_stats", f"WITH {INTERVALS_SQL}, n AS (SELECT count(*) AS n FROM iv GROUP BY client_id) SELECT round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, max(n) AS max FROM n")
def _length_stats(spark, d):
    return iv.length_stats(state_intervals(spark, d)).select(r6("mean"), r6("std"), "min", "max")


# --- rules: filters, orders, combinations ---------------------------------------------------------


@query("rules_filtered", f"{_mined('dataset', flags=_ALL)} SELECT grp AS ds, {_RULE_COLUMNS} FROM rf")
def _rules_filtered(spark, d):
    """Mined rules with the four filters on."""
    r = experiments.mined_rules(named(spark, d), "dataset", PAIRS, _ALL)
    return r.select(F.col("grp").alias("ds"), "signature", r6("confidence"), r6("lift"), r6("support"), "support_count")


@query("top_by_support", f"{_mined(chr(39) + 'all' + chr(39))} SELECT signature, support_count FROM rf ORDER BY support_count DESC, signature LIMIT 10")
def _top_by_support(spark, d):
    return rule_ops.top_by(experiments.mined_rules(named(spark, d), None, PAIRS), "support_count", 10).select("signature", "support_count")


@query("patterns_by_size", f"WITH {INTERVALS_SQL}, {mining_sql(PAIRS, 'iv', 'dataset')} SELECT grp AS ds, CAST(1 AS BIGINT) AS size, count(*) AS n_patterns FROM p1 GROUP BY grp UNION ALL SELECT grp, 2, count(*) FROM p2 GROUP BY grp")
def _patterns_by_size(spark, d):
    return rule_ops.by_size(_patterns(spark, d, PAIRS, "dataset"), ["grp"]).select(F.col("grp").alias("ds"), F.col("size").cast("long").alias("size"), "n_patterns")


def _combos_sql(k: int) -> str:
    names = [f"x{i}" for i in range(k)]
    picked = ", ".join(f"g{i}.grp AS x{i}" for i in range(k))
    frm = ", ".join(f"g g{i}" for i in range(k))
    order = " AND ".join(f"g{i}.grp < g{i + 1}.grp" for i in range(k - 1))
    has = " AND ".join(f"list_contains(present, {n})" for n in names)
    return f"""{_mined('six')}, g AS (SELECT DISTINCT grp FROM rf), pr AS (SELECT signature, list(DISTINCT grp) AS present FROM rf GROUP BY signature), c AS (SELECT {picked}, t.grp AS target FROM {frm}, g t WHERE {order}),
cm AS (SELECT {" || '+' || ".join(names)} AS combo, target, CASE WHEN {" AND ".join(f"target <> {n}" for n in names)} THEN (SELECT count(*) FROM pr WHERE {has} AND list_contains(present, target)) END AS n FROM c)"""


def _six_rules(spark, d):
    return cut(experiments.mined_rules(named(spark, d), "six", PAIRS).withColumnRenamed("grp", "ds"))


def _combos(k):
    return lambda spark, d: compare.combination_matrix(_six_rules(spark, d), k)


for _k in (3, 4, 5):
    query(f"combo_matrix_{_k}", f"{_combos_sql(_k)} SELECT combo, target, n FROM cm")(_combos(_k))


@query("combo_sparse", f"{_combos_sql(3)} SELECT combo, target, n FROM cm WHERE combo IN (SELECT combo FROM cm WHERE n > 0) AND target IN (SELECT target FROM cm WHERE n > 0)")
def _combo_sparse(spark, d):
    return compare.combination_matrix(_six_rules(spark, d), 3, sparse=True)


@query("combo_top5", f"{_combos_sql(2)} SELECT combo, target, n FROM cm WHERE n IS NOT NULL ORDER BY n DESC, combo, target LIMIT 5")
def _combo_top(spark, d):
    return compare.top_combinations(compare.combination_matrix(_six_rules(spark, d), 2))


_SIX_PRESENCE = f"{_mined('six')}, pr AS (SELECT signature, count(DISTINCT grp) AS k, round(avg(confidence), 4) AS c, round(avg(lift), 4) AS l FROM rf GROUP BY signature)"


@query("majority_ranked", f"{_SIX_PRESENCE} SELECT signature, CAST(k AS BIGINT) AS n_present, CAST(row_number() OVER (ORDER BY k DESC, c DESC, l DESC, signature) AS BIGINT) AS rank FROM pr WHERE k >= 4")
def _majority_ranked(spark, d):
    found = compare.ranked(compare.at_least(_six_rules(spark, d), 4), compare.BY_MAJORITY)
    return found.select("signature", F.col("n_present").cast("long").alias("n_present"), F.col("rank").cast("long").alias("rank"))


@query("shift_ranked", f"{_mined('side')}, sh AS (SELECT a.signature, b.confidence - a.confidence AS delta FROM rf a JOIN rf b USING (signature) WHERE a.grp = 'self' AND b.grp = 'external') SELECT signature, round(delta, 6) AS delta, CAST(row_number() OVER (ORDER BY abs(delta) DESC, signature) AS BIGINT) AS rank FROM sh")
def _shift_ranked(spark, d):
    rules = cut(experiments.mined_rules(named(spark, d), "side", PAIRS).withColumnRenamed("grp", "ds"))
    found = compare.ranked(compare.confidence_shift(rules, "ds", "self", "external"), ("delta",))
    return found.select("signature", r6("delta"), F.col("rank").cast("long").alias("rank"))


# --- whole analyses -------------------------------------------------------------------------------

_POOLED = ", bo AS (SELECT dataset AS cell, client_id, state, start_time, end_time FROM fi UNION ALL SELECT 'pooled', dataset || '_' || client_id, state, start_time, end_time FROM fi)"


@query(
    "compare_datasets",
    f"""{_mined('cell', 'bo', None, _POOLED)}, pr AS (SELECT signature, count(DISTINCT grp) AS k, min(grp) AS own FROM rf WHERE grp <> 'pooled' GROUP BY signature), n AS (SELECT count(DISTINCT grp) AS n FROM rf WHERE grp <> 'pooled')
SELECT 'rules' AS part, grp AS name, count(*) AS n FROM rf WHERE grp <> 'pooled' GROUP BY grp UNION ALL SELECT 'pooled', 'all', count(*) FROM rf WHERE grp = 'pooled' UNION ALL SELECT 'common_all', 'all', count(*) FROM pr, n WHERE k = n.n
UNION ALL SELECT 'common_3_plus', 'all', count(*) FROM pr WHERE k >= 3 UNION ALL SELECT 'unique', own, count(*) FROM pr WHERE k = 1 GROUP BY own""",
)
def _compare_datasets(spark, d):
    found = experiments.compare_datasets(named(spark, d), params=PAIRS)
    of = lambda part, name: found[part].groupBy(F.lit(part).alias("part"), name.alias("name")).agg(F.count("*").alias("n"))
    whole = lambda part: found[part].agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), F.lit("all").alias("name"), "n")
    return of("rules", F.col("ds")).unionByName(of("unique", F.col("ds"))).unionByName(whole("pooled")).unionByName(whole("common_all")).unionByName(whole("common_3_plus"))


SCENARIOS = {"all": ["d0", "d1", "d2", "d3", "d4", "d5"], "three": ["d0", "d2", "d4"], "two": ["d1", "d5"], "one": ["d3"]}


@query(
    "universal_scenarios",
    f"{_mined('six', flags=_ALL)}"
    + " UNION ALL ".join(
        f" SELECT '{n}' AS scenario, signature, round(avg(confidence), 4) AS avg_confidence, round(min(support), 4) AS min_support FROM rf WHERE grp IN ({', '.join(repr(x) for x in m)}) GROUP BY signature HAVING count(DISTINCT grp) = {len(m)}"
        for n, m in SCENARIOS.items()
        if len(m) > 1
    ),
)
def _universal_scenarios(spark, d):
    found = experiments.universal_rules(named(spark, d), SCENARIOS, "six", PAIRS, _ALL)
    rows = [df.select(F.lit(n).alias("scenario"), "signature", "avg_confidence", "min_support") for n, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_GENDERED = f", {PEOPLE_SQL}, gi AS (SELECT fi.*, gender FROM fi JOIN people USING (client_id) WHERE gender IS NOT NULL)"


@query(
    "demographic_groups",
    f"""{_mined('gender', 'gi', _ALL, _GENDERED)}, t AS (SELECT grp, signature, row_number() OVER (PARTITION BY grp ORDER BY confidence DESC, signature) AS no FROM rf), u AS (SELECT DISTINCT grp, signature FROM rf), g AS (SELECT DISTINCT grp FROM u)
SELECT 'top' AS part, grp AS name, signature, CAST(NULL AS DOUBLE) AS value FROM t WHERE no <= 50
UNION ALL SELECT 'jaccard', a.grp || '+' || b.grp, NULL, round((SELECT count(*) FROM u x JOIN u y USING (signature) WHERE x.grp = a.grp AND y.grp = b.grp) / (SELECT count(DISTINCT signature) FROM u WHERE grp IN (a.grp, b.grp)), 6) FROM g a, g b""",
)
def _demographic_groups(spark, d):
    found = experiments.demographic_groups(named(spark, d), people(spark, d), "gender", PAIRS, filters=_ALL)
    top = found["top"].select(F.lit("top").alias("part"), F.col("ds").alias("name"), "signature", F.lit(None).cast("double").alias("value"))
    return top.unionByName(found["jaccard"].select(F.lit("jaccard").alias("part"), F.concat_ws("+", "left", "right").alias("name"), F.lit(None).cast("string").alias("signature"), r6("jaccard", "value")))


_BOTH_LABELS = f""", {_EMOTIONS}, bl AS (SELECT 'dimensional|' || dataset AS cell, client_id, state, start_time, end_time FROM fi
UNION ALL SELECT 'discrete|ds' || CAST(user_id % 4 AS VARCHAR), client_id, state, start_time, end_time FROM er UNION ALL SELECT 'discrete|' || dataset, client_id, state, start_time, end_time FROM fi WHERE state NOT LIKE 'arousal%')"""


@query("labels_compared", f"{_mined('cell', 'bl', {'only_cross': True}, _BOTH_LABELS)} SELECT split_part(grp, '|', 1) AS kind, split_part(grp, '|', 2) AS ds, count(DISTINCT signature) AS n FROM rf GROUP BY ALL")
def _labels_compared(spark, d):
    """Rules with levels of arousal against rules with emotion labels, beside the same physiological states."""
    columns = ["client_id", "dataset", "state", "start_time", "end_time"]
    dimensional = named(spark, d).select(*columns)
    labels = _emotions(spark, d).withColumn("dataset", F.concat(F.lit("ds"), (F.col("client_id").cast("long") % 4).cast("string"))).select(*columns)
    discrete = labels.unionByName(dimensional.filter(~F.col("state").startswith("arousal")))
    return experiments.labels_compared(dimensional, discrete, params=PAIRS)["counts"]


@query("self_and_external", f"{_mined('side', flags={'no_single_feature': True})}, p AS (SELECT signature, max(CASE WHEN grp = 'self' THEN 1 ELSE 0 END) AS a, max(CASE WHEN grp = 'external' THEN 1 ELSE 0 END) AS b FROM rf GROUP BY signature) SELECT count(*) AS n_union, count(*) FILTER (a = 1 AND b = 1) AS n_shared, count(*) FILTER (a = 1 AND b = 0) AS n_only_self, count(*) FILTER (a = 0 AND b = 1) AS n_only_external, round(CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (a = 1 AND b = 1) / count(*) END, 6) AS jaccard FROM p")
def _self_and_external(spark, d):
    out = experiments.self_and_external(named(spark, d), "side", params=PAIRS, filters={"no_single_feature": True})["sets"]
    return out.withColumn("jaccard", F.round("jaccard", 6))


@query(
    "multimodality",
    f"""{_mined('dataset', flags={'no_single_feature': True})}, z AS (SELECT unnest([2, 3, 4]) AS size), s AS (SELECT grp, 'states' AS kind, size, confidence, lift FROM rf UNION ALL SELECT grp, 'text', 2 + len(regexp_extract_all(signature, ' meets | contains ')), confidence, lift FROM rf), k AS (SELECT unnest(['states', 'text']) AS kind), g AS (SELECT DISTINCT grp FROM rf)
SELECT g.grp AS ds, k.kind AS counted_by, CAST(z.size AS BIGINT) AS size, count(s.size) AS n, round(coalesce(avg(confidence), 0), 6) AS mean_confidence, round(coalesce(max(lift), 0), 6) AS max_lift FROM g, k, z LEFT JOIN s ON s.grp = g.grp AND s.kind = k.kind AND s.size = z.size GROUP BY ALL""",
)
def _multimodality(spark, d):
    out = experiments.multimodality(named(spark, d), params=PAIRS)
    return out.select(F.col("grp").alias("ds"), F.col("by").alias("counted_by"), F.col("size").cast("long").alias("size"), "n", r6("mean_confidence"), r6("max_lift"))


_SHUFFLED = """, pl AS (SELECT dataset, client_id, state, start_time, end_time, row_number() OVER (PARTITION BY dataset, client_id ORDER BY start_time, end_time, state) AS i FROM iv),
dl AS (SELECT *, row_number() OVER (PARTITION BY dataset, client_id ORDER BY md5('42|' || dataset || '|' || client_id || '|' || i), i) AS j FROM pl),
bo AS (SELECT dataset || '|original' AS cell, client_id, state, start_time, end_time FROM iv UNION ALL SELECT a.dataset || '|shuffled', a.client_id, b.state, a.start_time, a.end_time FROM pl a JOIN dl b ON a.dataset = b.dataset AND a.client_id = b.client_id AND a.i = b.j)"""
_SHUFFLED_RULES = f"WITH {INTERVALS_SQL}{_SHUFFLED}, {mining_sql(PAIRS, 'bo', 'cell')}, {rules_sql(PAIRS)}, u AS (SELECT DISTINCT split_part(grp, '|', 1) AS ds, split_part(grp, '|', 2) AS kind, signature FROM ru)"


@query(
    "permutation_baseline",
    f"""{_SHUFFLED_RULES}, n AS (SELECT ds, count(*) FILTER (kind = 'original') AS n_original, count(*) FILTER (kind = 'shuffled') AS n_shuffled FROM u GROUP BY ds)
SELECT d.dataset AS ds, coalesce(n_original, 0) AS n_original, coalesce(n_shuffled, 0) AS n_shuffled, round(CASE WHEN n_original > 0 THEN (1 - n_shuffled / n_original) * 100 END, 6) AS reduction_pct FROM (SELECT DISTINCT dataset FROM iv) d LEFT JOIN n ON n.ds = d.dataset""",
)
def _permutation(spark, d):
    out = experiments.permutation_baseline(state_intervals(spark, d), "dataset", PAIRS)
    return out.select("ds", "n_original", "n_shuffled", r6("reduction_pct"))


@query(
    "permuted_universal",
    f"""{_SHUFFLED_RULES}, m AS (SELECT kind, count(DISTINCT ds) AS m FROM u GROUP BY kind), k AS (SELECT kind, signature, count(*) AS k FROM u GROUP BY ALL)
SELECT (SELECT count(*) FROM k JOIN m USING (kind) WHERE kind = 'original' AND k = m) AS n_original, (SELECT count(*) FROM k JOIN m USING (kind) WHERE kind = 'shuffled' AND k = m) AS n_shuffled""",
)
def _permuted_universal(spark, d):
    return experiments.permuted_universal(state_intervals(spark, d), params=PAIRS)


# --- scans, graphs, sessions ----------------------------------------------------------------------


@query("mixed_headers", f"WITH {EVENTS_SQL} SELECT client_id, round(seconds, 6) AS seconds, CASE WHEN user_id % 3 < 2 THEN round(value, 6) END AS value, event_id FROM ev")
def _mixed_headers(spark, d):
    """Files of three headers in one folder: columns in two orders, and one missing."""
    path = fresh_path(spark, "headers")
    e = events(spark, d).select("client_id", "seconds", "value", "event_id", "user_id")
    for no, columns in enumerate((["seconds", "value", "client_id", "event_id"], ["value", "event_id", "seconds", "client_id"], ["event_id", "client_id", "seconds"])):
        e.filter(F.col("user_id") % 3 == no).select(*columns).write.mode("append").csv(path, header=True)
    rows, _ = readers.csv_by_header(spark, path, ["client_id", "seconds", "value", "event_id"], required=["seconds"])
    return rows.select("client_id", r6(F.col("seconds").cast("double"), "seconds"), r6(F.col("value").cast("double"), "value"), F.col("event_id").cast("long").alias("event_id"))


@query(
    "subgraphs",
    f"""WITH RECURSIVE {TRIPLES_SQL}, td AS (SELECT DISTINCT s, p, o FROM tr), v AS (SELECT DISTINCT s AS label, s AS node, 0 AS step FROM td WHERE s LIKE 'urn#R%' OR s LIKE 'urn#N1%' UNION SELECT v.label, td.s, v.step + 1 FROM v JOIN td ON td.o = v.node WHERE v.step < 2 AND td.s NOT LIKE '%#exp'),
n AS (SELECT DISTINCT label, node FROM v) SELECT DISTINCT n.label, td.s, td.p, td.o FROM n JOIN td ON td.s = n.node OR td.o = n.node""",
)
def _subgraphs(spark, d):
    """The subgraphs of all regions, and of the nations whose number begins with 1, in one go."""
    t = triples(spark, d)
    starts = t.filter(F.col("s").startswith("urn#R") | F.col("s").startswith("urn#N1")).select(F.col("s").alias("label"), "s").distinct()
    return graph.subgraphs(t, starts)


_SAMPLES_SQL = EVENTS_SQL + ", sa AS (SELECT client_id, 'c' || CAST(event_id % 3 AS VARCHAR) AS condition, var, seconds, value FROM ev)"
_LABELS, _SIGNALS, _ALL_SOURCES = ["click", "error"], ["purchase", "signup"], ["click", "error", "purchase", "signup", "view"]


def _samples(spark, d):
    """Events as the samples of three conditions of a client, whose timelines overlap."""
    return events(spark, d).select("client_id", F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("condition"), F.col("var").alias("source"), F.col("seconds").alias("ts"), "value")


def _session_sql(bounds: str, width: float) -> str:
    means = ", ".join(f"count(f.value) FILTER (f.var = '{n}') AS {n}_n, round(avg(f.value) FILTER (f.var = '{n}'), 6) AS {n}_mean" for n in _ALL_SOURCES)
    w = f"CAST({width} AS DOUBLE)"
    return f"""WITH {_SAMPLES_SQL}, {bounds}, g AS (SELECT *, unnest(range(CAST(floor((bound - origin) / {w}) AS BIGINT))) AS "window" FROM b WHERE bound - origin >= {w}),
f AS (SELECT sa.*, CAST(floor((seconds - origin) / {w}) AS BIGINT) AS at FROM sa JOIN b USING (client_id, condition) WHERE seconds >= origin)
SELECT g.client_id, g.condition, g."window", round(g.origin + (g."window" + 1) * {w}, 6) AS seconds, {means} FROM g LEFT JOIN f ON f.client_id = g.client_id AND f.condition = g.condition AND f.at = g."window" GROUP BY g.client_id, g.condition, g."window", g.origin"""


_BOUNDS_SQL = """pe AS (SELECT client_id, condition, var, min(seconds) AS a, max(seconds) AS z FROM sa GROUP BY ALL),
b AS (SELECT client_id, condition, greatest(max(a) FILTER (var IN ('click', 'error')), min(a) FILTER (var IN ('purchase', 'signup'))) AS origin, min(z) FILTER (var IN ('click', 'error')) AS bound FROM pe GROUP BY ALL
  HAVING count(*) FILTER (var IN ('click', 'error')) = 2 AND count(*) FILTER (var IN ('purchase', 'signup')) > 0 AND min(z) FILTER (var IN ('click', 'error')) > greatest(max(a) FILTER (var IN ('click', 'error')), min(a) FILTER (var IN ('purchase', 'signup'))))"""
_DAY = 86400.0


def _session_rows(found):
    return found.select("client_id", "condition", "window", r6("seconds"), *[f"{n}_n" for n in _ALL_SOURCES], *[r6(f"{n}_mean") for n in _ALL_SOURCES])


@query("session_grid", _session_sql(_BOUNDS_SQL, _DAY))
def _session_grid(spark, d):
    """Windows of a day between the ends that labels and signals of each client's condition have in common."""
    s = _samples(spark, d)
    by = ["client_id", "condition"]
    return _session_rows(sessions.session_windows(s, sessions.bounds(s, by, _LABELS, _SIGNALS), by, _DAY, _ALL_SOURCES))


@query("video_grid", _session_sql("b AS (SELECT client_id, condition, CAST(0 AS DOUBLE) AS origin, max(seconds) AS bound FROM sa WHERE var IN ('click', 'error') GROUP BY ALL)", 3 * _DAY))
def _video_grid(spark, d):
    """Windows of three days from 0 to the last label of each client's condition."""
    s = _samples(spark, d)
    by = ["client_id", "condition"]
    return _session_rows(sessions.session_windows(s, sessions.restarted(s, by, _LABELS), by, 3 * _DAY, _ALL_SOURCES))


@query(
    "chained_labels",
    f"""WITH RECURSIVE {EVENTS_SQL}, sg AS (SELECT client_id, CAST(no AS BIGINT) AS no, 'v' || no AS label, (CAST(client_id AS BIGINT) % 7 + no) * 100000.0 AS duration FROM (SELECT DISTINCT client_id FROM ev) c, (SELECT unnest(range(1, 6)) AS no) n),
r AS (SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS no, CAST(0.0 AS DOUBLE) AS from_t, CAST(0.0 AS DOUBLE) AS to_t FROM ev
  UNION ALL SELECT r.client_id, r.no + 1, r.to_t, (SELECT e.seconds FROM ev e WHERE e.client_id = r.client_id ORDER BY abs(e.seconds - (r.to_t + sg.duration)), e.seconds LIMIT 1) FROM r JOIN sg ON sg.client_id = r.client_id AND sg.no = r.no + 1)
SELECT ev.event_id, max_by(sg.label, sg.no) AS label FROM ev LEFT JOIN r ON r.client_id = ev.client_id AND r.no > 0 AND ev.seconds <= r.to_t AND (ev.seconds > r.from_t OR r.no = 1) LEFT JOIN sg ON sg.client_id = r.client_id AND sg.no = r.no GROUP BY ev.event_id""",
)
def _chained_labels(spark, d):
    e = events(spark, d)
    segments = e.select("client_id").distinct().select("client_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("no"))
    segments = segments.select("client_id", "no", F.concat(F.lit("v"), F.col("no").cast("string")).alias("label"), ((F.col("client_id").cast("long") % 7 + F.col("no")) * 100000.0).alias("duration"))
    return sessions.chained_labels(e.select("client_id", F.col("seconds").alias("ts"), "event_id"), segments, ["client_id"]).select("event_id", "label")


# --- heart rate on grids told from the data, merges of all recordings ------------------------------

_CLOCKS_SQL = """cl AS (SELECT CAST(user_id AS VARCHAR) AS client_id, CASE user_id % 3 WHEN 0 THEN event_id / 7.0 WHEN 1 THEN event_id * 500.0 ELSE 1500000000.0 + event_id * 400.0 END AS ts,
  (290 + event_id * 7919 % 1730) / CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 1000.0 END AS ibi FROM events),
fc AS (SELECT client_id, CASE WHEN avg(ibi) > 100 THEN 1.0 ELSE 1000.0 END AS f FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts) AS no FROM cl) x WHERE no <= 10 GROUP BY client_id),
ms AS (SELECT client_id, ts, ibi * f AS ibi FROM cl JOIN fc USING (client_id)), en AS (SELECT client_id, max(ts) AS max_time FROM ms GROUP BY client_id)"""


def _on_grid_sql(beats: str, grids: str) -> str:
    """CTEs b, s and q (the points with hr) of beats (client_id, t, ibi) on grids gr (client_id, start, step, n)."""
    return f"""b AS (SELECT client_id, t, avg(60000.0 / ibi) AS hr FROM {beats} WHERE ibi > 300 AND ibi < 2000 GROUP BY ALL), {grids},
q AS (SELECT client_id, start + k * step AS ts FROM (SELECT *, unnest(range(n)) AS k FROM gr) x),
lo AS (SELECT q.client_id, q.ts, b.t AS t0, b.hr AS h0 FROM q ASOF LEFT JOIN b ON b.client_id = q.client_id AND b.t <= q.ts),
hi AS (SELECT lo.*, b.t AS t1, b.hr AS h1 FROM lo ASOF LEFT JOIN b ON b.client_id = lo.client_id AND b.t >= lo.ts)
SELECT client_id, round(ts, 4) AS ts, round(CASE WHEN t0 = t1 THEN h0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN h0 + (h1 - h0) * (ts - t0) / (t1 - t0) END, 6) AS hr FROM hi"""


_TOLD = """fi AS (SELECT client_id, min(t) AS f FROM b GROUP BY client_id HAVING count(*) >= 2),
st AS (SELECT client_id, max_time, f, CASE WHEN max_time > 10000 THEN 1000.0 ELSE 1.0 END AS step FROM en JOIN fi USING (client_id) WHERE max_time > 0),
gr AS (SELECT client_id, step, start, CAST(ceil((max_time - start) / step) AS BIGINT) AS n FROM (SELECT *, CASE WHEN max_time > 100000 THEN CASE WHEN f > 100000 THEN CASE WHEN max_time > f THEN floor(f / step) * step END ELSE max_time - step END ELSE 0.0 END AS start FROM st) y WHERE start < max_time)"""


@query("hr_told_grid", f"WITH {_CLOCKS_SQL}, {_on_grid_sql('(SELECT client_id, ts AS t, ibi FROM ms) m', _TOLD)}")
def _hr_told_grid(spark, d):
    """Heart rate of recordings whose intervals are in seconds or milliseconds and whose clocks count either, from 0 or absolutely."""
    e = table(spark, d, "events")
    u, i = F.col("user_id"), F.col("event_id")
    clock = F.when(u % 3 == 0, i / 7.0).when(u % 3 == 1, i * 500.0).otherwise(F.lit(1500000000.0) + i * 400.0)
    beats = e.select(u.cast("string").alias("client_id"), clock.alias("ts"), ((F.lit(290) + i * 7919 % 1730) / F.when(u % 2 == 0, F.lit(1.0)).otherwise(F.lit(1000.0))).alias("ibi"))
    found = windows.heart_rate_told(beats, ["client_id"])
    return found.select("client_id", F.round("ts", 4).alias("ts"), r6("hr"))


_PEAKS_SQL = """pk AS (SELECT CAST(user_id AS VARCHAR) AS client_id, CAST(10 AS DOUBLE) * (user_id % 4) + event_id * CAST(0.9 AS DOUBLE) AS t FROM events WHERE event_id % 5 <> 0),
sg AS (SELECT CAST(user_id AS VARCHAR) AS client_id, CAST(10 AS DOUBLE) * (user_id % 4) + event_id * CAST(0.9 AS DOUBLE) AS t FROM events),
rr AS (SELECT client_id, (t + lead(t) OVER w) / 2 AS t, (lead(t) OVER w - t) * 1000 / 50 AS ibi FROM pk WINDOW w AS (PARTITION BY client_id ORDER BY t))"""


@query("hr_from_peaks", f"WITH {_PEAKS_SQL}, {_on_grid_sql('rr', 'gr AS (SELECT client_id, min(t) AS start, CASE WHEN max(t) > 10000 THEN CAST(1000 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS step, CAST(ceil((max(t) - min(t)) / CASE WHEN max(t) > 10000 THEN CAST(1000 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS BIGINT) AS n FROM sg GROUP BY client_id)')}")
def _hr_from_peaks(spark, d):
    """Heart rate from peaks on a grid from the signal's first time; four samples of five stand for peaks, a fiftieth of a second apart each."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("client_id"), "event_id", (F.lit(10.0) * (F.col("user_id") % 4) + F.col("event_id") * 0.9).alias("ts"))
    beats = windows.rr_intervals(e.filter("event_id % 5 <> 0"), ["client_id"]).withColumn("ibi", F.col("ibi") / 50)
    found = windows.heart_rate_on(beats, windows.grid_of_signal(e, ["client_id"]), ["client_id"])
    return found.select("client_id", F.round("ts", 4).alias("ts"), r6("hr"))


_TYPES = ["view", "click", "purchase", "signup", "error"]


@query(
    "merge_all_series",
    f"""WITH {EVENTS_SQL}, se AS (SELECT client_id, 'm' || (event_id % 2) AS method, CAST(floor(seconds / 7200) AS BIGINT) AS frame, var, value, k FROM ev WHERE NOT (var = 'view' AND user_id % 2 = 0)),
o AS (SELECT *, list_position({_TYPES}, var) AS no FROM se), l AS (SELECT client_id, method, min(no) AS lead_no FROM o GROUP BY ALL)
SELECT client_id, method, frame, {", ".join(f"round(min(value) FILTER (var = '{t}'), 6) AS {t}" for t in _TYPES)}, round(min(k) FILTER (no = lead_no), 6) AS context FROM o JOIN l USING (client_id, method) GROUP BY client_id, method, frame""",
)
def _merge_all_series(spark, d):
    """The series of all recordings and methods merged by frame, each with the context of its first series."""
    rows = events(spark, d).filter(~((F.col("var") == "view") & (F.col("user_id") % 2 == 0)))
    series = rows.select("client_id", F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("method"), F.floor(F.col("seconds") / 7200).alias("frame"), "var", "value", F.col("k").alias("context"))
    found = windows.merged_series(series, ["client_id", "method"], "frame", "var", "value", _TYPES, ["context"])
    return found.select("client_id", "method", "frame", *[r6(t) for t in _TYPES], r6("context"))


# --- streams --------------------------------------------------------------------------------------


def _in_files(rows: DataFrame, path: str, no: str, n: int) -> DataFrame:
    """rows written in the order of column no (0 to n - 1), and read as a stream, about one of the n at a time."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for i in range(n):
        rows.filter(F.col(no) == i).drop(no).repartition(tasks).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.drop(no).schema).option("maxFilesPerTrigger", tasks).parquet(path)


@query("stream_runs", f"WITH {INTERVALS_SQL} SELECT client_id, state, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM iv")
def _stream_runs(spark, d):
    """State intervals from a stream of levels that comes in three files, each row up to a quarter of the time late."""
    rows = cut(levels(spark, d).select("client_id", "var", "seconds", F.col("event_id").cast("long").alias("tie"), "level", F.lit(False).alias("last")))
    span = rows.agg(F.max("seconds")).first()[0] or 1.0
    came = F.col("seconds") + F.pmod(F.xxhash64("tie"), F.lit(1000)) / 1000.0 * (span / 4)
    numbered = rows.withColumn("no", F.least(F.floor(came / (span * 1.25) * 3), F.lit(2)).cast("int"))
    ends = rows.select("client_id", "var").distinct().select("client_id", "var", F.lit(0.0).alias("seconds"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast("string").alias("level"), F.lit(True).alias("last"), F.lit(3).alias("no"))
    path = fresh_path(spark, "stream-runs")
    stream = _in_files(cut(numbered.unionByName(ends)), f"{path}/in", "no", 4)
    found = streams.run_to_files(streams.ordered_runs(stream, span, CLOSING), path).filter(F.col("kind") == streams.RUN)
    return found.select("client_id", F.concat_ws("_", "var", "state").alias("state"), r6("start_time"), r6("end_time")).distinct()


@query("stream_windows", f"WITH {EVENTS_SQL} SELECT client_id, var, (w + 1) * CAST(21600 AS DOUBLE) AS seconds, count(value) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM (SELECT *, CAST(floor(seconds / CAST(21600 AS DOUBLE)) AS BIGINT) AS w FROM ev) x GROUP BY client_id, var, w")
def _stream_windows(spark, d):
    """Window features from a stream in three files, in event time with a watermark; a last row far ahead closes the windows that are open."""
    rows = events(spark, d).select("client_id", "var", F.timestamp_micros((F.col("seconds") * 1e6).cast("long")).alias("ts"), "value", (F.col("event_id") % 3).cast("int").alias("no"))
    end = spark.range(1).select(F.lit("end").alias("client_id"), F.lit("end").alias("var"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts"), F.lit(0.0).alias("value"), F.lit(3).alias("no"))
    path = fresh_path(spark, "stream-windows")
    stream = _in_files(cut(rows.unionByName(end)), f"{path}/in", "no", 4)
    found = streams.run_to_files(streams.window_features(stream, ["client_id", "var"], "6 hours", "40 days"), path)
    return found.filter("client_id <> 'end'").select("client_id", "var", F.unix_seconds("window_end").cast("double").alias("seconds"), "n", r6("mean"), r6("max"))
