import random

from pyspark.sql import functions as F

from chronosift.operators import intervals as iv


def naive_runs(rows, closing):
    """rows of one key: (seconds, label) in order."""
    out, cur, start = [], None, None
    for t, s in rows:
        if s != cur:
            if cur is not None and start < t:
                out.append((cur, start, t))
            cur, start = s, t
    if cur is not None:
        out.append((cur, start, rows[-1][0] + closing))
    return out


def test_runs_equal_naive_loop(spark):
    rng = random.Random(1)
    rows = [(f"c{c}", float(rng.randrange(30)), i, rng.choice(["a", "b", None])) for c in range(5) for i in range(25)]
    df = spark.createDataFrame(rows, "client string, seconds double, i int, label string")
    got = sorted((r.client, r.label, r.start_time, r.end_time) for r in iv.runs(df, ["client"], "label", "seconds", ["i"]).collect())
    want = []
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2]))
        want += [(c, *x) for x in naive_runs([(r[1], r[3]) for r in own], 30.0)]
    assert got == sorted(want)


def test_null_rows_close_runs_and_the_last_is_extended(spark):
    """Features of another resolution are null in a row and so cut the run."""
    rows = [("c", 0.0, "x"), ("c", 5.0, "x"), ("c", 30.0, None), ("c", 35.0, "x")]
    got = [tuple(r)[1:] for r in iv.runs(spark.createDataFrame(rows, "client string, t double, l string"), ["client"], "l", "t", []).collect()]
    assert sorted(got, key=lambda r: r[1]) == [("x", 0.0, 30.0), ("x", 35.0, 65.0)]


def test_minmax_cases(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0), ("b", 2.0), ("b", None), ("c", 9.0)]
    df = spark.createDataFrame(rows, "c string, value double")
    got = {c: sorted(map(str, [r.u for r in df.withColumn("u", iv.personal_minmax(df, ["c"])).collect() if r.c == c])) for c in "abc"}
    assert got == {"a": ["0.0", "1.0", "None"], "b": ["0.5", "0.5", "0.5"], "c": ["None"]}


def test_frames_with_nulls_never_merge(spark):
    rows = [("c", 1, "x", 1), ("c", 2, "x", 1), ("c", 3, None, 1), ("c", 4, None, 1), ("c", 5, "x", 1)]
    df = spark.createDataFrame(rows, "c string, FrameMillis int, e string, k int")
    got = sorted((r.StartTime, r.EndTime, r.e) for r in iv.frame_runs(df, ["c"], ["e", "k"]).collect())
    assert got == [(1, 2, "x"), (3, 3, None), (4, 4, None), (5, 5, "x")]


def test_state_intervals_of_a_feature_table(spark):
    rng = random.Random(2)
    rows = [(f"p{p}", float(5 * i), float(rng.randint(1, 9)) if i % 4 else None, rng.random() * 10 if i % 3 else None, rng.random()) for p in range(4) for i in range(30)]
    wide = spark.createDataFrame(rows, "client_id string, seconds double, arousal double, eda_mean double, hr_mean double")
    long = iv.to_long(wide, ["client_id", "seconds"], ["eda_mean"])
    cut = iv.global_terciles(long, ["client_id"], ["var"])
    got = iv.state_intervals(wide, cut, (1.0, 9.0))
    p = cut.first()
    states = {r.state for r in got.collect()}
    assert states <= {f"{f}_{x}" for f in ("arousal", "eda", "hr") for x in ("low", "medium", "high")} and {s.split("_")[0] for s in states} == {"arousal", "eda", "hr"}
    want = set()
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        vals = [r[3] for r in own if r[3] is not None]
        lo, hi = min(vals), max(vals)
        unit = [None if r[3] is None else (r[3] - lo) / (hi - lo) for r in own]
        level = [None if u is None else "low" if u < p.p33 else "medium" if u < p.p67 else "high" for u in unit]
        want |= {(c, f"eda_{s}", a, b) for s, a, b in naive_runs([(r[1], x) for r, x in zip(own, level, strict=True)], 30.0)}
    assert {tuple(r) for r in got.filter(F.col("state").startswith("eda")).collect()} == want


def test_validation(spark):
    rows = [("c", "s", 1.0, 2.0), ("c", "s", 1.0, 2.0), ("c", "s", 3.0, 3.0), ("d", "t", -1.0, 2.0)]
    r = iv.validate(spark.createDataFrame(rows, "client_id string, state string, start_time double, end_time double")).first()
    assert (r.n_rows, r.n_clients, r.n_states, r.n_empty, r.n_negative, r.n_duplicates, r.valid) == (4, 2, 2, 1, 1, 1, False)


def test_thresholds_do_not_bring_a_variable_into_one_task(spark):
    wide = spark.createDataFrame([("a", float(i), float(i)) for i in range(5)], "client_id string, seconds double, hr_mean double")
    cuts = spark.createDataFrame([("hr_mean", 0.3, 0.6)], "var string, p33 double, p67 double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = iv.state_intervals(wide, cuts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [var" in plan and "hashpartitioning(var#" not in plan
