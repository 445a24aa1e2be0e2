import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronosift.functions import exprs
from chronosift.operators import kernels, windows


def test_window_statistics(spark):
    rows = [("p", 0.0, 1.0), ("p", 4.9, 3.0), ("p", 5.0, 7.0), ("p", 12.0, None), ("p", 12.5, float("nan"))]
    df = spark.createDataFrame(rows, "p string, ts double, value double")
    got = {r.seconds: (r.n, r["mean"], r["std"]) for r in windows.window_stats(df, ["p"], 5.0).collect()}
    assert got == {5.0: (2, 2.0, pytest.approx(math.sqrt(2))), 10.0: (1, 7.0, 0.0), 15.0: (0, None, None)}


def test_range_join_equals_brute_force(spark):
    rng = random.Random(1)
    samples = [(rng.choice("ab"), float(rng.randrange(100))) for _ in range(200)]
    spans = [(rng.choice("ab"), i, float(s), float(s + rng.randrange(0, 40))) for i, s in enumerate(rng.choices(range(90), k=40))]
    s, p = spark.createDataFrame(samples, "k string, ts double"), spark.createDataFrame(spans, "k string, i int, start double, end double")
    for bucket in (3.0, 50.0):
        got = sorted((r.k, r.ts, r.i) for r in windows.range_join(s, p, ["k"], bucket).collect())
        assert got == sorted((k, t, i) for k, t in samples for q, i, a, b in spans if q == k and a <= t < b)


def test_heart_rate_grid_interpolates(spark):
    rows = [("c", 0.5, 1000.0), ("c", 2.5, 500.0), ("c", 3.0, 5000.0), ("c", 6.0, 750.0)]
    df = spark.createDataFrame(rows, "c string, ts double, ibi double")
    got = {r.ts: r.hr for r in windows.heart_rate_grid(df, ["c"]).collect()}
    t, h = [0.5, 2.5, 6.0], [60.0, 120.0, 80.0]
    assert got == pytest.approx({float(k): float(np.interp(k, t, h)) for k in range(1, 7)})


def test_variability_of_intervals(spark):
    rng = np.random.default_rng(2)
    ibi = rng.uniform(350, 1500, 40).tolist() + [100.0]
    df = spark.createDataFrame([("c", float(i), x) for i, x in enumerate(ibi)] + [("d", 0.0, 800.0)], "c string, ts double, ibi double")
    (r,) = windows.hrv_time_domain(df, ["c"]).collect()
    x = np.array(ibi[:-1])
    d = np.diff(x)
    want = {"hrv_mean_nn": x.mean(), "hrv_sdnn": x.std(ddof=1), "hrv_rmssd": math.sqrt((d**2).mean()), "hrv_sdsd": d.std(ddof=1), "hrv_median_nn": np.median(x), "hrv_iqrnn": np.subtract(*np.percentile(x, [75, 25])), "hrv_pnn50": 100 * (abs(d) > 50).mean(), "hrv_mad_nn": 1.4826 * np.median(abs(x - np.median(x)))}
    assert {k: r[k] for k in want} == pytest.approx(want)


def test_annotation_windows_positional_and_nearest(spark):
    a = spark.createDataFrame([("p", 5.0 * i, float(i), 1.0) for i in range(1, 9)], "p string, seconds double, arousal double, valence double")
    got = [(r.start, r.end, r.arousal) for r in windows.annotation_windows(a, ["p"], 3).orderBy("start").collect()]
    assert got == [(0.0, 15.0, 2.0), (15.0, 30.0, 5.0)]
    x = spark.createDataFrame([("p", i) for i in range(5)], "p string, a int")
    y = spark.createDataFrame([("p", 10 * i) for i in range(3)], "p string, b int")
    assert sorted((r.sec, r.a, r.b) for r in windows.positional_join(x, y, ["p"], "a", "b").collect()) == [(1, 0, 0), (2, 1, 10), (3, 2, 20)]
    left = spark.createDataFrame([("p", t) for t in (0.0, 1.4, 1.5, 9.0)] + [("q", 1.0)], "p string, t double")
    right = spark.createDataFrame([("p", 1.0, "a"), ("p", 2.0, "b")], "p string, at double, v string")
    assert {(r.p, r.t): r.v for r in windows.nearest(left, right, ["p"], "t", "at", "v").collect()} == {("p", 0.0): "a", ("p", 1.4): "a", ("p", 1.5): "a", ("p", 9.0): "b", ("q", 1.0): None}


def test_filters_have_their_responses():
    fs, t = 100.0, np.arange(0, 10, 0.01)
    for f, kind, cut in ((1.0, "low", 5.0), (20.0, "high", 5.0), (10.0, "band", (5.0, 15.0))):
        y = kernels.filtered(np.sin(2 * np.pi * f * t), 2, cut, fs, kind)
        assert np.ptp(y[200:-200]) == pytest.approx(2, abs=0.12)
    assert np.ptp(kernels.filtered(np.sin(2 * np.pi * 40 * t), 2, 5.0, fs, "low")[200:-200]) < 0.01
    b, a = kernels.butter(2, 10.0, fs, "low")
    h = lambda w: abs(np.polyval(b[::-1], np.exp(-1j * w)) / np.polyval(a[::-1], np.exp(-1j * w)))
    assert h(0) == pytest.approx(1) and h(2 * np.pi * 10 / fs) == pytest.approx(1 / math.sqrt(2), rel=1e-6)


def test_peaks_and_spectrum(spark):
    x = np.array([0, 1, 0, 2, 2, 0, 3, 0.0])
    assert kernels.find_peaks(x).tolist() == [1, 3, 6] and kernels.find_peaks(x, height=2).tolist() == [3, 6] and kernels.find_peaks(x, distance=4).tolist() == [1, 6]
    fs, t = 50.0, np.arange(0, 20, 0.02)
    f, p = kernels.welch(np.sin(2 * np.pi * 5 * t), fs, 200)
    assert f[p.argmax()] == pytest.approx(5, abs=0.26) and kernels.band_power(f, p, 4, 6) == pytest.approx(0.5, rel=0.05)
    beat = np.exp(-(((t % 0.8) - 0.4) ** 2) / 0.002)
    ibi = kernels.plausible_ibi(kernels.pulse_peaks(beat, fs), fs)
    assert len(ibi) > 15 and np.median(ibi) == pytest.approx(800, abs=25)
    assert np.median(kernels.plausible_ibi(kernels.ecg_peaks(beat, fs), fs)) == pytest.approx(800, abs=60)
    slow = kernels.hrv_spectrum(800 + 50 * np.sin(2 * np.pi * 0.1 * np.arange(300) * 0.8))
    assert slow["hrv_lf"] > 20 * slow["hrv_hf"] and slow["hrv_lfn"] + slow["hrv_hfn"] == pytest.approx(1)
    assert math.isnan(kernels.hrv_spectrum(np.array([800.0] * 5))["hrv_lf"]) and kernels.skin_features(np.array([]), None, None, 4.0)["eda_peaks"] == 0.0


def test_both_resolutions_are_null_in_each_other(spark):
    fast, slow = spark.createDataFrame([("p", 5.0, 1.0)], "p string, seconds double, eda_mean double"), spark.createDataFrame([("p", 30.0, 2.0)], "p string, seconds double, temp_mean double")
    rows = {r.window_type: r for r in windows.both_resolutions(fast, slow).collect()}
    assert rows["fast"].temp_mean is None and rows["slow"].eda_mean is None


def test_peak_helpers_against_plain_loops():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 17, 200):
        for _ in range(30):
            x = rng.integers(0, 6, n).astype(float)
            maxima, i = [], 1
            while i < n - 1:
                j = i
                while j < n - 1 and x[j + 1] == x[i]:
                    j += 1
                if x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]:
                    maxima.append((i + j) // 2)
                i = j + 1
            assert kernels.local_maxima(x).tolist() == maxima
            for p, got in zip(maxima, kernels.prominences(x, np.array(maxima, dtype=int)) if maxima else [], strict=True):
                a = max([k for k in range(p) if x[k] > x[p]], default=0)
                b = min([k for k in range(p + 1, n) if x[k] > x[p]], default=n - 1)
                assert got == x[p] - max(x[a : p + 1].min(), x[p : b + 1].min())


def test_least_lengths_of_signals():
    x = np.sin(np.arange(4000) / 8.0)
    assert len(kernels.ecg_peaks(x[:399], 200.0)) == 0 and len(kernels.ecg_peaks(x, 8.0)) == 0
    assert len(kernels.pulse_peaks(x[:15], 8.0)) == 0 and len(kernels.pulse_peaks(x[:64], 8.0)) > 0


def test_recordings_without_plausible_beats_keep_their_points(spark):
    beats = spark.createDataFrame([("a", 1.0, 600.0), ("a", 3.0, 1000.0), ("b", 1.0, 9.0)], "c string, ts double, ibi double")
    grids = spark.createDataFrame([(c, 0.0, 1.0, 4) for c in "abc"], "c string, start double, step double, n long")
    got = {(r.c, r.ts): r.hr for r in windows.heart_rate_on(beats, grids, ["c"]).collect()}
    assert got == {**{("a", t): h for t, h in zip((0.0, 1.0, 2.0, 3.0), (None, 100.0, 80.0, 60.0), strict=True)}, **{(c, float(t)): None for c in "bc" for t in range(4)}}


def test_points_that_meet_a_beat_but_for_rounding(spark):
    start, step = 0.1, 0.1
    times = sorted({start + k * step for k in range(0, 60, 2)})
    beats = spark.createDataFrame([("a", t, 1000.0 - 3 * i) for i, t in enumerate(times)], "c string, ts double, ibi double")
    grids = spark.createDataFrame([("a", start, step, 59)], "c string, start double, step double, n long")
    got = {r.ts: r.hr for r in windows.heart_rate_on(beats, grids, ["c"]).collect()}
    assert all(got[t] == 60000.0 / (1000.0 - 3 * i) for i, t in enumerate(times))


def test_heart_rate_windows_equal_those_of_the_points(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([0.5, 1.0, 3.7]) * i + rng.random(), rng.uniform(250, 2100)) for c in "abcd" for i in range(80)] + [("e", 4.0, 700.0), ("f", 1.2, 1000.0), ("f", 900.0, 1000.0)]
    df = spark.createDataFrame(rows, "c string, ts double, ibi double")
    for width, step in ((10.0, 1.0), (7.5, 0.1), (100.0, 3.0)):
        want = {(r.c, r.seconds): (r.hr_mean, r.hr_std) for r in windows.hr_window_features(windows.heart_rate_grid(df, ["c"], step=step), ["c"], width).collect()}
        got = {(r.c, r.seconds): (r.hr_mean, r.hr_std) for r in windows.heart_rate_windows(df, ["c"], width, step=step).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_beats_of_a_grid_are_dealt_out_once(spark):
    rows = [("c", 0.5, 1000.0), ("c", 2.5, 400.0), ("c", 2.5, 600.0), ("c", 6.0, 750.0), ("c", None, 800.0), ("d", 3.0, 600.0), ("d", 3.0, 300.0)]
    df = spark.createDataFrame(rows, "c string, ts double, ibi double")
    grid = windows.heart_rate_grid(df, ["c"])
    assert exchanges(grid) == 1
    want = {("c", float(k)): float(np.interp(k, [0.5, 2.5, 6.0], [60.0, 125.0, 80.0])) for k in range(1, 7)} | {("d", 3.0): 100.0}
    assert sorted((r.c, r.ts) for r in grid.collect()) == sorted(want) and {(r.c, r.ts): r.hr for r in grid.collect()} == pytest.approx(want)


def test_windows_of_beats_far_apart_are_not_aggregated(spark):
    rows = [("c", 0.5, 1000.0), ("c", 3.2, 400.0), ("c", 3.2, 600.0), ("c", 4.1, 750.0), ("c", 40_000.5, 500.0), ("c", 40_001.0, 600.0), ("c", 40_009.0, 700.0), ("c", None, 800.0), (None, -7.0, 600.0), (None, 35.0, 900.0), ("d", -3.0, 600.0), ("e", 0.2, 600.0), ("e", 0.4, 700.0)]
    df = spark.createDataFrame(rows, "c string, ts double, ibi double")
    for width, step in ((10.0, 1.0), (1.0, 3.0), (0.7, 0.1)):
        found = windows.heart_rate_windows(df, ["c"], width, step=step)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert exchanges(found) == 1 and plan.count("Sort [") == 1 and "Aggregate" not in plan
        want = {(r.c, r.seconds): (r.hr_mean, r.hr_std) for r in windows.hr_window_features(windows.heart_rate_grid(df, ["c"], step=step), ["c"], width).collect()}
        got = [(r.c, r.seconds, r.hr_mean, r.hr_std) for r in found.collect()]
        assert len(got) == len(want) and all(x[2:] == pytest.approx(want[x[:2]], abs=1e-6) for x in got)


def test_told_heart_rate_takes_one_exchange_and_no_join(spark):
    rng, rows = random.Random(5), [("i", 3.0, 0.8), ("j", 1.5e6, 5.0), (None, 1.0, 0.9), (None, 2.0, 0.9)]
    for c, origin, rate, unit in (("a", 0.0, 1.0, 1.0), ("b", 0.0, 700.0, 0.001), ("d", 1.5e9, 900.0, 1.0), ("e", 90_000.0, 800.0, 0.001), ("f", 250_000.0, 650.0, 1.0), ("g", 0.0, 90.0, 1.0), ("h", -50.0, 2.0, 0.001)):
        rows += [(c, origin + rate * (i + rng.random()), rng.uniform(250, 2100) * unit) for i in range(60)]
    rows += [("k", 7.0, 600.0), ("k", 7.0, 900.0), ("l", 7.0, 600.0), ("l", 7.0, 900.0), ("l", 9.0, 700.0)]
    df = spark.createDataFrame(rows, "c string, ts double, ibi double")
    told = windows.heart_rate_told(df, ["c"])
    assert exchanges(told) == 1 and "Join" not in told._jdf.queryExecution().executedPlan().toString()
    beats = df.join(windows.first_ibi_mean(df, ["c"]), "c").withColumn("ibi", F.col("ibi") * F.col("factor"))
    grids = windows.grid_of_beats(beats.filter(exprs.valid_ibi(F.col("ibi"))).select("c", "ts").distinct(), beats.groupBy("c").agg(F.max("ts").alias("max_time")), ["c"])
    want, got = ([(r.c, r.ts, r.hr) for r in x.collect()] for x in (windows.heart_rate_on(beats, grids, ["c"]), told))
    assert {c for c, _, _ in want} == set("abdefghl") and len(got) == len(want) == len({x[:2] for x in want})
    assert {x[:2]: x[2] for x in got} == pytest.approx({x[:2]: x[2] for x in want})
