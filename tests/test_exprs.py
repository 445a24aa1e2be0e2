import math

import pytest
from pyspark.sql import functions as F

from chronosift.functions import exprs


def values(spark, rows, schema, **columns):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_levels_are_half_open_and_the_top_is_closed(spark):
    rows = [(x,) for x in (-0.1, 0.0, 0.329, 0.33, 0.66, 0.998, 0.9995, 1.0, 1.5, None, float("nan"))]
    got = [r["l"] for r in values(spark, rows, "v double", l=exprs.level_cut(exprs.known(F.col("v"))))]
    assert got == [None, "low", "low", "medium", "high", "high", "high", "high", "high", None, None]
    simple = [r["l"] for r in values(spark, rows[:5], "v double", l=exprs.level_cut_simple(F.col("v")))]
    assert simple == ["low", "low", "low", "medium", "high"]


def test_relation_is_total_and_symmetric(spark):
    spans = [(a, b) for a in range(4) for b in range(a + 1, 5)]
    rows = [(*map(float, x), *map(float, y)) for x in spans for y in spans]
    got = values(spark, rows, "a double, b double, c double, d double", r=exprs.interval_relation(*map(F.col, "abcd")), q=exprs.interval_relation(*map(F.col, "cdab")))
    for (a, b, c, d), r in zip(rows, got, strict=True):
        if a > c:
            (a, b), (c, d) = (c, d), (a, b)
        want = ("b" if b < c else "m" if b == c else "o" if b < d else "fi" if b == d else "c") if a < c else "=" if b == d else "s" if b < d else "fi"
        assert r["r"] == want
        assert a == c or r["q"] == want


def test_demographics(spark):
    rows = [("19",), ("24.9",), ("25",), ("39",), ("40",), ("100",), ("x",), (None,)]
    got = [r["g"] for r in values(spark, rows, "a string", g=exprs.age_group(F.col("a")))]
    assert got == ["19-19", "20-24", "25-29", "35-39", "40+", "Unknown", "Unknown", "Unknown"]
    got = [r["g"] for r in values(spark, [(" male ",), ("WOMAN",), ("2",), ("?",), (None,)], "a string", g=exprs.clean_gender(F.col("a")))]
    assert got == ["M", "F", "F", None, None]
    got = [r["m"] for r in values(spark, [("25-29",), ("x",), ("30",)], "a string", m=exprs.band_midpoint(F.col("a")))]
    assert got == [27.0, None, None]


def test_pattern_and_rule_text(spark):
    rows = [(["a_x"], [], "(a_x)"), (["a_x", "b_y"], ["o"], "a_x overlaps b_y"), (["a_x", "b_y", "c_z"], ["b", "m", "fi"], "a_x before b_y AND a_x meets c_z AND b_y is-finished-by c_z")]
    for r in values(spark, rows, "s array<string>, r array<string>, w string", t=exprs.pattern_text(F.col("s"), F.col("r")), w=F.col("w")):
        assert r["t"] == r["w"]
    sig = "(hr_low) => hr_low before eda_high AND hr_low contains temp_low"
    got = values(spark, [(sig,)], "s string", states=exprs.signature_states(F.col("s")), n=exprs.relation_count_size(F.col("s")), w=exprs.rule_words(F.col("s")))[0]
    assert got["states"] == ["hr_low", "hr_low", "eda_high", "hr_low", "temp_low"] and got["n"] == 3
    assert got["w"].startswith("If (**hr_low** (low heart rate)), then ") and "*precedes*" in got["w"]


def test_filters(spark):
    cases = [(["hr_low", "hrv_sdnn_high"], True, False, True, False), (["eda_low", "eda_peaks_high"], False, True, True, False), (["arousal_low", "hr_low"], False, False, False, False), (["emo_sad", "temp_low"], False, False, True, False), (["hr_low", "hr_high"], True, False, True, True), ([], False, False, False, False)]
    s = F.col("s")
    for r, c in zip(values(spark, [(c[0],) for c in cases], "s array<string>", h=exprs.heart_only(s), e=exprs.skin_only(s), n=exprs.not_cross(s), f=exprs.single_feature(s)), cases, strict=True):
        assert (r["h"], r["e"], r["n"], r["f"]) == c[1:]


def test_circumplex_and_calibration(spark):
    a, v = exprs.circumplex({e: F.col(e) for e in ("Happy", "Angry")})
    r = values(spark, [(100.0, None), (0.0, 100.0), (None, None)], "Happy double, Angry double", a=a, v=v)
    assert [(x["a"], x["v"]) for x in r] == [(0.75, 1.0), (1.0, 0.0), (0.5, 0.5)]
    r = values(spark, [(3.0,)], "v double", e=exprs.calibrate("ecg", F.col("v")), j=exprs.calibrate("joystick", F.col("v") * 0 - 26225))[0]
    assert math.isclose(r["e"], 4.0) and r["j"] == pytest.approx(0.5)


def test_pattern_matrix(spark):
    rows = [(["a"], []), (["a", "b"], ["m"]), (["a", "b", "c", "d"], ["1", "2", "3", "4", "5", "6"])]
    found = spark.createDataFrame(rows, "s array<string>, r array<string>").select(exprs.pattern_matrix(F.col("s"), F.col("r")).alias("t")).collect()
    assert found[0].t == "<a>"
    assert found[1].t == "States: ['a', 'b']\nRelations:\n  ['=', 'm']\n  ['-', '=']"
    assert found[2].t.split("\n")[2:] == ["  ['=', '1', '2', '3']", "  ['-', '=', '4', '5']", "  ['-', '-', '=', '6']", "  ['-', '-', '-', '=']"]
