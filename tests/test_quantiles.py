import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronosift.operators import quantiles as q


def linear(values, p):
    values = sorted(values)
    x = p * (len(values) - 1)
    lo, hi = values[math.floor(x)], values[math.ceil(x)]
    return lo + (hi - lo) * (x - math.floor(x))


@pytest.mark.parametrize(("limit", "steps"), [(1, 64), (20, 16), (10**6, 512)])
def test_quantiles_equal_sorted_values(spark, monkeypatch, limit, steps):
    monkeypatch.setattr(q, "STEPS", steps)
    monkeypatch.setattr(q, "ACCURACY", 10 if steps == 16 else 10_000)
    rng = random.Random(limit)
    keys = {
        "even": [rng.random() for _ in range(300)],
        "steep": [10.0 ** rng.uniform(-300, 300) * rng.choice([1, -1]) for _ in range(200)],
        "widest": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0],
        "ties": [0.5] * 100 + [0.25] * 3 + [0.75] * 60,
        "one": [3.0],
        "two": [1.0, 2.0],
        None: [float(i % 7) for i in range(90)],
    }
    rows = [(k, v) for k, vs in keys.items() for v in vs] + [("none", None), ("two", None)]
    rng.shuffle(rows)
    probabilities = (0.0, 0.33, 0.5, 0.67, 1.0)
    got = {r.k: r for r in q.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", probabilities, limit).collect()}
    assert set(got) == set(keys)
    for k, vs in keys.items():
        assert got[k].n == len(vs)
        for p, x in zip(probabilities, got[k].p, strict=True):
            want = linear(vs, p)
            assert x == pytest.approx(want, rel=1e-12) or (k == "widest" and not np.isfinite(want))


def test_no_task_holds_a_variable(spark):
    """Ten million distinct values of one variable: the plan has no buffer of values, and a window only over what is left in a bucket."""
    n = 10_000_000
    rows = spark.range(n).select(F.lit("x").alias("k"), ((F.col("id") * 7919) % n / F.lit(4.0)).alias("v"))
    found = q.quantiles(rows, ["k"], "v", (0.33, 0.67))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.split("Union")[-1].lower()
    assert [round(x, 6) for x in found.first().p] == [round(p * (n - 1) / 4, 6) for p in (0.33, 0.67)]


def test_empty(spark):
    assert q.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", (0.5,)).collect() == []
