import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronosift.functions import exprs
from chronosift.operators import intervals as iv
from chronosift.operators import relations


def brute(rows):
    """client and relation of all pairs, one by one."""
    out, by = Counter(), {}
    for c, s, e in rows:
        by.setdefault(c, []).append((s, e))
    for c, found in by.items():
        found.sort()
        for i, (s1, e1) in enumerate(found):
            for s2, e2 in found[i + 1 :]:
                if s1 < s2:
                    out[c, "b" if e1 < s2 else "m" if e1 == s2 else "o" if e1 < e2 else "fi" if e1 == e2 else "c"] += 1
                else:
                    out[c, "=" if e1 == e2 else "s"] += 1
    return out


def sequences(seed):
    rng = random.Random(seed)
    rows = [(c, float(s), float(s + rng.choice([0, 1, 1, 2, 5, 9, 30, -2]))) for c in ("a", "b", None) for s in (rng.randrange(60) for _ in range(120))]
    return rows + [("same", 1.0, 2.0)] * 40 + [("alone", 0.0, 1.0)]


@pytest.mark.parametrize("whole", [50_000, 7, 1])
def test_counts_equal_all_pairs(spark, monkeypatch, whole):
    """Clients counted whole, and cut into blocks of few values; equal intervals, and such of no or negative length, among them."""
    monkeypatch.setattr(relations, "WHOLE", whole)
    rows = sequences(whole)
    df = spark.createDataFrame([(c, "x", s, e) for c, s, e in rows], "client_id string, state string, start_time double, end_time double").repartition(4)
    got = {(r.client_id, r.relation): r.n for r in iv.relation_counts(df).collect()}
    assert got == dict(brute(rows))


def test_a_long_client(spark):
    """A hundred thousand intervals of one client, five thousand million pairs: blocks, and one task, tell the same."""
    n = 100_000
    rows = spark.range(n).select(F.lit("hot").alias("client_id"), F.lit("x").alias("state"), (F.col("id") * 7919 % n).cast("double").alias("start_time"))
    rows = rows.withColumn("end_time", F.col("start_time") + 1 + F.col("start_time") * 31 % 500)
    got = {r.relation: r.n for r in iv.relation_counts(rows).collect()}
    start = np.arange(n, dtype=float)
    end = start + 1 + start * 31 % 500
    assert got == {k: v for k, v in relations.counted(start, end, np.ones(n, dtype=np.int64)).items() if v}
    assert sum(got.values()) == n * (n - 1) // 2
    # Starts are whole numbers from 0, each once: an interval meets the one that starts where it ends, if there is one, and is before all later ones.
    assert got["m"] == int((end < n).sum()) and got["b"] == int(np.maximum(n - 1 - end, 0).sum())


def test_words(spark):
    rows = sequences(3)[:50]
    df = spark.createDataFrame([(c, "x", s, s + 3) for c, s, e in rows], "client_id string, state string, start_time double, end_time double")
    got = {(r.client_id, r.relation) for r in iv.relation_counts(df, checked=True).collect()}
    assert got <= {(c, w) for c in ("a", "b") for w in exprs.RELATIONS.values()} and got
    first = iv.relation_counts(df, checked=True, first=5).agg(F.sum("n")).first()[0]
    assert first == 5
