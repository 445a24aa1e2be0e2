"""Streams of files against the batch operators."""

import random

from pyspark.sql import functions as F

from chronosift.operators import intervals as iv
from chronosift.operators import sessions
from chronosift.streaming import windows as streams

SCHEMA = "client_id string, var string, seconds double, tie long, level string, last boolean"


def written(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_runs_wait_for_late_rows_and_tell_of_those_that_are_later(spark, tmp_path):
    row = lambda s, level, tie=0: ("c", "v", float(s), tie, level, False)
    first = [row(0, "a"), row(5, "a"), row(20, "b"), row(21, "b")]
    second = [row(12, "c"), row(30, None), row(4, "late"), row(21, "a", 1), row(3, None)]  # 4 and 3 are behind what has been read by then
    third = [row(60, "a"), ("c", "v", 0.0, 0, None, True)]
    found = streams.run_to_files(streams.ordered_runs(written(spark, tmp_path, first, second, third), 10.0, 2.0), str(tmp_path)).collect()
    late = sorted((r.state or "", r.start_time) for r in found if r.kind == streams.LATE)
    assert late == [("", 3.0), ("late", 4.0)]
    kept = [x for x in first + second + third[:1] if x[2] not in (3.0, 4.0)]
    batch = iv.runs(spark.createDataFrame(kept, SCHEMA), ["client_id", "var"], "level", "seconds", ["tie"], 2.0).collect()
    assert sorted((r.state, r.start_time, r.end_time) for r in found if r.kind == streams.RUN) == sorted((r.level, r.start_time, r.end_time) for r in batch)


def plain_runs(batches, delay, closing):
    """ordered_runs, a key and batch at a time."""
    kept, out = {}, []
    for rows in batches:
        for key in {x[:2] for x in rows}:
            level, start, at, held = kept.get(key, (None, None, None, []))
            own = [x[2:] for x in rows if x[:2] == key]
            over = any(x[3] for x in own)
            own = [x for x in own if not x[3] and x[0] is not None]
            late = [x for x in own if at is not None and x[0] < at]
            out += [("late", *key, x[2], x[0], x[0]) for x in late]
            held = sorted(held + [x for x in own if x not in late], key=lambda x: x[:2])
            ready = [x for x in held if over or x[0] < held[-1][0] - delay]
            for seconds, _, new, _ in ready:
                if new != level:
                    out += [("run", *key, level, start, seconds)] if level is not None and start < seconds else []
                    level, start = new, seconds
                at = seconds
            if over and level is not None:
                out += [("run", *key, level, start, at + closing)] if start < at + closing else []
            kept[key] = (None if over else level, None if over else start, at, held[len(ready) :])
    return out


def test_ordered_runs_read_all_keys_of_a_batch_at_once(spark, tmp_path):
    rng, tie = random.Random(8), iter(range(10_000))
    batches = [[(f"c{rng.randrange(6)}" if rng.random() < 0.95 else None, rng.choice("xy"), float(10 * i + rng.randrange(25)), next(tie), rng.choice(["a", "b", "b", None]), False) for _ in range(90)] for i in range(5)]
    # One key ends early and goes on, one has rows without a time, one nothing but its end.
    batches[1] += [("c0", "x", 0.0, 0, None, True)]
    batches[2] += [("c1", "y", None, next(tie), "a", False), ("none", "x", 0.0, 0, None, True)]
    batches[4] += [(c, v, 0.0, 0, None, True) for c in [*(f"c{i}" for i in range(6)), None] for v in "xy"]
    for delay, closing in ((12.0, 2.0), (0.0, 0.0), (100.0, 5.0)):
        path = tmp_path / f"{delay}"
        found = streams.run_to_files(streams.ordered_runs(written(spark, path, *batches), delay, closing), str(path)).collect()
        assert sorted(map(tuple, found), key=str) == sorted(plain_runs(batches, delay, closing), key=str)
    kept = spark.createDataFrame([], streams._KEPT)
    plan = streams._step(spark.createDataFrame(batches[0], SCHEMA), kept, 12.0, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and plan.count("Exchange ") == 1 and "Join" not in plan


def test_sessions_without_a_common_time_have_no_window(spark):
    rows = [("s", "label", 0.0, 1.0), ("s", "label", 25.0, 3.0), ("s", "x", 4.0, None), ("s", "x", 13.0, 8.0), ("only", "label", 0.0, 1.0), ("apart", "label", 0.0, 1.0), ("apart", "x", 9.0, 1.0), (None, "label", 1.0, 5.0), (None, "x", 0.0, 5.0), (None, "label", 12.0, 7.0)]
    df = spark.createDataFrame(rows, "session string, source string, ts double, value double")
    b = sessions.bounds(df, ["session"], ["label"], ["x"])
    assert sorted(map(tuple, b.collect()), key=str) == [("s", 4.0, 25.0), (None, 1.0, 12.0)]
    got = sessions.session_windows(df, b, ["session"], 10.0, ["label", "x"]).collect()
    assert sorted(((r.session, r.window, r.seconds, r.label_n, r.label_mean, r.x_n, r.x_mean) for r in got), key=str) == [("s", 0, 14.0, 0, None, 1, 8.0), ("s", 1, 24.0, 0, None, 0, None), (None, 0, 11.0, 1, 5.0, 0, None)]
    assert sessions.session_windows(df.limit(0), b.limit(0), ["session"], 10.0, ["x"]).count() == 0


def test_chained_labels_end_at_the_nearest_sample(spark):
    samples = spark.createDataFrame([("c", float(t)) for t in (0, 4, 9, 10, 20, 31)] + [("d", 1.0)], "client string, ts double")
    segments = spark.createDataFrame([("c", 1, "x", 7.0), ("c", 2, "y", 6.5), ("c", 3, "z", 100.0), ("c", 4, "w", 1.0)], "client string, no int, label string, duration double")
    got = {(r.client, r.ts): r.label for r in sessions.chained_labels(samples, segments, ["client"]).collect()}
    # x is due at 7: of 4 and 9 the nearer is 9; y at 15.5, nearer to 20 than to 10; z ends with the last sample, and nothing is left for w.
    assert got == {("c", 0.0): "x", ("c", 4.0): "x", ("c", 9.0): "x", ("c", 10.0): "y", ("c", 20.0): "y", ("c", 31.0): "z", ("d", 1.0): None}
    none = sessions.chained_labels(samples, segments.limit(0), ["client"])
    assert none.filter(F.col("label").isNotNull()).count() == 0 and none.count() == 7
