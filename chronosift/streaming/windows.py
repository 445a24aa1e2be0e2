"""The window and run-length operators on streams.

Window features are watermarked aggregations. State runs keep one open run for
each (client, variable) and emit a run when it closes, with
``applyInPandasWithState``; rows of a key must arrive in order of time within
the watermark's delay, later ones are dropped. ``ordered_runs`` waits for rows
that come late by up to a delay, and emits those that come later still beside
the runs; it reads all keys of a batch by windows, and keeps its state in files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronosift.shipping import ship


def window_features(stream: DataFrame, by: list[str], width: str, delay: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """by, window_end, n, mean, min, max of tumbling windows, each emitted once the watermark has passed it."""
    w = F.window(F.col(ts), width)
    agg = stream.withWatermark(ts, delay).groupBy(w, *by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return agg.select(*by, F.col("window.end").alias("window_end"), "n", "mean", "min", "max")


def state_runs(stream: DataFrame, closing: float = 30.0, timeout_ms: int = 3_600_000) -> DataFrame:
    """client_id, var, state, start_time, end_time of (client_id, var, seconds, level) rows.

    A run is emitted when its level changes or is null; one that is open when
    its key has been silent for the timeout ends closing seconds after its last
    row.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        client, var = key
        level, start, last = state.get if state.exists else (None, None, None)
        done = []
        if state.hasTimedOut:
            if level is not None:
                done.append((client, var, level, start, last + closing))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seconds", kind="stable")
            for seconds, new in zip(rows["seconds"], rows["level"], strict=True):
                if last is not None and seconds < last:
                    continue
                new = None if pd.isna(new) else new
                if new != level:
                    if level is not None and start < seconds:
                        done.append((client, var, level, start, float(seconds)))
                    level, start = new, float(seconds)
                last = float(seconds)
            state.update((level, start, last))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(done, columns=["client_id", "var", "state", "start_time", "end_time"])

    ship(stream.sparkSession)
    return stream.groupBy("client_id", "var").applyInPandasWithState(update, "client_id string, var string, state string, start_time double, end_time double", "level string, start double, last double", "append", "ProcessingTimeTimeout")


#: What a row of ordered_runs is, and what is kept between batches: rows that wait, and each key's open run.
RUN, LATE = "run", "late"
HELD, OPEN = "held", "open"
_KEPT = "kind string, client_id string, var string, seconds double, tie bigint, level string, at double, seen double"


@dataclass(frozen=True)
class OrderedRuns:
    """Runs of a stream as ``run_to_files`` writes them."""

    stream: DataFrame
    delay: float
    closing: float


def ordered_runs(stream: DataFrame, delay: float, closing: float = 30.0) -> OrderedRuns:
    """kind, client_id, var, state, start_time, end_time of (client_id, var, seconds, tie, level, last) rows.

    Rows of a key are held until its latest time is ``delay`` seconds beyond
    them, and then read in order of time and tie, so that the runs are those of
    the batch operator. A row older than what has been read is late: it comes out
    as it is (kind late, its time as start and end). A row whose ``last`` is true ends its
    key: all held rows are read, and an open run ends closing seconds after
    the last one. What is held for a key are the rows of the delay; rows without a time are in no run.
    """
    return OrderedRuns(stream, delay, closing)


def _step(batch: DataFrame, kept: DataFrame, delay: float, closing: float) -> DataFrame:
    """kind, client_id, var, seconds, tie, level, at, seen, end_time: what a batch and what is kept give, runs and late rows as well as what is kept from then on.

    All keys at once, by windows over one order of each. An open row has the
    open run's level and start (seconds), the time read last (at) and the latest seen.
    """
    new = batch.filter("last OR seconds IS NOT NULL").select("client_id", "var", F.col("seconds").cast("double").alias("seconds"), F.col("tie").cast("long").alias("tie"), "level", F.coalesce("last", F.lit(False)).alias("last"))
    rows = new.withColumn("kind", F.lit(HELD)).unionByName(kept.withColumn("last", F.lit(False)), allowMissingColumns=True)
    whole = Window.partitionBy("client_id", "var")
    rows = rows.withColumns({"_over": F.max("last").over(whole), "_at": F.max("at").over(whole)}).filter("NOT last")
    late = (F.col("kind") == HELD) & F.coalesce(F.col("seconds") < F.col("_at"), F.lit(False))
    rows = rows.withColumn("kind", F.when(late, F.lit(LATE)).otherwise(F.col("kind")))
    rows = rows.withColumn("_seen", F.max(F.greatest(F.when(F.col("kind") == HELD, F.col("seconds")), "seen")).over(whole))
    read = (F.col("kind") == OPEN) | ((F.col("kind") == HELD) & (F.col("_over") | (F.col("seconds") < F.col("_seen") - F.lit(float(delay)))))
    # Open rows go first; rows that are not read are a part of their own, so that a run is told from rows that are.
    part, among = Window.partitionBy("client_id", "var", "_read"), Window.partitionBy("client_id", "var", "_read").orderBy("_no", "seconds", "tie")
    rows = rows.withColumns({"_read": read, "_no": (F.col("kind") != OPEN).cast("int")}).withColumns({
        "_first": (F.row_number().over(among) == 1) | ~F.col("level").eqNullSafe(F.lag("level").over(among)),
        "_to": F.max(F.greatest("at", F.when(F.col("kind") == HELD, F.col("seconds")))).over(part),
    }).filter("_first OR NOT _read")
    rows = rows.withColumn("_next", F.lead("seconds").over(among))
    opened = F.col("_read") & F.col("_next").isNull()
    closed = F.struct(F.lit(RUN).alias("kind"), "seconds", "level", F.coalesce("_next", F.col("_to") + F.lit(float(closing))).alias("end_time"), F.lit(None).cast("double").alias("at"), F.lit(None).cast("double").alias("seen"))
    still = F.struct(F.lit(OPEN).alias("kind"), F.when(~F.col("_over"), F.col("seconds")).alias("seconds"), F.when(~F.col("_over"), F.col("level")).alias("level"), F.lit(None).cast("double").alias("end_time"), F.col("_to").alias("at"), F.col("_seen").alias("seen"))
    asis = F.struct("kind", "seconds", "level", F.col("seconds").alias("end_time"), F.lit(None).cast("double").alias("at"), F.lit(None).cast("double").alias("seen"))
    out = F.when(~F.col("_read"), F.array(asis)).when(~opened, F.array(closed)).when(F.col("_over"), F.array(closed, still)).otherwise(F.array(still))
    found = rows.select("client_id", "var", "tie", F.explode(out).alias("_o")).select("client_id", "var", "tie", "_o.*")
    return found.filter((F.col("kind") != RUN) | (F.col("level").isNotNull() & (F.col("seconds") < F.col("end_time"))))


def run_to_files(stream: DataFrame | OrderedRuns, path: str) -> DataFrame:
    """All there is of a stream, written as Parquet below path and read again; the query ends when its source is read."""
    if isinstance(stream, OrderedRuns):
        return _ordered_to_files(stream, path)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def _ordered_to_files(runs: OrderedRuns, path: str) -> DataFrame:
    """A batch is one Spark job over its rows and what is kept, whose result takes the place of the last but one; a batch that is run again overwrites what it wrote."""
    schema = "kind string, client_id string, var string, state string, start_time double, end_time double"

    def step(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        kept = spark.read.schema(_KEPT).parquet(f"{path}/step/{(no + 1) % 2}").filter(F.col("kind").isin(HELD, OPEN)) if no else spark.createDataFrame([], _KEPT)
        _step(batch, kept, runs.delay, runs.closing).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("kind").parquet(f"{path}/step/{no % 2}")
        done = spark.read.schema(f"{_KEPT}, end_time double").parquet(f"{path}/step/{no % 2}").filter(F.col("kind").isin(RUN, LATE))
        done.select("kind", "client_id", "var", F.col("level").alias("state"), F.col("seconds").alias("start_time"), "end_time").write.mode("overwrite").parquet(f"{path}/out/batch={no}")

    spark = runs.stream.sparkSession
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/out/batch=-1")  # there is something to read without a batch, too
    query = runs.stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out/batch=*")
