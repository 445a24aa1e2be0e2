"""A row's place among the rows of its key, without a task for a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronosift.lineage import cut
from chronosift.operators.quantiles import joined


def placed(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """rows with ``name``, from 0, in the order given within equal by (null equal to null).

    The rows are sorted in ranges over the whole table, so that a key of any
    size is dealt out; each range numbers its own rows of a key, and the rows of
    the key in earlier ranges are added. Equal rows have any order.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in by]
    ranged = rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    done = cut(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    per = done.groupBy(*by, "_range").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    offsets = per.select(*by, "_range", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return joined(done, offsets, [*by, "_range"]).withColumn(name, F.col("_seq") - F.col("_first") + F.col("_before")).drop("_range", "_seq", "_first", "_before")
