"""Shared helpers: reading tables, settling intermediate results, Arrow kernels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.lineage import shared_folder
from chronosift.shipping import ship

#: Rows in an Arrow batch, and bytes, so that long texts come few at a time.
BATCH_ROWS, BATCH_BYTES = 10_000, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, see ``lineage.shared_folder``."""
    return shared_folder(spark).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files behind settled frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_settled_path", None)
        if path:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer referred to."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Make ready for Arrow kernels: workers get the code, and rows bound a batch's bytes, for documents can be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: A side of at most so many rows of a few numbers, some 16 MB, is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, with a hint to broadcast it if it has few rows; df has rows of a few numbers and is cheap to count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def trim() -> None:
    """Give memory that this worker has freed back to the system: workers are reused, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def map_column(
    df: DataFrame,
    text_col: str,
    fields: T.StructType,
    kernel: Callable[[Iterator[pa.Array]], Iterator[list[pa.Array]]],
    keep: list[str],
) -> DataFrame:
    """Run kernel over the whole texts of df, batch by batch.

    kernel takes the batches' texts as string arrays and yields, for each, one
    array for each of fields. The result has the columns of keep, then fields,
    one row for each row of df. Only keep and the text travel to Python, and the
    text once even if it is in keep.
    """
    small_batches(df.sparkSession)
    others = [c for c in keep if c != text_col]
    body = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(others)], F.col(f"`{text_col}`").cast("string").alias("t"))
    whole = text_col in keep
    kept = [*body.schema.fields[:-1], *([T.StructField("t", T.StringType())] if whole else [])]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + [T.StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)])
    names, n = schema.names, len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.Array]:
            for b in batches:
                held.append(b)
                yield b.column(b.num_columns - 1)

        for arrays in kernel(texts()):
            yield pa.RecordBatch.from_arrays([*held.pop(0).columns[:n], *arrays], names=names)
        trim()

    out = body.mapInArrow(run, schema)
    place = {c: f"k{i}" for i, c in enumerate(others)} | {text_col: "t"}
    return out.select(*[F.col(place[c]).alias(c) for c in keep], *[F.col(f"f{i}").alias(f.name) for i, f in enumerate(fields)])


def map_text(
    df: DataFrame,
    text_col: str,
    fields: T.StructType,
    kernel: Callable[[Iterator[list[bytes | None]]], Iterator[list[pa.Array]]],
    keep: list[str],
) -> DataFrame:
    """map_column with a kernel that takes each batch's texts as a list of UTF-8 bytes, None for null."""

    def as_bytes(batches: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        return kernel(b.cast(pa.binary()).to_pylist() for b in batches)

    return map_column(df, text_col, fields, as_bytes, keep)
