"""Connected components by alternating star operations; links stay distributed.

Up to ONE_TASK links, whose size is thereby bounded to some MB, one task finds
them instead, which saves many short stages; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.llm.common import forget, settle


def _large_star(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows."""
    n = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return n.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


#: Links (of 16 bytes) that one task takes.
ONE_TASK = 1_000_000


def labels_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, ascending, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        after = low.copy()
        np.minimum.at(after, low[x], least)
        np.minimum.at(after, low[y], least)
        after = np.minimum(after, after[after])
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, low):
            return nodes, nodes[low]
        low = after


def _in_one_task(e: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, low = labels_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], names=["node", "comp"])

    return e.select("u", "v").coalesce(1).mapInArrow(run, "node long, comp long")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node that has an edge; comp is the smallest node of its component."""
    e = settle(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    if e.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return _in_one_task(e)
    state = None
    while True:
        after = settle(_small_star(_large_star(e)), "edges")
        forget(e)
        e = after
        row = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(row) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        state = tuple(row)
