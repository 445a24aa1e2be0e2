"""Order over a whole table: each row's place among the rows of its key, without a task for a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.llm.common import settle, small_batches

_MASK = (1 << 64) - 1


def runs(key: pa.Array) -> np.ndarray:
    """Places where a value differs from the one before it, 0 first; null equals null."""
    codes = key.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    new = np.ones(len(codes), dtype=bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    return np.flatnonzero(new)


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base, from 1, modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def placed(rows: DataFrame, key: str, order: list[Column], label: str, chains: dict[str, int] | None = None) -> DataFrame:
    """rows (whose column key, of an atomic type, parts them) with ``place``, from 0, of each among those of its key.

    The rows are sorted in ranges over the whole table, so that a key of any
    size is dealt out over tasks; a task numbers its own rows, and what earlier
    tasks had of its first key, a row for each task, is added afterwards.

    chains: long columns and odd bases; each becomes a running digest of its
    values up to the row, the sum of value times base ** place modulo 2 ** 64;
    a column more, with ``_before`` in its name, has the digest before the row.
    Rows that are equal in key and order have any order among themselves.
    """
    spark, chains = rows.sparkSession, chains or {}
    small_batches(spark)
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = rows.columns
    added = [*(f"{c}_before" for c in chains), "part", "seq", "place"]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + [T.StructField(c, T.LongType()) for c in added])
    at, bases = names.index(key), {names.index(c): b for c, b in chains.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, place, last = TaskContext.get().partitionId(), 0, 0, None
        sums = dict.fromkeys(bases, 0)
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(at)
            begins = runs(k)
            if seq == 0 or k[0].as_py() != last:
                place, sums = 0, dict.fromkeys(bases, 0)
            ends = np.append(begins[1:], b.num_rows)
            places = np.arange(b.num_rows) - np.repeat(begins, ends - begins)
            columns, befores = list(b.columns), []
            for c, base in bases.items():
                term = columns[c].to_numpy(zero_copy_only=False).view(np.uint64) * powers(base, int((ends - begins).max()))[places]
                term[: ends[0]] *= np.uint64(pow(base, place, 1 << 64))
                total = np.cumsum(term)
                before = total[begins] - term[begins]
                before[0] -= np.uint64(sums[c])
                total -= np.repeat(before, ends - begins)
                columns[c] = pa.array(total.view(np.int64))
                befores.append(pa.array((total - term).view(np.int64)))
                sums[c] = int(total[-1])
            places[: ends[0]] += place
            place, last = int(places[-1]) + 1, k[-1].as_py()
            yield pa.RecordBatch.from_arrays([*columns, *befores, pa.array(np.full(b.num_rows, part)), pa.array(np.arange(seq, seq + b.num_rows)), pa.array(places)], names=names + added)
            seq += b.num_rows

    ordered = rows.repartitionByRange(n, F.col(key).asc_nulls_first(), *order).sortWithinPartitions(F.col(key).asc_nulls_first(), *order)
    done = settle(ordered.mapInArrow(run, schema), label)
    edges = done.groupBy("part").agg(F.min(F.struct("seq", key)).alias("a"), F.max(F.struct("seq", key, "place", *chains)).alias("z")).collect()  # a row for each task
    before: dict[int, tuple] = {}
    open_key, n_before, sums = None, 0, dict.fromkeys(chains, 0)
    for e in sorted(edges, key=lambda e: e["part"]):
        first, z = e["a"][key], e["z"]
        if n_before and first == open_key:
            before[e["part"]] = (first, n_before, [sums[c] for c in chains])
        else:
            n_before, sums = 0, dict.fromkeys(chains, 0)
        if z[key] != first:
            n_before, sums = 0, dict.fromkeys(chains, 0)
        sums = {c: (sums[c] + pow(b, n_before, 1 << 64) * z[c]) & _MASK for c, b in chains.items()}
        open_key, n_before = z[key], n_before + z["place"] + 1
    done = done.drop("seq")
    if not before:
        return done.drop("part")
    moved = [*bases.items(), *((len(names) + i, base) for i, base in enumerate(bases.values()))]
    last = len(names) + len(bases)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            parts, places = b.column(last).to_numpy(), b.column(last + 1).to_numpy().copy()
            values = {c: columns[c].to_numpy(zero_copy_only=False).view(np.uint64).copy() for c, _ in moved}
            for p in np.unique(parts).tolist():
                if p in before:
                    first, n_more, more = before[p]
                    own = b.column(at)
                    mine = (parts == p) & (own.is_null() if first is None else pc.fill_null(pc.equal(own, pa.scalar(first, own.type)), False)).to_numpy(zero_copy_only=False)
                    places[mine] += n_more
                    for (c, base), s in zip(moved, more * 2, strict=True):
                        values[c][mine] = values[c][mine] * np.uint64(pow(base, n_more, 1 << 64)) + np.uint64(s)
            for c, v in values.items():
                columns[c] = pa.array(v.view(np.int64))
            yield pa.RecordBatch.from_arrays([*columns[:last], pa.array(places)], names=out.names)

    out = T.StructType([*schema.fields[:last], schema.fields[-1]])
    return done.mapInArrow(add, out)
