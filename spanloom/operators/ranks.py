"""Global row numbers and running sums without a single-task sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.schema import extended
from spanloom.scratch import written


def numbered(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """``df`` with ``column`` counting from 0 in ``order``: range partitions are sorted and written, then offset by counts.

    A salt behind ``order`` lets rows that are equal in it, however many, be split over partitions. The driver sees one count
    per partition.
    """
    salted = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    placed = salted.repartitionByRange(*[F.col(c) for c in order], "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    kept = written(placed, "ranks")
    rows, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in kept.groupBy("_part").agg(F.max("_place") + 1).collect()):
        rows.append((part, total))
        total += n
    side = F.broadcast(df.sparkSession.createDataFrame(rows, "_part int, _start bigint"))  # one row per partition
    return kept.join(side, "_part").withColumn(column, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def accumulated(df: DataFrame, order: list[str], size: str, column: str, total: str, *more: tuple[str, str]) -> DataFrame:
    """``numbered`` (``order`` has no ties) with ``total`` beside it, the sum of ``size`` over the rows up to each one.

    ``more``: further pairs of a size and its total.
    """
    pairs = [(size, total), *more]
    placed = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, [0] * len(pairs)
        for b in batches:
            sums = [h + np.cumsum(b.column(s).to_numpy(zero_copy_only=False), dtype=np.int64) for h, (s, _) in zip(held, pairs, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows)), *map(pa.array, sums)], [*b.schema.names, "_place", *own])
            n, held = n + b.num_rows, [int(s[-1]) for s in sums] if b.num_rows else held

    own = [f"_sum{i}" for i in range(len(pairs))]
    kept = written(placed.mapInArrow(run, extended(placed.schema, ", ".join(f"{c} bigint" for c in ("_place", *own)))), "sums")
    rows, first, base = [], 0, [0] * len(pairs)
    for part, n, *ends in sorted(tuple(r) for r in kept.groupBy("_part").agg(F.max("_place") + 1, *[F.max(c) for c in own]).collect()):
        rows.append((part, first, *base))
        first, base = first + n, [b + e for b, e in zip(base, ends, strict=True)]
    starts = [f"_base{i}" for i in range(len(pairs))]
    side = F.broadcast(df.sparkSession.createDataFrame(rows, ", ".join(["_part int", "_first bigint", *[f"{c} bigint" for c in starts]])))  # one row per partition
    sums = {t: F.col(b) + F.col(c) for (_, t), b, c in zip(pairs, starts, own, strict=True)}
    return kept.join(side, "_part").withColumns({column: F.col("_first") + F.col("_place"), **sums}).drop("_part", "_place", *own, "_first", *starts)
