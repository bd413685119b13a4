"""Ordered-scan operators over token rows: bounds, reconstruction, byte ranges, prefix cuts, chunk counts, context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.columns import Parts
from spanloom.schema import extended

KEY = ["doc_id", "stream"]


def ordered(*, frame: bool = False):
    w = Window.partitionBy(*KEY).orderBy("pos")
    return w.rowsBetween(Window.unboundedPreceding, 0) if frame else w


def with_bounds(tokens: DataFrame) -> DataFrame:
    """Running byte bounds from the tokens' bytes alone."""
    end = F.sum(F.octet_length("bytes")).over(ordered(frame=True))
    return tokens.withColumn("byte_end", end.cast("bigint")).withColumn("byte_start", (F.col("byte_end") - F.octet_length("bytes")).cast("bigint"))


def _concat(part) -> F.Column:
    """Ordered binary concatenation of a group: pairs of position and bytes sorted, then joined as hex."""
    return F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex(part).alias("h")))), lambda x: x["h"]), ""))


def reconstruct(tokens: DataFrame) -> DataFrame:
    """doc_id, stream, bytes: the tokens' bytes in order; one document's stream at a time is held."""
    return tokens.groupBy(*KEY).agg(_concat(F.col("bytes")).alias("bytes"))


def reconstruct_range(tokens: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bytes of [lo, hi) per document, cutting inside tokens; null where the range lies outside the stream.

    ``ranges``: doc_id, lo, hi. Only tokens that meet the range are gathered.
    """
    size = tokens.groupBy(*KEY).agg(F.max("byte_end").alias("total"))
    cut = tokens.join(ranges, "doc_id").where((F.col("byte_end") > F.col("lo")) & (F.col("byte_start") < F.col("hi")))
    first = F.greatest(F.col("lo") - F.col("byte_start"), F.lit(0)) + 1
    n = F.least(F.col("byte_end"), F.col("hi")) - F.greatest(F.col("byte_start"), F.col("lo"))
    part = F.substring(F.col("bytes"), first.cast("int"), n.cast("int"))
    got = cut.groupBy(*KEY).agg(_concat(part).alias("bytes"))
    empty = F.unhex(F.lit(""))
    inside = (F.col("lo") >= 0) & (F.col("lo") <= F.col("hi")) & (F.col("hi") <= F.col("total"))
    return size.join(ranges, "doc_id").join(got, KEY, "left").withColumn("bytes", F.when(inside, F.coalesce("bytes", empty))).select(*KEY, "lo", "hi", "bytes")


def reconstruct_parts(views: DataFrame, column: str) -> DataFrame:
    """``reconstruct`` from one row per document: the other columns of ``views``, and bytes, its array ``column`` joined; map-only."""
    kept = [c for c in views.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = Parts(b.column(column))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array([bytes(p.row(i)[0]) for i in range(b.num_rows)], pa.binary())], [*kept, "bytes"])

    return views.select(*kept, column).mapInArrow(run, extended(views.select(*kept).schema, "bytes binary"))


def reconstruct_range_parts(views: DataFrame, column: str) -> DataFrame:
    """``reconstruct_range`` from one row per document: ``views`` has lo, hi and the array ``column`` of parts; map-only.

    Only the parts that meet the range are joined, found by binary search in their bounds.
    """
    kept = [c for c in views.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, out = Parts(b.column(column)), []
            for i, (lo, hi) in enumerate(zip(b.column("lo").to_pylist(), b.column("hi").to_pylist(), strict=True)):
                data, bounds = p.row(i)
                if lo is None or hi is None or not 0 <= lo <= hi <= bounds[-1]:
                    out.append(None)
                    continue
                first, last = int(np.searchsorted(bounds, lo, "right")) - 1, int(np.searchsorted(bounds, hi, "left"))
                out.append(bytes(data[bounds[first] : bounds[last]][lo - int(bounds[first]) :][: hi - lo]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out, pa.binary())], [*kept, "bytes"])

    return views.select(*kept, column).mapInArrow(run, extended(views.select(*kept).schema, "bytes binary"))


def prefix_cut(tokens: DataFrame, max_bytes: int) -> DataFrame:
    """Tokens up to the one that makes the running bytes reach ``max_bytes``; the first token always stays."""
    return tokens.where((F.col("byte_start") < max_bytes) | (F.col("pos") == 0))


def reset_chunks(lengths, target: int):
    """Chunks of an array of byte lengths: the counter resets to zero once it reaches ``target``; a tail counts one."""
    zero = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).cast("bigint").alias("chunks"))
    step = lambda a, n: F.struct(
        F.when(a["held"] + n >= target, F.lit(0).cast("bigint")).otherwise(a["held"] + n).alias("held"),
        (a["chunks"] + F.when(a["held"] + n >= target, F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias("chunks"),
    )
    return F.aggregate(F.transform(lengths, lambda x: x.cast("bigint")), zero, step, lambda a: a["chunks"] + F.when(a["held"] > 0, 1).otherwise(0))


def with_context(tokens: DataFrame, n: int = 3) -> DataFrame:
    """The ids of up to ``n`` tokens on either side of each token, itself included, in order."""
    w = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(-n, n)
    return tokens.withColumn("context", F.collect_list("id").over(w))


def shared_boundary(left: DataFrame, right: DataFrame, least: int, most: int) -> DataFrame:
    """doc_id and the first left boundary >= ``least`` that is a right boundary too; null beyond ``most``."""
    ends = left.where((F.col("byte_end") >= least) & (F.col("byte_end") <= most)).select("doc_id", "byte_end")
    both = ends.join(right.select("doc_id", "byte_end"), ["doc_id", "byte_end"], "left_semi").groupBy("doc_id").agg(F.min("byte_end").alias("boundary"))
    return left.select("doc_id").distinct().join(both, "doc_id", "left")
