"""Span ledger: boundary statistics of target tokens over DU tokens within a byte limit, with samples of crossings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.bytestrings import ratio
from spanloom.operators.align import align_tokens, match, match_stats
from spanloom.operators.columns import Numbers
from spanloom.schema import extended


def limited(docs: DataFrame, du: DataFrame, target: DataFrame, max_bytes: int) -> DataFrame:
    """doc_id and the byte limit: the least of raw, both streams and ``max_bytes``."""
    end = lambda t, n: t.groupBy("doc_id").agg(F.max("byte_end").alias(n))
    return docs.select("doc_id", F.octet_length("raw").cast("bigint").alias("raw_len")).join(end(du, "d"), "doc_id", "left").join(end(target, "t"), "doc_id", "left").select(
        "doc_id", F.least("raw_len", F.coalesce("d", F.lit(0)), F.coalesce("t", F.lit(0)), F.lit(max_bytes)).cast("bigint").alias("byte_limit")
    )


def ledger(docs: DataFrame, du: DataFrame, target: DataFrame, max_bytes: int, *, legacy: bool = False) -> DataFrame:
    """One row per document. ``legacy`` counts a token as crossing also where it meets other than one DU token, and rounds."""
    lim = limited(docs, du, target, max_bytes)
    inside = target.join(lim, "doc_id").where(F.col("byte_end") <= F.col("byte_limit")).drop("byte_limit")
    du_in = du.join(lim, "doc_id").where(F.col("byte_end") <= F.col("byte_limit")).groupBy("doc_id").agg(F.count("*").alias("du_tokens"))
    both = F.col("starts_on") & F.col("ends_on")
    crossing = ~both | (F.col("covered") != 1) if legacy else ~both
    a = align_tokens(inside, du).groupBy("doc_id").agg(
        F.count("*").alias("target_tokens"), F.count_if(~crossing).alias("exact"), F.count_if(crossing).alias("cross_or_cut"),
        F.count_if(~F.col("starts_on")).alias("start_inside"), F.count_if(~F.col("ends_on")).alias("end_inside"), F.max("covered").cast("bigint").alias("max_covered"),
    )
    out = lim.join(a, "doc_id", "left").join(du_in, "doc_id", "left").na.fill(0)
    share = ratio(F.col("exact"), F.col("target_tokens"))
    return out.withColumn("fraction_exact", F.round(share, 6) if legacy else share)


def ledger_lengths(views: DataFrame, max_bytes: int, *, legacy: bool = False) -> DataFrame:
    """``ledger`` from one row per document: doc_id, raw_len, and the arrays of byte lengths du and target. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            du, target, out = Numbers(b.column("du")), Numbers(b.column("target")), np.zeros((b.num_rows, 8), np.int64)
            for i, raw_len in enumerate(b.column("raw_len").to_pylist()):
                x, y = du.bounds(i), target.bounds(i)
                limit = min(raw_len, int(x[-1]), int(y[-1]), max_bytes)
                y = y[: int(np.searchsorted(y[1:], limit, "right")) + 1]
                out[i, 0], out[i, 7] = limit, np.searchsorted(x[1:], limit, "right")
                if len(y) > 1:
                    r0, r1, s, e = match(y, x)
                    out[i, 1:7] = match_stats(r0, r1, s, e)
                    if legacy:
                        out[i, 2] = (s & e & (r1 - r0 == 1)).sum()
                        out[i, 3] = len(s) - out[i, 2]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(out[:, j]) for j in range(8)]], ["doc_id", *names])

    names = ["byte_limit", "target_tokens", "exact", "cross_or_cut", "start_inside", "end_inside", "max_covered", "du_tokens"]
    own = views.select("doc_id", "raw_len", "du", "target")
    out = own.mapInArrow(run, extended(own.select("doc_id").schema, ", ".join(f"{n} bigint" for n in names)))
    share = ratio(F.col("exact"), F.col("target_tokens"))
    return out.withColumn("fraction_exact", F.round(share, 6) if legacy else share)


def crossing_samples(du: DataFrame, target: DataFrame, most: int = 80, context: int = 3) -> DataFrame:
    """The first ``most`` crossings of each document in target order, with the range of DU tokens around each."""
    a = align_tokens(target, du).where(~(F.col("starts_on") & F.col("ends_on")))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("left_index"))
    last = du.groupBy("doc_id").agg(F.count("*").alias("n_du"))
    return a.withColumn("sample", n.cast("bigint")).where(F.col("sample") <= most).join(last, "doc_id").select(
        "doc_id", "sample", "left_index", "byte_start", "byte_end", "right_start", "right_end",
        F.greatest(F.col("right_start") - context, F.lit(0)).cast("bigint").alias("context_start"), F.least(F.col("right_end") + context, F.col("n_du")).cast("bigint").alias("context_end"),
    )


def crossing_lengths(views: DataFrame, most: int = 80, context: int = 3) -> DataFrame:
    """``crossing_samples`` from one row per document: doc_id and the arrays of byte lengths du and target; map-only."""
    names = ["sample", "left_index", "byte_start", "byte_end", "right_start", "right_end", "context_start", "context_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            du, target, out, sizes = Numbers(b.column("du")), Numbers(b.column("target")), [np.zeros((0, len(names)), np.int64)], []
            for i in range(b.num_rows):
                x, y = du.bounds(i), target.bounds(i)
                r0, r1, s, e = match(y, x)
                at = np.flatnonzero(~(s & e))[:most]
                lo, hi = r0[at], r1[at]
                out.append(np.stack([np.arange(1, len(at) + 1), at, y[at], y[at + 1], lo, hi, np.maximum(lo - context, 0), np.minimum(hi + context, len(x) - 1)], axis=1))
                sizes.append(len(at))
            rows = np.concatenate(out)
            docs = b.column("doc_id").take(pa.array(np.repeat(np.arange(b.num_rows), sizes)))
            yield pa.RecordBatch.from_arrays([docs, *[pa.array(rows[:, j]) for j in range(len(names))]], ["doc_id", *names])

    own = views.select("doc_id", "du", "target")
    return own.mapInArrow(run, extended(own.select("doc_id").schema, ", ".join(f"{n} bigint" for n in names)))
