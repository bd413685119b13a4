"""Span alignment of two token streams over the same bytes, and its boundary statistics.

``align_tokens`` works on token rows: boundary events of both streams are swept once per document with running window sums,
so the cost is linear where an overlap join would be quadratic in a document's tokens. ``align_lengths``, ``length_stats`` and
``length_spans`` work on per-document arrays of piece lengths and are map-only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.columns import Numbers
from spanloom.schema import extended

ALIGNED = ["doc_id", "left_index", "left_id", "byte_start", "byte_end", "right_start", "right_end", "covered", "starts_on", "ends_on"]


def align_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per left token: the right index range [right_start, right_end) it meets, and whether its ends are boundaries.

    Both streams must be validated partitions of the same bytes (non-empty spans).
    """
    none = F.lit(None).cast("bigint")

    def events(rows: DataFrame, own: list[Column], starts: tuple[int, int], ends: tuple[int, int]) -> DataFrame:
        """Two rows of each token, at its start and its end: c counts right starts, k tells left start, left end and right end."""
        at = lambda p, c, k: F.struct(F.col(p).alias("p"), F.lit(c).alias("c"), F.lit(k).alias("k"))
        both = F.explode(F.array(at("byte_start", *starts), at("byte_end", *ends))).alias("v")
        return rows.select("doc_id", *[c.alias(n) for c, n in zip(own, ("li", "lid", "bs", "be"), strict=True)], both).select("doc_id", "v.*", "li", "lid", "bs", "be")

    l = events(left, [F.col("pos"), F.col("id"), F.col("byte_start"), F.col("byte_end")], (0, 1), (0, 2))
    r = events(right, [none] * 4, (1, 0), (0, 3))
    w = Window.partitionBy("doc_id").orderBy("p")
    seen = F.sum("c").over(w.rangeBetween(Window.unboundedPreceding, 0))
    at = F.sum("c").over(w.rangeBetween(0, 0))
    last = F.max(F.when(F.col("k") == 3, 1).otherwise(0)).over(w.rangeBetween(0, 0))
    swept = l.unionByName(r).withColumns({"seen": seen, "at": at, "last": last}).where("k IN (1, 2)")
    one = F.when(F.col("k") == 1, F.col("seen") - 1)
    two = F.when(F.col("k") == 2, F.col("seen") - F.col("at"))
    on = F.when(F.col("k") == 1, F.col("at") > 0)
    off = F.when(F.col("k") == 2, (F.col("at") > 0) | (F.col("last") == 1))
    # the grouping key extends the window's, so no further exchange is needed
    out = swept.groupBy("doc_id", "li", "lid", "bs", "be").agg(F.max(one).alias("r0"), F.max(two).alias("r1"), F.max(on).alias("s"), F.max(off).alias("e"))
    return out.select(
        "doc_id", F.col("li").alias("left_index"), F.col("lid").alias("left_id"), F.col("bs").alias("byte_start"), F.col("be").alias("byte_end"),
        F.col("r0").alias("right_start"), F.col("r1").alias("right_end"), (F.col("r1") - F.col("r0")).alias("covered"), F.col("s").alias("starts_on"), F.col("e").alias("ends_on"),
    )


def align_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same by an overlap join: quadratic within a document, kept as the plain definition for tests."""
    l, r = left.alias("l"), right.alias("r")
    meets = (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("r.byte_start") < F.col("l.byte_end")) & (F.col("r.byte_end") > F.col("l.byte_start"))
    g = l.join(r, meets).groupBy(F.col("l.doc_id").alias("doc_id"), F.col("l.pos").alias("left_index"), F.col("l.id").alias("left_id"), F.col("l.byte_start").alias("byte_start"), F.col("l.byte_end").alias("byte_end"))
    out = g.agg(F.min("r.pos").alias("right_start"), (F.max("r.pos") + 1).alias("right_end"), F.min("r.byte_start").alias("rs"), F.max("r.byte_end").alias("re"))
    return out.select(*ALIGNED[:7], (F.col("right_end") - F.col("right_start")).alias("covered"), (F.col("rs") == F.col("byte_start")).alias("starts_on"), (F.col("re") == F.col("byte_end")).alias("ends_on"))


def stats_columns(prefix: str = "") -> list[Column]:
    """Aggregates over alignment rows."""
    both = F.col("starts_on") & F.col("ends_on")
    return [
        F.count("*").alias(f"{prefix}tokens"), F.count_if(both).alias(f"{prefix}exact"), F.count_if(~both).alias(f"{prefix}cross_or_cut"),
        F.count_if(~F.col("starts_on")).alias(f"{prefix}start_inside"), F.count_if(~F.col("ends_on")).alias(f"{prefix}end_inside"),
        F.coalesce(F.max("covered"), F.lit(0)).cast("bigint").alias(f"{prefix}max_covered"),
    ]


def boundary_stats(aligned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Boundary statistics per group (per document by default)."""
    return aligned.groupBy(*(by if by is not None else ["doc_id"])).agg(*stats_columns())


def match(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index ranges and flags of one document's left bounds in its right bounds (both sorted, from 0).

    For each left span [s, e): the last right bound <= s, the first one >= e, and whether s and e are right bounds. Of equal
    right bounds (empty tokens), a start meets the last and an end the first.
    """
    r0 = np.searchsorted(right, left[:-1], "right") - 1
    r1 = np.searchsorted(right, left[1:], "left")
    inner = right[np.minimum(r0, len(right) - 1)] == left[:-1]
    outer = right[np.minimum(r1, len(right) - 1)] == left[1:]
    return r0, r1, inner, outer


STATS = ("tokens", "exact", "cross_or_cut", "start_inside", "end_inside", "max_covered")


def match_stats(r0: np.ndarray, r1: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[int, ...]:
    """``STATS`` of a match."""
    if not len(s):
        return (0,) * len(STATS)
    both = s & e
    return len(s), int(both.sum()), int((~both).sum()), int((~s).sum()), int((~e).sum()), int((r1 - r0).max())


def target_du_span(bounds: np.ndarray, start: int, end: int) -> tuple[int, int, int, bool, bool]:
    """(first, last + 1, count, start is a bound, end is a bound) of the tokens with ``bounds`` that the span [start, end) meets."""
    r0, r1, s, e = match(np.array([start, end]), np.asarray(bounds))
    return int(r0[0]), int(r1[0]), int(r1[0] - r0[0]), bool(s[0]), bool(e[0])


def length_stats(views: DataFrame, left: str, right: str, prefix: str = "") -> DataFrame:
    """Boundary statistics per row from two arrays of piece lengths of the same text: map-only, one Arrow pass.

    Adds ``STATS`` columns (with ``prefix``) to ``views`` and drops nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, len(STATS)), np.int64)
            x, y = Numbers(b.column(left)), Numbers(b.column(right))
            for i in range(b.num_rows):
                a, c = x.bounds(i), y.bounds(i)
                if len(a) > 1:
                    out[i] = match_stats(*match(a, c))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(out[:, j]) for j in range(len(STATS))]], [*b.schema.names, *[prefix + n for n in STATS]])

    return views.mapInArrow(run, extended(views.schema, ", ".join(f"{prefix}{n} bigint" for n in STATS)))


def length_spans(views: DataFrame, left: str, right: str) -> DataFrame:
    """One row per left piece from two arrays of piece lengths: pos, lo, hi, starts_on, ends_on, found by binary search; map-only.

    The other columns of ``views`` are repeated, the two arrays are not.
    """
    kept = [c for c in views.columns if c not in (left, right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = Numbers(b.column(left)), Numbers(b.column(right))
            for i in range(0, b.num_rows, 64):
                found = [match(x.bounds(j), y.bounds(j)) for j in range(i, min(i + 64, b.num_rows))]
                sizes = [len(f[0]) for f in found]
                own = b.select(kept).take(pa.array(np.repeat(np.arange(i, i + len(found)), sizes)))
                cols = [pa.array(np.concatenate([f[k] for f in found]).astype(t)) for k, t in enumerate((np.int64, np.int64, bool, bool))]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.concatenate([np.arange(n) for n in sizes]).astype(np.int64)), *cols], [*kept, "pos", "lo", "hi", "starts_on", "ends_on"])

    return views.mapInArrow(run, extended(views.select(*kept).schema, "pos bigint, lo bigint, hi bigint, starts_on boolean, ends_on boolean"))


def align_lengths(views: DataFrame, ids: str, left: str, right: str) -> DataFrame:
    """``align_tokens`` from one row per document: doc_id, the left ids, and two arrays of piece lengths; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, own = Numbers(b.column(left)), Numbers(b.column(right)), Numbers(b.column(ids))
            for i in range(0, b.num_rows, 64):
                rows = range(i, min(i + 64, b.num_rows))
                bounds = [x.bounds(j) for j in rows]
                found = [match(a, y.bounds(j)) for a, j in zip(bounds, rows, strict=True)]
                sizes = [len(f[0]) for f in found]
                r0, r1, s, e = (np.concatenate([f[k] for f in found]) for k in range(4))
                cols = [np.concatenate([np.arange(n) for n in sizes]), np.concatenate([own.row(j) for j in rows]), np.concatenate([a[:-1] for a in bounds]), np.concatenate([a[1:] for a in bounds]), r0, r1, r1 - r0]
                docs = b.column("doc_id").take(pa.array(np.repeat(np.arange(i, i + len(found)), sizes)))
                yield pa.RecordBatch.from_arrays([docs, *[pa.array(c.astype(np.int64)) for c in cols], pa.array(s), pa.array(e)], ALIGNED)

    used = views.select("doc_id", ids, left, right)
    return used.mapInArrow(run, extended(used.select("doc_id").schema, ", ".join(f"{c} bigint" for c in ALIGNED[1:8]) + ", starts_on boolean, ends_on boolean"))
