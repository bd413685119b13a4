"""Bridge of three streams (source, du, target) of the same documents: alignments, rebuild checks, statistics.

``report_columns`` takes one row per document with its streams' parts as arrays and is map-only. ``report`` gathers token rows
into that form, with one exchange by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.align import STATS, match, match_stats
from spanloom.operators.columns import Numbers, Parts
from spanloom.schema import extended

STREAMS = ("source", "du", "target")
DIRECTIONS = (("source", "du"), ("du", "target"), ("target", "du"))


def first_difference(a: bytes | memoryview, b: bytes | memoryview) -> int | None:
    """The first offset at which two byte strings differ; the shorter one's length if it begins the other; None if equal."""
    if a == b:
        return None
    n = min(len(a), len(b))
    at = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else ()
    return int(at[0]) if len(at) else n


def report_columns(views: DataFrame) -> DataFrame:
    """One row per document: rebuild flags, the first stream that does not rebuild ``raw``, and the three alignments' statistics.

    ``views``: doc_id, raw, and each stream's parts (array of binary) under its name; its span ends under ``NAME_ends``, where
    they are there, else the parts' own lengths count.
    """
    own_ends = {s: f"{s}_ends" in views.columns for s in STREAMS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            parts = {s: Parts(b.column(s)) for s in STREAMS}
            ends = {s: Numbers(b.column(f"{s}_ends")) for s in STREAMS if own_ends[s]}
            size, exact, stats = [], {s: [] for s in STREAMS}, np.zeros((n, len(DIRECTIONS), len(STATS)), np.int64)
            stream, offset = [], []
            for i, v in enumerate(b.column("raw")):
                raw, bounds, bad = v.as_py() or b"", {}, None
                size.append(len(raw))
                for s in STREAMS:
                    built, bounds[s] = parts[s].row(i)
                    if own_ends[s]:
                        bounds[s] = np.concatenate([[0], ends[s].row(i)])
                    at = first_difference(raw, built)
                    exact[s].append(at is None)
                    bad = bad or (None if at is None else (s, at))
                stream.append(bad and bad[0])
                offset.append(bad and bad[1])
                for j, (x, y) in enumerate(DIRECTIONS):
                    if len(bounds[x]) > 1 and len(bounds[y]) > 1:
                        stats[i, j] = match_stats(*match(bounds[x], bounds[y]))
            out = [b.column("doc_id"), pa.array(size, pa.int64()), *[pa.array(exact[s], pa.bool_()) for s in STREAMS], pa.array(stream, pa.string()), pa.array(offset, pa.int64())]
            out += [pa.array(stats[:, j, k]) for j in range(len(DIRECTIONS)) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "raw_len", *[f"{s}_exact" for s in STREAMS], "mismatch_stream", "mismatch_offset", *[f"{x}_to_{y}_{k}" for x, y in DIRECTIONS for k in STATS]]
    kinds = ["bigint", "boolean", "boolean", "boolean", "string", "bigint"] + ["bigint"] * len(DIRECTIONS) * len(STATS)
    own = views.select("doc_id", "raw", *STREAMS, *[f"{s}_ends" for s in STREAMS if own_ends[s]])
    return own.mapInArrow(run, extended(own.select("doc_id").schema, ", ".join(f"{n} {k}" for n, k in zip(names[1:], kinds, strict=True))))


def report(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """``report_columns`` of token rows and ``docs`` (doc_id, raw); a document without tokens of a stream has an empty one."""
    rows = [F.array_sort(F.collect_list(F.when(F.col("stream") == s, F.struct("pos", "byte_end", "bytes")))).alias(s) for s in STREAMS]
    own = docs.select("doc_id", "raw").join(tokens.groupBy("doc_id").agg(*rows), "doc_id", "left")
    field = lambda s, f, kind: F.coalesce(F.transform(s, lambda x: x[f]), F.array().cast(f"array<{kind}>"))
    return report_columns(own.select("doc_id", "raw", *[field(s, "bytes", "binary").alias(s) for s in STREAMS], *[field(s, "byte_end", "bigint").alias(f"{s}_ends") for s in STREAMS]))


def strict(reported: DataFrame) -> DataFrame:
    """The report, failing the query at a document whose streams do not all rebuild it."""
    text = F.concat(F.lit("stream "), F.col("mismatch_stream"), F.lit(" does not rebuild document "), F.col("doc_id").cast("string"), F.lit(", byte "), F.col("mismatch_offset").cast("string"))
    return reported.withColumn("mismatch_stream", F.when(F.col("mismatch_stream").isNotNull(), F.raise_error(text).cast("string")))
