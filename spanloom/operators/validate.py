"""Validation of token streams: errors as rows, first failure wins by position; ``strict`` raises instead.

Rows are checked in the order of ``pos`` (ordering by offset would hide overlaps). Error codes, by precedence at one token:
``overlap`` or ``gap`` (start before or after the expected one), ``reversed``, ``empty``, ``beyond``, ``bytes``; then
``trailing`` for bytes behind the last token. Header checks come before all: ``raw_len``, ``raw_sha256``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.bytestrings import sha256
from spanloom.operators.columns import Parts, sliced

REPORT = ["doc_id", "stream", "error_code", "error_pos", "detail"]


def header_errors(headers: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, stream and header_error (raw_len, raw_sha256, missing document, or null). ``docs``: doc_id, raw."""
    own = docs.select("doc_id", F.octet_length("raw").cast("bigint").alias("_len"), sha256(F.col("raw")).alias("_sha"))
    error = F.when(F.col("_len").isNull(), "document").when(F.col("raw_len") != F.col("_len"), "raw_len").when(F.col("raw_sha256") != F.col("_sha"), "raw_sha256")
    return headers.join(own, "doc_id", "left").select("doc_id", "stream", error.alias("header_error"))


def same_bytes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pair identity of two streams' headers per document: equal raw_len and raw_sha256."""
    r = right.select("doc_id", F.col("raw_len").alias("r_len"), F.col("raw_sha256").alias("r_sha"))
    return left.join(r, "doc_id", "full").select("doc_id", F.coalesce((F.col("raw_len") == F.col("r_len")) & (F.col("raw_sha256") == F.col("r_sha")), F.lit(False)).alias("same_bytes"))


def _first_error(raw: bytes, start: np.ndarray, end: np.ndarray, built: memoryview, bounds: np.ndarray, pos: np.ndarray) -> tuple[str | None, int | None, int | None]:
    """(code, pos, detail) of one stream's first error; whole arrays are compared before any single token is.

    ``built``: the tokens' bytes, joined, and their ``bounds``.
    """
    expected = np.concatenate([[0], end[:-1]])
    wrong = (start != expected) | (end <= start) | (end > len(raw))
    n = int(wrong.argmax()) if wrong.any() else len(start)
    size = np.diff(bounds[: n + 1])
    if (size != end[:n] - start[:n]).any() or built[: bounds[n]] != raw[: int(end[n - 1]) if n else 0]:
        for i in range(n):
            here, part = raw[start[i] : end[i]], bytes(built[bounds[i] : bounds[i + 1]])
            if here != part:
                m = min(len(here), len(part))
                at = next((k for k in range(m) if here[k] != part[k]), m)
                return "bytes", int(pos[i]), at
    if n < len(start):
        by = int(start[n] - expected[n])
        code = "overlap" if by < 0 else "gap" if by > 0 else "reversed" if end[n] < start[n] else "empty" if end[n] == start[n] else "beyond"
        return code, int(pos[n]), by if by else None
    last = int(end[-1]) if len(end) else 0
    return ("trailing", None, len(raw) - last) if last < len(raw) else (None, None, None)


def token_errors(tokens: DataFrame, docs: DataFrame, streams: tuple[str, ...] | None = None) -> DataFrame:
    """One row per document and stream with its first error, or nulls. A document without tokens is valid only if empty.

    A document's tokens are gathered into one row per stream and meet its bytes there, so the bytes are not repeated for every
    token. ``streams``: the names; without them ``tokens`` is read once more to find them.
    """
    names = streams or [r[0] for r in tokens.select("stream").distinct().orderBy("stream").collect()]  # as many as streams are named
    every = docs.select("doc_id", "raw", F.explode(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")).alias("stream"))
    own = tokens.groupBy("doc_id", "stream").agg(F.array_sort(F.collect_list(F.struct("pos", "byte_start", "byte_end", "bytes"))).alias("t"))

    return gathered_errors(every.join(own, ["doc_id", "stream"], "left"))


def gathered_errors(rows: DataFrame) -> DataFrame:
    """``token_errors`` of streams that are gathered already: doc_id, stream, raw and t (``views.gathered``); map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "raw"):
            rows, offsets = b.column("t"), b.column("t").offsets.to_numpy()
            flat = {f: rows.values.field(f) for f in ("pos", "byte_start", "byte_end", "bytes")}
            number = {f: flat[f].to_numpy(zero_copy_only=False) for f in ("pos", "byte_start", "byte_end")}
            parts, out = Parts(pa.ListArray.from_arrays(rows.offsets, flat["bytes"])), []
            for i, raw in enumerate(b.column("raw")):
                own, (built, bounds) = slice(offsets[i], offsets[i + 1]), parts.row(i)
                out.append(_first_error(raw.as_py() or b"", number["byte_start"][own], number["byte_end"][own], built, bounds, number["pos"][own]))
            cols = [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("stream"), *cols], REPORT)

    return rows.select("doc_id", "stream", "raw", "t").mapInArrow(run, "doc_id bigint, stream string, error_code string, error_pos bigint, detail bigint")


def strict(report: DataFrame) -> DataFrame:
    """The report, failing the query at its first error."""
    bad = F.concat(F.lit("invalid stream "), F.col("stream"), F.lit(" of document "), F.col("doc_id").cast("string"), F.lit(": "), F.col("error_code"))
    return report.withColumn("error_code", F.when(F.col("error_code").isNotNull(), F.raise_error(bad).cast("string")))


def arrays_error(ids, parts, bounds):
    """Structure error of the columnar form (ids, parts, bounds with a leading 0), or null."""
    sums = F.aggregate(
        F.sequence(F.lit(0), F.size(parts) - 1), F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(True).alias("ok")),
        lambda a, i: F.struct(
            (a["at"] + F.octet_length(F.element_at(parts, i + 1))).alias("at"),
            (a["ok"] & (a["at"] + F.octet_length(F.element_at(parts, i + 1)) == F.element_at(bounds, i + 2))).alias("ok"),
        ),
        lambda a: a["ok"],
    )
    return (
        F.when(F.size(ids) != F.size(parts), "ids").when(F.size(bounds) != F.size(parts) + 1, "bounds")
        .when(F.try_element_at(bounds, F.lit(1)) != 0, "first").when((F.size(parts) > 0) & ~sums, "sum")
    )


def csr_error(offsets, payload, entries):
    """Structure error of imported offsets over a payload of ``payload`` ids, or null."""
    rising = F.forall(F.zip_with(F.slice(offsets, 1, F.size(offsets) - 1), F.slice(offsets, 2, F.size(offsets) - 1), lambda a, b: a <= b), lambda x: x)
    return (
        F.when(F.size(offsets) != entries + 1, "count").when(F.element_at(offsets, 1) != 0, "first")
        .when((F.size(offsets) > 1) & ~rising, "order").when(F.element_at(offsets, -1) != payload, "last")
    )


def u32_ok(id_):
    return (id_ >= 0) & (id_ < (1 << 32))
