"""Deterministic token views of documents, written as regular expressions that Java, Python and RE2 read alike.

A view cuts each text into pieces that partition its bytes. ``tokens`` makes the general row table; the map-only operators
of ``align`` work on per-document arrays of bounds instead and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.columns import Numbers
from spanloom.schema import extended

#: Pieces: runs of white space and of anything else; words with one space before; at most N characters.
LEXEMES = r"[^ \t\n\r]+|[ \t\n\r]+"
WORDS = r" ?[^ \t\n\r]+|[ \t\n\r]+"


def cap(n: int) -> str:
    return rf"(?s).{{1,{n}}}"


def pieces(text: Column, pattern: str) -> Column:
    """Array of the view's pieces; empty for a null or empty text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def parts(text: Column, pattern: str) -> Column:
    """The bytes of the view's pieces, as an array."""
    return F.transform(pieces(text, pattern), lambda p: F.encode(p, "UTF-8"))


def tokens(docs: DataFrame, key: str, pattern: str, stream: str) -> DataFrame:
    """Token rows (doc_id, stream, pos, id, byte_start, byte_end, bytes); the id is a hash of the bytes below 2^31.

    Map-only: the bounds are summed up within a document's row before it is spread out, so no token row is moved.
    """
    own = docs.select(F.col(key).alias("doc_id"), lengths(F.col("text"), pattern).alias("_n"), F.col("text").alias("_text"))
    rows = ended(own, "_n", "_ends").select("doc_id", "_ends", F.posexplode(parts(F.col("_text"), pattern)).alias("pos", "bytes"))
    end = F.get("_ends", F.col("pos"))
    return rows.select(
        "doc_id", F.lit(stream).alias("stream"), F.col("pos").cast("bigint").alias("pos"), id_of(F.col("bytes")).alias("id"), (end - F.octet_length("bytes")).alias("byte_start"), end.alias("byte_end"), "bytes"
    )


def gathered(docs: DataFrame, key: str, pattern: str, stream: str) -> DataFrame:
    """``tokens`` (without ids) as one row per document: doc_id, stream, the other columns of ``docs``, and t, the array of
    pos, byte_start, byte_end and bytes; empty for an empty text. Map-only."""
    more = [c for c in docs.columns if c not in (key, "text")]
    own = docs.select(F.col(key).alias("doc_id"), F.lit(stream).alias("stream"), *more, F.col("text").alias("_text"), lengths(F.col("text"), pattern).alias("_n"))
    end = lambda i: F.get("_ends", i)
    token = lambda x, i: F.struct(i.cast("bigint").alias("pos"), (end(i) - F.octet_length(x)).alias("byte_start"), end(i).alias("byte_end"), x.alias("bytes"))
    return ended(own, "_n", "_ends").select("doc_id", "stream", *more, F.transform(parts(F.col("_text"), pattern), token).alias("t"))


def ended(rows: DataFrame, sizes: str, ends: str) -> DataFrame:
    """``rows`` with ``ends``, the running sums of each row's array ``sizes``, in its place; map-only."""
    kept = [c for c in rows.columns if c != sizes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Numbers(b.column(sizes))
            at = n.rows - n.rows[0]
            sums = np.concatenate([[0], np.cumsum(n.values[n.rows[0] : n.rows[-1]], dtype=np.int64)])
            own = sums[1:] - np.repeat(sums[at[:-1]], np.diff(at))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(own))], [*kept, ends])

    return rows.select(*kept, sizes).mapInArrow(run, extended(rows.select(*kept).schema, f"{ends} array<bigint>"))


def id_of(b: Column) -> Column:
    """A declarative token id: the first 31 bits of the bytes' SHA-256."""
    return F.conv(F.substring(F.sha2(b, 256), 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF))


def lengths(text: Column, pattern: str) -> Column:
    """Byte lengths of the pieces, as an array."""
    return F.transform(pieces(text, pattern), lambda p: F.octet_length(p))


def from_records(records: DataFrame, stream: str) -> DataFrame:
    """Token rows from native records: doc_id, pos, id, byte_start, byte_end, bytes_hex. Digits that are no hex give null bytes,
    which no validation passes; other columns are ignored."""
    from spanloom.functions.bytestrings import from_hex

    own = [F.col(c).cast("bigint").alias(c) for c in ("pos", "id", "byte_start", "byte_end")]
    return records.select("doc_id", F.lit(stream).alias("stream"), *own, from_hex(F.col("bytes_hex")).alias("bytes"))


def from_loaded(loaded: DataFrame, stream: str) -> DataFrame:
    """Token rows from columnar streams: doc_id and the arrays ids, parts, bounds (with a leading 0), as they stand.

    The arrays are not checked here: ``validate.arrays_error`` does, and what is missing gives nulls.
    """
    part = lambda a, i: F.try_element_at(a, i + 1)
    rows = loaded.select("doc_id", "ids", "bounds", F.posexplode("parts").alias("pos", "bytes"))
    return rows.select(
        "doc_id", F.lit(stream).alias("stream"), F.col("pos").cast("bigint").alias("pos"), part(F.col("ids"), F.col("pos")).alias("id"),
        part(F.col("bounds"), F.col("pos")).alias("byte_start"), part(F.col("bounds"), F.col("pos") + 1).alias("byte_end"), "bytes",
    )
