"""Table shapes. Order is semantic here, so every stream row carries its position."""

from __future__ import annotations

from pyspark.sql import types as T

TOKENS = "doc_id bigint, stream string, pos bigint, id bigint, byte_start bigint, byte_end bigint, bytes binary"
TOKEN_JSONL = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("byte_start", T.LongType(), False),
    T.StructField("byte_end", T.LongType(), False), T.StructField("bytes_hex", T.StringType(), False),
])
HEADER = "doc_id bigint, stream string, name string, provenance string, raw_sha256 string, raw_len bigint"
VOCAB = "id bigint, bytes binary"
LEXEMES = "gid bigint, bytes binary"
SPAN = "struct<id:bigint,byte_start:bigint,byte_end:bigint,bytes_hex:string>"
SPAN_RECORD = "struct<source_id:bigint,source_hex:string,du_ids:array<bigint>,exact:boolean>"
SNAPSHOT = f"doc_id bigint, prefix binary, prefix_len bigint, prefix_sha256 string, native_ids array<bigint>, native_spans array<{SPAN}>, du_state struct<ids:array<bigint>,parts:array<binary>,bounds:array<bigint>>"


def extended(schema: T.StructType, more: str) -> T.StructType:
    """``schema`` with the DDL columns ``more`` behind it."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])
