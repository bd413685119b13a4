"""Token rows from any tokenizer, and the check whether tokenizing lexeme by lexeme gives the direct ids. Map-only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.bytestrings import valid_prefix_len
from spanloom.functions.tokenizers import Tokenizer, parts_of
from spanloom.schema import TOKENS, extended

CACHE = 200_000


def records(docs: DataFrame, tokenizer: Tokenizer, stream: str, max_bytes: int | None = None) -> DataFrame:
    """Token rows of each text's UTF-8 bytes (``docs``: doc_id, text), which the tokens must rebuild exactly.

    With ``max_bytes`` only the longest prefix of whole characters within it is tokenized.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    if max_bytes is not None:
        raw = F.substring(raw, F.lit(1), valid_prefix_len(raw, F.lit(max_bytes)).cast("int"))
    given = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, v in zip(b.column("doc_id"), b.column("raw"), strict=True):
                whole, ids = v.as_py(), given.value.encode(v.as_py())
                parts, ends, at = parts_of(given.value, ids), [], 0
                for p in parts:
                    at += len(p)
                    ends.append(at)
                if b"".join(parts) != whole:
                    raise ValueError(f"tokens do not rebuild document {doc.as_py()}")
                n = len(ids)
                starts = [e - len(p) for e, p in zip(ends, parts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * n, pa.int64()), pa.array([stream] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "stream", "pos", "id", "byte_start", "byte_end", "bytes"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), raw.alias("raw")).mapInArrow(run, TOKENS)


def lexeme_equivalence(docs: DataFrame, tokenizer: Tokenizer, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text) with n_direct, n_lexemes (ids of both ways), equal, and the first diverging index."""
    given = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in batches:
            out = []
            for v in b.column("text"):
                text, by = v.as_py() or "", []
                for p in re.findall(pattern, text):
                    if p not in known:
                        if len(known) > CACHE:
                            known.clear()
                        known[p] = given.value.encode(p.encode("utf-8"))
                    by += known[p]
                direct = given.value.encode(text.encode("utf-8"))
                at = next((i for i in range(max(len(by), len(direct))) if by[i : i + 1] != direct[i : i + 1]), None)
                out.append((len(direct), len(by), at is None, at))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], [*b.schema.names, "n_direct", "n_lexemes", "equal", "diverges_at"])

    return docs.mapInArrow(run, extended(docs.schema, "n_direct bigint, n_lexemes bigint, equal boolean, diverges_at bigint"))
