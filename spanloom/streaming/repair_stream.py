"""Append repair as keyed streaming state: each conversation's token ids grow turn by turn.

State is the snapshot (bytes, ids, span ends). An append drops the tokens that a bounded look-ahead could change, tokenizes the
tail with the new bytes and splices; earlier tokens are never tokenized again. Turns of one micro-batch are taken in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.functions.tokenizers import Tokenizer, parts_of

OUT = "conv_id bigint, turn bigint, n_tokens bigint, n_bytes bigint, dropped bigint, fresh bigint, ids_sha256 string"
STATE = "raw binary, ids array<bigint>, ends array<bigint>"


def append(tok: Tokenizer, raw: bytes, ids: list[int], ends: list[int], delta: bytes, drop: int | None) -> tuple[list[int], list[int], int, int]:
    """(ids, ends, dropped, fresh). ``drop``: tokens to drop, or None for those that start within the tokenizer's horizon."""
    if drop is None:
        keep = len(ids)
        while keep and ends[keep - 1] > len(raw) - tok.horizon:
            keep -= 1
    else:
        keep = max(0, len(ids) - drop)
    start = ends[keep - 1] if keep else 0
    fresh = tok.encode(raw[start:] + delta)
    new_ids, new_ends, at = ids[:keep], ends[:keep], start
    for p in parts_of(tok, fresh):
        at += len(p)
        new_ends.append(at)
    return new_ids + fresh, new_ends, len(ids) - keep, len(fresh)


def repair_stream(turns: DataFrame, tokenizer: Tokenizer, drop: int | None = None) -> DataFrame:
    """A streaming frame of OUT rows, one per turn, from streaming ``turns`` (conv_id, turn, text)."""
    given = turns.sparkSession.sparkContext.broadcast(tokenizer)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        from spanloom.sources.sinks import pack_u32
        import hashlib

        raw, ids, ends = state.get if state.exists else (b"", [], [])
        raw, ids, ends = bytes(raw), list(ids), list(ends)
        out = []
        for r in pd.concat(list(frames)).sort_values("turn").itertuples():
            delta = (r.text or "").encode("utf-8")
            ids, ends, dropped, fresh = append(given.value, raw, ids, ends, delta, drop)
            raw += delta
            out.append((key[0], r.turn, len(ids), len(raw), dropped, fresh, hashlib.sha256(pack_u32(ids)).hexdigest()))
        state.update((raw, ids, ends))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return turns.groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(turns: DataFrame, tokenizer: Tokenizer, out: str, checkpoint: str, drop: int | None = None) -> DataFrame:
    """Run what is available as micro-batches into Parquet and return it as a batch frame."""
    q = repair_stream(turns, tokenizer, drop).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return turns.sparkSession.read.schema(OUT).parquet(out)
