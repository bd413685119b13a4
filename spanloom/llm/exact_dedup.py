"""Exact dedup by a minimal perfect hash over the distinct digests of a history.

Rows are first combined within their partition: one row per digest with its largest doc_id and its count, so a common text
sends one row per partition and no more. ``build_index`` deals the history's digests into shards by hash and builds one
hash-and-displace minimal perfect hash per shard: a digest is sent to a bucket, the bucket's pilot to a slot, and n digests
fill exactly the slots 0 to n - 1. A slot holds the full digest, the winner's locator and a count. ``resolve`` looks the new
digests up and compares all 32 bytes at the slot: members are repeats and join their slot's winner and count, nonmembers are
grouped among themselves. The shards follow the larger of both sides' measured rows, so a shard is bounded whichever side is
large. The last join gives each row its group's result; Spark splits its large partitions.

Locators are doc_ids and keep their type from end to end (Arrow columns, no floats): ids of any size and strings are exact.

Defined cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z; the largest doc_id of
equal texts stays (a null doc_id is smaller than any, and stays only if all are null); repeated rows of the doc_id that
stays are all marked kept, being one document; empty tables give empty results; other columns are ignored by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import fold, materialize, row_keyed, table

SHARD_KEYS = 1 << 14
BUCKET_KEYS = 4
COMBINE_ROWS = 1 << 16
DIGEST = 32


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(fold(F.coalesce(text, F.lit(""))), 256))


def digests(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``carried`` and digest of each row."""
    return docs.select("doc_id", *carried, digest_of(F.col("text")).alias("digest"))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Hash and displace over 32-byte digests: n distinct keys go to the slots 0 to n - 1, each to its own."""

    def __init__(self, keys: np.ndarray):
        """keys: (n, 32) uint8, distinct."""
        self.n = n = len(keys)
        self.buckets = max(1, -(-n // BUCKET_KEYS))
        self.pilots = np.zeros(self.buckets, np.uint32)
        if not n:
            return
        bucket, h = self._parts(keys)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):  # large buckets choose first
            if not (k := sizes[b]):
                break
            own = h[order[starts[b] : starts[b] + k]]
            first = 0
            while True:  # pilots are tried in blocks
                tries = np.arange(first, first + 64, dtype=np.uint64)
                slots = _mix(own[None, :], tries[:, None] + np.uint64(1)) % np.uint64(n)
                good = free[slots].all(1)
                if k > 1:
                    s = np.sort(slots, 1)
                    good &= (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    i = int(good.argmax())
                    self.pilots[b] = first + i
                    free[slots[i]] = False
                    break
                first += 64

    def _parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.ascontiguousarray(keys).view("<u8").reshape(-1, DIGEST // 8)
        return (_mix(x[:, 1], np.full(len(x), 7, np.uint64)) % np.uint64(self.buckets)).astype(np.int64), _mix(x[:, 2], x[:, 3])

    def slot(self, keys: np.ndarray) -> np.ndarray:
        if not self.n or not len(keys):
            return np.zeros(len(keys), np.int64)
        bucket, h = self._parts(keys)
        return (_mix(h, self.pilots[bucket].astype(np.uint64) + np.uint64(1)) % np.uint64(self.n)).astype(np.int64)


def _keys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIGEST)


def _grouped(rows: pa.Table) -> pa.Table:
    """digest, winner, n: one row per digest, with the largest winner that is not null."""
    out = rows.group_by("digest", use_threads=False).aggregate([("winner", "max"), ("n", "sum")])
    return out.rename_columns(["digest", "winner", "n"])


def combined(rows: DataFrame) -> DataFrame:
    """digest, winner, n of ``rows`` (doc_id, digest), combined within each partition: no shuffle, bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            own = _grouped(pa.table({"digest": b.column("digest"), "winner": b.column("doc_id"), "n": pa.array(np.ones(b.num_rows, np.int64))}))
            held = own if held is None else _grouped(pa.concat_tables([held, own]))
            if held.num_rows > COMBINE_ROWS:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return rows.select("doc_id", "digest").mapInArrow(run, f"digest binary, winner {rows.schema['doc_id'].dataType.simpleString()}, n long")


def shard_count(rows: int, shard_keys: int = SHARD_KEYS) -> int:
    """A power of two, so that ``rows`` fall into shards of about ``shard_keys`` at most."""
    return 1 << max(0, (-(-rows // shard_keys) - 1).bit_length())


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the pilots and, by slot, full digests, winners and counts. ``history``: digest, winner, n."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = _grouped(rows)
        mph = PerfectHash(keys := _keys(rows["digest"]))
        by = np.empty(mph.n, np.int64)
        by[mph.slot(keys)] = np.arange(mph.n)
        rows = rows.take(pa.array(by))
        ends = pa.array([0, mph.n], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, rows[c].combine_chunks()) for c in ("winner", "n")]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([mph.pilots.tobytes()]), pa.array([b"".join(rows["digest"].to_pylist())]), *lists], ["shard", "pilots", "digests", "winners", "counts"])

    kind = history.schema["winner"].dataType.simpleString()
    return _sharded(history, shards).groupBy("shard").applyInArrow(build, f"shard long, pilots binary, digests binary, winners array<{kind}>, counts array<long>")


def resolve(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """digest, keep_id, group_size, member for every digest of ``new`` (digest, winner, n) and of the index.

    Members update their slot; nonmembers are grouped by digest. All rows of a digest are in one shard, as is its slot.
    """

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        held = right["digests"][0].as_py() if right.num_rows else b""
        mph = PerfectHash(np.empty((0, DIGEST), np.uint8))
        if right.num_rows:
            mph.n, mph.pilots = len(held) // DIGEST, np.frombuffer(right["pilots"][0].as_py(), np.uint32)
            mph.buckets = len(mph.pilots)
        slots, keys = np.frombuffer(held, np.uint8).reshape(-1, DIGEST), _keys(left["digest"])
        slot = mph.slot(keys)
        member = (slots[slot] == keys).all(1) if mph.n else np.zeros(len(keys), bool)
        rows = left.select(["digest", "winner", "n"])
        parts = []
        if mph.n:  # the slot's own row, and its members'
            own = pa.table({"slot": np.arange(mph.n), "winner": right["winners"].combine_chunks().flatten(), "n": right["counts"].combine_chunks().flatten()})
            repeats = rows.filter(pa.array(member)).select(["winner", "n"]).add_column(0, "slot", pa.array(slot[member]))
            every = pa.concat_tables([own, repeats.cast(own.schema)]).group_by("slot", use_threads=False).aggregate([("winner", "max"), ("n", "sum")])
            at = every["slot"].to_numpy()
            parts.append((pa.array([slots[i].tobytes() for i in at], pa.binary()), every["winner_max"], every["n_sum"], True))
        rest = _grouped(rows.filter(pa.array(~member)))
        parts.append((rest["digest"], rest["winner"], rest["n"], False))
        kind = left.schema.field("winner").type
        return pa.concat_tables([pa.table({"digest": pa.chunked_array(d, pa.binary()) if isinstance(d, pa.ChunkedArray) else d, "keep_id": w.cast(kind), "group_size": n.cast(pa.int64()), "member": pa.array(np.full(len(n), m))}) for d, w, n, m in parts])

    kind = new.schema["winner"].dataType.simpleString()
    left, right = _sharded(new, shards).groupBy("shard"), index.groupBy("shard")
    return left.cogroup(right).applyInArrow(probe, f"digest binary, keep_id {kind}, group_size long, member boolean")


def group_results(rows: DataFrame, history: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """digest, keep_id, group_size, member for every digest of ``rows`` (new) and ``history`` (both doc_id, digest)."""
    shards = shard_count(max(rows.count(), history.count()), shard_keys)  # both are tables just written: counts of their footers
    index = materialize(build_index(combined(history), shards), "dedup-index")
    return resolve(combined(rows), index, shards)


def _resolved(every: DataFrame, shard_keys: int) -> DataFrame:
    """``every`` (doc_id, digest, old, ...) with keep_id, group_size and kept."""
    every = materialize(every, "dedup-digests")
    groups = materialize(group_results(every.where(~F.col("old")), every.where("old"), shard_keys), "dedup-groups")
    # hint: both sides are exchanged, and Spark splits the partitions of common digests
    return every.join(groups.hint("merge"), "digest").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def _halved(rows: DataFrame) -> DataFrame:
    return rows.withColumn("old", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(2)) == 0)


def dedup(docs: DataFrame, history: DataFrame | None = None, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs`` and ``history``.

    Without ``history``, half of the documents, by a hash of doc_id, are the history and the others arrive new; the result is
    the same for any such split.
    """
    if history is None:
        every = _halved(digests(docs))
    else:
        every = digests(docs).withColumn("old", F.lit(False)).unionByName(digests(history).withColumn("old", F.lit(True)))
    return _resolved(every, shard_keys).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of equal texts: the largest doc_id's, also where ids repeat."""
    rows = row_keyed(docs, "_dedup_row")
    every = _resolved(_halved(digests(rows, ("_dedup_row",))), shard_keys)
    # equal rows of a kept id may be many, so they are combined before the shuffle
    first = every.where("kept").groupBy("digest").agg(F.min("_dedup_row").alias("_dedup_row")).select("_dedup_row")
    return rows.join(materialize(first, "dedup-kept").hint("merge"), "_dedup_row", "left_semi").select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
