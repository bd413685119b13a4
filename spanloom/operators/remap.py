"""Vocabulary remap: each distinct lexeme is segmented once, verified, and its ids expand every occurrence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.bytestrings import sha256
from spanloom.operators.columns import Parts
from spanloom.operators.segment import KNOWN_RUNS, Decoder, decode, pieces, segment
from spanloom.operators.vocabulary import given
from spanloom.schema import extended


def build_map(lexemes: DataFrame, vocab: DataFrame | list, *, checked: bool = True) -> DataFrame:
    """gid, bytes, target_ids of every lexeme. ``checked`` fails the query where a lexeme has no or no exact segmentation."""
    out = segment(lexemes, vocab).withColumnRenamed("ids", "target_ids")
    if not checked:
        return out
    out = decode(out, vocab, "target_ids")
    bad = F.col("target_ids").isNull() | (F.col("decoded") != F.col("bytes"))
    text = F.concat(F.lit("lexeme cannot be mapped, gid "), F.col("gid").cast("string"))
    return out.withColumn("target_ids", F.when(bad, F.raise_error(text).cast("array<bigint>")).otherwise(F.col("target_ids"))).select("gid", "bytes", "target_ids")


def map_size(mapped: DataFrame) -> DataFrame:
    """Entries, ids, and the bytes of 32-bit payload and 64-bit offsets that a packed map of them takes."""
    out = mapped.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.size("target_ids")), F.lit(0)).cast("bigint").alias("ids"))
    return out.withColumns({"payload_bytes": 4 * F.col("ids"), "map_bytes": 8 * (F.col("entries") + 1) + 4 * F.col("ids")})


def expand(stream: DataFrame, mapped: DataFrame) -> DataFrame:
    """doc_id, pos, sub, gid, target_id for a stream of gids; an unknown gid fails the query."""
    own = mapped.select(F.col("gid").alias("_gid"), "target_ids")
    j = stream.join(own, F.col("gid") == F.col("_gid"), "left")
    text = F.concat(F.lit("gid out of range: "), F.col("gid").cast("string"))
    ids = F.when(F.col("_gid").isNull(), F.raise_error(text).cast("array<bigint>")).otherwise(F.col("target_ids"))
    return j.select("doc_id", "pos", "gid", F.posexplode(ids).alias("sub", "target_id")).withColumn("sub", F.col("sub").cast("bigint"))


SUMMARY = ("positions", "emitted", "du_bytes", "target_bytes", "distinct_gids", "du_sha256", "target_sha256", "chunks")
_KINDS = "positions bigint, emitted bigint, du_bytes bigint, target_bytes bigint, distinct_gids bigint, du_sha256 string, target_sha256 string, chunks bigint"
_TYPES = [pa.string() if n.endswith("sha256") else pa.int64() for n in SUMMARY]


class _Fold:
    """Running summary of one stream: counters, both digests, chunks whose size resets to zero, a bit set of gids."""

    def __init__(self, target: int):
        self.target, self.held, self.counts, self.chunks, self.gids = target, 0, [0, 0, 0, 0], 0, bytearray()
        self.du, self.out = hashlib.sha256(), hashlib.sha256()

    def add(self, gid: int, raw: bytes, n_ids: int, decoded: bytes) -> None:
        self.du.update(raw)
        self.out.update(decoded)
        for i, n in enumerate((1, n_ids, len(raw), len(decoded))):
            self.counts[i] += n
        self.held += len(raw)
        if self.held >= self.target:
            self.chunks, self.held = self.chunks + 1, 0
        if gid >> 3 >= len(self.gids):
            self.gids.extend(bytes((gid >> 3) + 1 - len(self.gids)))
        self.gids[gid >> 3] |= 1 << (gid & 7)

    def row(self) -> tuple:
        return (*self.counts, int.from_bytes(self.gids, "little").bit_count(), self.du.hexdigest(), self.out.hexdigest(), self.chunks + (self.held > 0))


def summary(stream: DataFrame, mapped: DataFrame, vocab: DataFrame | list, target: int) -> DataFrame:
    """Per document: positions, emitted ids, bytes and digests of both sides, distinct gids, chunks of ``target`` bytes.

    ``stream``: doc_id, pos, gid; ``mapped``: gid, bytes, target_ids, whose ids are decoded here by ``vocab``, once per entry. A
    digest runs over a document's bytes in order: rows are sorted by document and position and folded as they pass, so a stream
    of any length takes no more memory than a bit for each gid.
    """
    per = decode(mapped, vocab, "target_ids", "decoded").select("gid", "bytes", F.size("target_ids").alias("n_ids"), "decoded")
    rows = stream.join(per, "gid").select("doc_id", "pos", "gid", "bytes", "n_ids", "decoded").repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    kind = stream.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * (1 + len(SUMMARY))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [id_type, *_TYPES], strict=True)], ["doc_id", *SUMMARY])

        id_type, last, fold, done = None, None, None, []
        for b in batches:
            id_type = b.schema.field("doc_id").type
            for doc, gid, raw, n, decoded in zip(*(b.column(c).to_pylist() for c in ("doc_id", "gid", "bytes", "n_ids", "decoded")), strict=True):
                if fold is None or doc != last:
                    if fold:
                        done.append((last, *fold.row()))
                    last, fold = doc, _Fold(target)
                fold.add(gid, raw, n, decoded)
            if len(done) >= 1024:
                yield out(done)
                done = []
        if fold:
            yield out([*done, (last, *fold.row())])

    return rows.mapInArrow(run, f"doc_id {kind.dataType.simpleString()}, {_KINDS}")


def translate(views: DataFrame, vocab: DataFrame | list, target: int) -> DataFrame:
    """``summary`` from one row per document: doc_id and parts (array of binary or strings). Map-only, one Arrow pass.

    Each distinct lexeme is segmented and decoded once per worker, against the broadcast vocabulary whose size is checked;
    ``distinct_gids`` counts a document's distinct lexemes. A lexeme without a segmentation fails the query.
    """
    shared = views.sparkSession.sparkContext.broadcast(given(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, d = pieces(shared), Decoder(shared.value)
        known: dict[bytes, tuple[int, bytes]] = {}

        def learn(x: bytes) -> tuple[int, bytes]:
            ids, at = p.greedy(x)
            if ids is None:
                raise ValueError(f"lexeme cannot be mapped at its byte {at}: {x[:80]!r}")
            if len(known) >= KNOWN_RUNS:
                known.clear()
            known[x] = got = (len(ids), b"".join(map(d.table.__getitem__, ids)))
            return got

        for b in batches:
            out, parts = [], Parts(b.column("parts"))
            for i in range(b.num_rows):
                data, bounds = parts.row(i)
                raw, at = bytes(data), bounds.tolist()
                own = [raw[x:y] for x, y in zip(at, at[1:], strict=False)]
                got = [known.get(x) or learn(x) for x in own]
                decoded = b"".join([g[1] for g in got])
                held = chunks = 0
                for n in map(len, own):
                    held += n
                    if held >= target:
                        chunks, held = chunks + 1, 0
                out.append((len(own), sum([g[0] for g in got]), len(raw), len(decoded), len(set(own)), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest(), chunks + (held > 0)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([o[i] for o in out], t) for i, t in enumerate(_TYPES)]], ["doc_id", *SUMMARY])

    own = views.select("doc_id", "parts")
    return own.mapInArrow(run, extended(own.select("doc_id").schema, _KINDS))


def triangle(summarised: DataFrame, docs: DataFrame) -> DataFrame:
    """``summarised`` with exact: raw, DU and target bytes agree in length and digest. ``docs``: doc_id, raw."""
    own = docs.select("doc_id", F.octet_length("raw").alias("_len"), sha256(F.col("raw")).alias("_sha"))
    same = (F.col("_len") == F.col("du_bytes")) & (F.col("du_bytes") == F.col("target_bytes")) & (F.col("_sha") == F.col("du_sha256")) & (F.col("du_sha256") == F.col("target_sha256"))
    return summarised.join(own, "doc_id").withColumn("exact", same).drop("_len", "_sha")


def coverage(lexemes: DataFrame, vocab: DataFrame, failures: int = 50) -> tuple[DataFrame, DataFrame]:
    """Fail-tolerant: a one-row summary of segmentable and other types and bytes, and the first failures by gid."""
    s = build_map(lexemes, vocab, checked=False).withColumn("ok", F.col("target_ids").isNotNull()).withColumn("n", F.octet_length("bytes").cast("bigint"))
    total = s.agg(
        F.count("*").alias("types"), F.count_if("ok").alias("ok_types"), F.count_if(~F.col("ok")).alias("bad_types"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("all_bytes"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("ok_bytes"),
    ).withColumn("fraction", F.try_divide(F.col("ok_types").cast("double"), F.col("types").cast("double")))
    return total, s.where(~F.col("ok")).orderBy("gid").limit(failures).select("gid", "failed_at")
