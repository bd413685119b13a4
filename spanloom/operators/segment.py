"""Segmentation of byte strings into vocabulary pieces: greedy longest match, exact minimum, and their joins.

Greedy and minimum search are sequential within a string, so they run in Arrow batches against a broadcast dictionary whose
size is checked. ``segment_join`` is the declarative form for vocabularies of any size and short strings.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.columns import Numbers, sliced
from spanloom.operators.vocabulary import given, usable
from spanloom.schema import extended


_RUNS = re.compile(rb"[ \t\n\r]+|[^ \t\n\r]+")
KNOWN_RUNS, KNOWN_COUNTS, KNOWN_BYTES = 100_000, 400_000, 64
DENSE_IDS, GATHERED = 1 << 25, 1 << 20


class Pieces:
    """A byte dictionary, probed by the lengths that occur behind each first byte, longest first."""

    def __init__(self, vocab: list[tuple[int, bytes]]):
        self.ids: dict[bytes, int] = {}
        for i, b in vocab:
            if b and (b not in self.ids or i < self.ids[b]):
                self.ids[b] = i
        sizes: list[set[int]] = [set() for _ in range(256)]
        for b in self.ids:
            sizes[b[0]].add(len(b))
        self.sizes = [sorted(s, reverse=True) for s in sizes]
        self.cuttable = all(len(_RUNS.findall(b)) == 1 for b in self.ids)
        self.known: dict[bytes, bytes] = {}
        self.least: dict[bytes, list[int] | None] = {}
        self.lane: dict[bytes, tuple[int, int]] = {}

    def greedy(self, s: bytes) -> tuple[list[int] | None, int | None]:
        """(ids, None), or (None, the first offset that no piece matches)."""
        ids, at, n = [], 0, len(s)
        get, sizes = self.ids.get, self.sizes
        while at < n:
            for k in sizes[s[at]]:
                i = get(s[at : at + k])
                if i is not None and at + k <= n:
                    ids.append(i)
                    at += k
                    break
            else:
                return None, at
        return ids, None

    def packed(self, s: bytes) -> tuple[bytes | None, int | None]:
        """``greedy`` with the ids as packed 64-bit words.

        If no piece mixes white space with other bytes, no match crosses from a run of one into the other: the string is
        cut into such runs and each distinct run is searched once per worker.
        """
        if not self.cuttable:
            ids, at = self.greedy(s)
            return (None, at) if ids is None else (struct.pack(f"<{len(ids)}q", *ids), None)
        runs = _RUNS.findall(s)
        known = self.known
        if len(runs) == 1 and runs[0] not in known:  # a lexeme by itself, as dictionaries hold each once: nothing to keep
            ids, at = self.greedy(s)
            return (None, at) if ids is None else (struct.pack(f"<{len(ids)}q", *ids), None)
        try:
            return b"".join(map(known.__getitem__, runs)), None
        except KeyError:
            pass
        if len(known) > KNOWN_RUNS:
            known.clear()
        out, start = [], 0
        for r in runs:
            if (got := known.get(r)) is None:
                ids, at = self.greedy(r)
                if ids is None:
                    return None, start + at
                got = struct.pack(f"<{len(ids)}q", *ids)
                if len(r) <= KNOWN_BYTES:
                    known[r] = got
            out.append(got)
            start += len(r)
        return b"".join(out), None

    def minimum(self, s: bytes) -> list[int] | None:
        """Fewest pieces; among these, the last piece is the longest, and so on backwards.

        Where no piece crosses from a run of white space into other bytes or back, each distinct run is searched once.
        """
        if not self.cuttable:
            return self._minimum(s)
        out: list[int] = []
        for r in _RUNS.findall(s):
            if (got := self.least.get(r, 0)) == 0:
                if len(self.least) > KNOWN_RUNS:
                    self.least.clear()
                got = self._minimum(r)
                if len(r) <= KNOWN_BYTES:
                    self.least[r] = got
            if got is None:
                return None
            out += got
        return out

    def counts(self, s: bytes, lexemes: list[bytes]) -> tuple[int, int, int]:
        """Ids of three lanes: greedy over each lexeme, greedy over the whole, minimum; 0 where there is no segmentation.

        Where no piece crosses from a run of white space into other bytes, the counts of each distinct run are found once.
        """
        if not self.cuttable:
            return sum([len(self.packed(x)[0] or b"") // 8 for x in lexemes]), len(self.packed(s)[0] or b"") // 8, len(self.minimum(s) or ())
        runs = _RUNS.findall(s)
        got = [self.lane.get(r) or self._lane(r) for r in runs]
        greedy, least = [g for g, _ in got], [m for _, m in got]
        stream = 0 if -1 in greedy else sum(greedy)
        if lexemes == runs:
            per = stream if -1 not in greedy else sum([g for g in greedy if g > 0])
        else:
            per = sum([len(self.packed(x)[0] or b"") // 8 for x in lexemes])
        return per, stream, 0 if -1 in least else sum(least)

    def _lane(self, r: bytes) -> tuple[int, int]:
        """(greedy ids, least ids) of one run, -1 for none."""
        if len(self.lane) > KNOWN_COUNTS:
            self.lane.clear()
        ids = self.greedy(r)[0]
        got = -1 if ids is None else len(ids), self._least(r)
        if len(r) <= KNOWN_BYTES:
            self.lane[r] = got
        return got

    def _least(self, s: bytes) -> int:
        """The size of ``_minimum``, -1 for none."""
        n, own, sizes = len(s), self.ids, self.sizes
        none = n + 1
        cost = [0] + [none] * n
        for i in range(n):
            c = cost[i] + 1
            if c > n:
                continue
            for k in sizes[s[i]]:
                j = i + k
                if j <= n and c < cost[j] and s[i:j] in own:
                    cost[j] = c
        return -1 if cost[n] == none else cost[n]

    def _minimum(self, s: bytes) -> list[int] | None:
        n = len(s)
        cost, back = [0] + [n + 1] * n, [(-1, -1)] * (n + 1)
        for i in range(n):
            if cost[i] > n:
                continue
            for k in self.sizes[s[i]]:
                p = self.ids.get(s[i : i + k]) if i + k <= n else None
                if p is not None and cost[i] + 1 < cost[i + k]:
                    cost[i + k], back[i + k] = cost[i] + 1, (i, p)
        if cost[n] > n:
            return None if n else []
        out, j = [], n
        while j:
            j, p = back[j]
            out.append(p)
        return out[::-1]


_BUILT: dict = {}


def pieces(shared) -> Pieces:
    """One dictionary per Python worker and broadcast."""
    if _BUILT.get("of") is not shared.value:
        _BUILT["of"], _BUILT["pieces"] = shared.value, Pieces(shared.value)
    return _BUILT["pieces"]


def segment(rows: DataFrame, vocab: DataFrame | list, method: str = "greedy", column: str = "bytes", min_id: int = 0) -> DataFrame:
    """``rows`` with ``ids`` (null where some byte has no piece) and ``failed_at`` (its offset, greedy only).

    ``method``: ``greedy`` or ``minimum``. Map-only; null bytes give nulls.
    """
    shared = rows.sparkSession.sparkContext.broadcast(given(vocab, min_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(shared)
        for b in sliced(batches, column):
            got, failed = [], []
            for v in b.column(column):
                s, at = v.as_py(), None
                if s is None:
                    x = None
                elif method == "greedy":
                    x, at = p.packed(s)
                else:
                    ids = p.minimum(s)
                    x = None if ids is None else struct.pack(f"<{len(ids)}q", *ids)
                got.append(x)
                failed.append(at)
            ends = np.cumsum([0, *[len(x) // 8 if x else 0 for x in got]]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join([x for x in got if x]), np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([x is None for x in got]))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(failed, pa.int64())], [*b.schema.names, "ids", "failed_at"])

    return rows.mapInArrow(run, extended(rows.schema, "ids array<bigint>, failed_at bigint"))


def segment_join(lexemes: DataFrame, vocab: DataFrame) -> DataFrame:
    """``lexemes`` (gid, bytes) with greedy ``ids``: every (offset, length) meets the vocabulary by an equi-join on bytes.

    Cost follows the bytes times the number of piece lengths; meant for dictionaries of short lexemes and large vocabularies.
    """
    own = usable(vocab)
    sizes = [r[0] for r in own.select(F.octet_length("bytes").alias("n")).distinct().orderBy("n").collect()]  # piece lengths, not pieces
    n = F.octet_length("bytes")
    spots = lexemes.where(n > 0).select("gid", "bytes", F.explode(F.sequence(F.lit(0), n - 1)).alias("at")).select("gid", "bytes", "at", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("k")).where(F.col("at") + F.col("k") <= n)
    spots = spots.select("gid", "at", "k", F.substring("bytes", F.col("at") + 1, F.col("k")).alias("piece"))
    best = spots.join(own.select("id", F.col("bytes").alias("piece")), "piece").groupBy("gid", "at").agg(F.max(F.struct("k", "id")).alias("b"))
    steps = best.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("at", F.col("b")))).alias("next"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<bigint>").alias("ids"))
    # one step per byte suffices; a step beyond the end or at a gap changes nothing
    step = lambda a, _: F.when(F.col("next")[a["at"]].isNull(), a).otherwise(F.struct((a["at"] + F.col("next")[a["at"]]["k"]).alias("at"), F.concat(a["ids"], F.array(F.col("next")[a["at"]]["id"])).alias("ids")))
    walked = F.aggregate(F.sequence(F.lit(1), n), start, step)
    out = lexemes.join(steps, "gid", "left").withColumn("w", F.when(n > 0, walked))
    done = F.when(n == 0, F.array().cast("array<bigint>")).when(F.col("w.at") == n, F.col("w.ids"))
    return out.select("gid", "bytes", done.alias("ids"))


class Decoder:
    """Bytes of arrays of ids, gathered from one buffer of all pieces."""

    def __init__(self, vocab: list[tuple[int, bytes]]):
        self.table = dict(vocab)
        self.dense = bool(vocab) and max(self.table) < DENSE_IDS
        if self.dense:
            n = max(self.table) + 1
            self.size, self.start = np.full(n, -1, np.int64), np.zeros(n, np.int64)
            ids = np.fromiter(self.table, np.int64, len(self.table))
            self.size[ids] = np.fromiter(map(len, self.table.values()), np.int64, len(ids))
            self.start[ids] = np.concatenate([[0], np.cumsum(self.size[ids])[:-1]])
            self.buffer = np.frombuffer(b"".join(self.table.values()), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes | None:
        """None where an id is unknown."""
        if not len(ids):
            return b""
        if not self.dense:
            parts = [self.table.get(i) for i in ids.tolist()]
            return None if None in parts else b"".join(parts)
        if ids.min() < 0 or ids.max() >= len(self.size):
            return None
        out = []
        for i in range(0, len(ids), GATHERED):
            own = ids[i : i + GATHERED]
            size = self.size[own]
            if size.min() < 0:
                return None
            ends = np.cumsum(size)
            out.append(self.buffer[np.repeat(self.start[own] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def decode(rows: DataFrame, vocab: DataFrame | list, column: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that an array of ids stands for (null ids, or an unknown one, give null)."""
    shared = rows.sparkSession.sparkContext.broadcast(given(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(shared.value)
        for b in batches:
            c = b.column(column)
            ids, there = Numbers(c), c.is_valid().to_numpy(zero_copy_only=False)
            got = [d.decode(ids.row(i)) if there[i] else None for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], [*b.schema.names, out])

    return rows.mapInArrow(run, extended(rows.schema, f"{out} binary"))


def round_trip(rows: DataFrame, vocab: DataFrame | list, column: str = "bytes") -> DataFrame:
    """The other columns of ``rows`` with n_ids and ids_sha256 (32-bit words), n_bytes and decoded_sha256 of the greedy ids' bytes, and exact: one pass.

    A string without a segmentation has nulls and is not exact.
    """
    shared = rows.sparkSession.sparkContext.broadcast(given(vocab))
    kept = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, d = pieces(shared), Decoder(shared.value)
        for b in batches:
            out = []
            for v in b.column(column):
                raw = v.as_py() or b""
                packed, _ = p.packed(raw)
                ids = None if packed is None else np.frombuffer(packed, np.int64)
                got = None if ids is None else d.decode(ids)
                out.append((None, None, None, None, False) if got is None else (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), len(got), hashlib.sha256(got).hexdigest(), got == raw))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], [*kept, "n_ids", "ids_sha256", "n_bytes", "decoded_sha256", "exact"])

    return rows.select(*kept, column).mapInArrow(run, extended(rows.select(*kept).schema, "n_ids bigint, ids_sha256 string, n_bytes bigint, decoded_sha256 string, exact boolean"))


def lanes(rows: DataFrame, vocab: DataFrame | list, pattern_lexemes, column: str = "bytes") -> DataFrame:
    """``rows`` with the id counts of three lanes: per-lexeme greedy, whole-stream greedy, exact minimum, and the regrets.

    ``pattern_lexemes``: bytes to its lexemes, a picklable function.
    """
    shared = rows.sparkSession.sparkContext.broadcast(given(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(shared)
        for b in batches:
            out = np.zeros((b.num_rows, 3), np.int64)
            for i, v in enumerate(b.column(column)):
                s = v.as_py() or b""
                out[i] = p.counts(s, pattern_lexemes(s))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(out[:, j]) for j in range(3)]], [*b.schema.names, "per_lexeme", "stream", "minimum"])

    return rows.mapInArrow(run, extended(rows.schema, "per_lexeme bigint, stream bigint, minimum bigint"))
