"""Append repair: keep a prefix's token ids, drop the last k, tokenize only the tail with the appended bytes, and splice.

Rows are independent, so every operator here is map-only (``repair_turns`` brings a conversation's turns together first). The full
tokenization (the oracle) is only ever compared with; no candidate is built from it, and a full window is never tokenized in
its place: what cannot be repaired carries a reason.

``repair`` works on raw prefixes. ``repair_snapshots`` is the DU-aware form on stored snapshots: each is validated once, the
delta is rebuilt once from its DU state, and a candidate's tail comes from the snapshot's DU state; ``gates`` names the first
condition of a receipt that fails.

Reasons, in the order of the checks: ``empty prefix``; ``invalid snapshot: CHECK``, ``invalid delta: CHECK`` (snapshots only);
``drop exceeds prefix``, ``kept bytes no prefix`` (V1 only), ``full window forbidden``, ``start outside prefix``,
``tail not rebuilt`` (snapshots only); ``not exact`` (search only, after the last drop). Tokenizer errors fail the query.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.tokenizers import Ids, Tokenizer, parts_of
from spanloom.operators.columns import Numbers, Parts, sliced
from spanloom.operators.validate import arrays_error, u32_ok
from spanloom.schema import SNAPSHOT, extended

DROP, PREFIX, FULL, INEXACT, OUTSIDE, TAIL = "drop exceeds prefix", "kept bytes no prefix", "full window forbidden", "not exact", "start outside prefix", "tail not rebuilt"


class Rejected(Exception):
    """A candidate that must not be built."""


@dataclass
class Candidate:
    drop: int
    ids: list[int]
    kept: int
    repair_start: int
    tail: int
    window: int
    fresh: int


def candidate_v1(tok: Tokenizer, prefix: bytes, ids: list[int], delta: bytes, drop: int) -> Candidate:
    """Kept bytes come from decoding the kept ids."""
    if drop > len(ids):
        raise Rejected(DROP)
    kept = ids[: len(ids) - drop]
    raw = tok.decode(kept)
    if not prefix.startswith(raw):
        raise Rejected(PREFIX)
    if not raw:
        raise Rejected(FULL)
    window = prefix[len(raw) :] + delta
    fresh = tok.encode(window) if window else []
    return Candidate(drop, kept + fresh, len(kept), len(raw), len(prefix) - len(raw), len(window), len(fresh))


def candidate_v2(tok: Tokenizer, prefix: bytes, ids: list[int], ends: list[int], delta: bytes, drop: int) -> Candidate:
    """Kept bytes come from the spans (``ends``), the tail from the prefix; nothing is decoded."""
    return _spliced(tok, ids, ends, len(prefix), lambda start: prefix[start:], delta, drop)


def _spliced(tok: Tokenizer, ids: list[int], ends: list[int], prefix_len: int, tail_from, delta: bytes, drop: int) -> Candidate:
    if drop > len(ids):
        raise Rejected(DROP)
    n = len(ids) - drop
    start = ends[n - 1] if n else 0
    if not start:
        raise Rejected(FULL)
    if start > prefix_len:
        raise Rejected(OUTSIDE)
    tail = tail_from(start)
    fresh = tok.encode(tail + delta) if tail or delta else []
    return Candidate(drop, ids[:n] + fresh, n, start, prefix_len - start, len(tail) + len(delta), len(fresh))


@dataclass
class State:
    """A DU state: parts and their bounds from 0."""

    parts: list[bytes]
    bounds: list[int]

    def bytes_from(self, start: int, end: int) -> bytes:
        """Bytes [start, end), cutting inside a part; only the parts that are met are touched."""
        if not 0 <= start <= end <= self.bounds[-1]:
            raise Rejected(TAIL)
        if start == end:
            return b""
        first = bisect_right(self.bounds, start) - 1
        last = bisect_right(self.bounds, end - 1) - 1
        out = b"".join(self.parts[first : last + 1])[start - self.bounds[first] :][: end - start]
        if len(out) != end - start:
            raise Rejected(TAIL)
        return out


def candidate_du(tok: Tokenizer, ids: list[int], ends: list[int], prefix_len: int, state: State, delta: bytes, drop: int) -> Candidate:
    """Kept bytes come from the snapshot's spans, the tail from its DU state; the prefix itself is not read."""
    return _spliced(tok, ids, ends, prefix_len, lambda start: state.bytes_from(start, prefix_len), delta, drop)


@dataclass
class Search:
    found: Candidate | None = None
    reason: str | None = None
    trials: list[dict] = field(default_factory=list)


def search(build, oracle: list[int] | None, drops: range) -> Search:
    """The first drop whose ids equal the oracle's; without an oracle, the first that can be built. Tokenizer errors pass."""
    out = Search()
    for k in drops:
        try:
            c = build(k)
        except Rejected as e:
            out.reason = str(e)
            out.trials.append({"drop": k, "window": None, "exact": None, "reason": str(e)})
            continue
        exact = None if oracle is None else c.ids == oracle
        out.trials.append({"drop": k, "window": c.window, "exact": exact, "reason": None})
        if exact is not False:
            out.found, out.reason = c, None
            return out
        out.reason = INEXACT
    return out


def ends_of(tok: Tokenizer, ids: list[int]) -> list[int]:
    return list(accumulate(map(len, parts_of(tok, ids))))


def _search(tok, prefix: bytes, ids: list[int], ends: list[int] | None, delta: bytes, oracle: list[int], version: int, fixed_drop: int | None, max_drop: int) -> Search:
    if version == 2:
        ends = ends_of(tok, ids) if ends is None else ends
        build = lambda k: candidate_v2(tok, prefix, ids, ends, delta, k)
    else:
        build = lambda k: candidate_v1(tok, prefix, ids, delta, k)
    return search(build, None if fixed_drop is not None else oracle, drops_of(fixed_drop, max_drop))


def drops_of(fixed_drop: int | None, max_drop: int) -> range:
    return range(max_drop + 1) if fixed_drop is None else range(fixed_drop, fixed_drop + 1)


_TRIAL = pa.struct([("drop", pa.int64()), ("window", pa.int64()), ("exact", pa.bool_()), ("reason", pa.string())])
_OUT = {"drop": pa.int64(), "kept": pa.int64(), "repair_start": pa.int64(), "tail": pa.int64(), "window": pa.int64(), "fresh": pa.int64()}


def repair(rows: DataFrame, tokenizer: Tokenizer, *, version: int = 2, fixed_drop: int | None = None, max_drop: int = 8) -> DataFrame:
    """``rows`` (with prefix and delta, binary) and the repair of each.

    Adds ids, drop, kept, repair_start, tail, window, fresh (token and byte counts), exact (against the full tokenization),
    reason and trials. With ``fixed_drop`` one candidate is built and only checked afterwards; otherwise drops 0 to
    ``max_drop`` are tried in order. An empty prefix has no snapshot: reason ``empty prefix``.
    """
    given = rows.sparkSession.sparkContext.broadcast(tokenizer)

    def one(prefix: bytes, delta: bytes) -> tuple[Search, list[int] | None]:
        if not prefix:
            return Search(reason="empty prefix"), None
        tok = given.value
        oracle = tok.encode(prefix + delta)
        return _search(tok, prefix, tok.encode(prefix), None, delta, oracle, version, fixed_drop, max_drop), oracle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "prefix"):
            got = [one(p.as_py() or b"", d.as_py() or b"") for p, d in zip(b.column("prefix"), b.column("delta"), strict=True)]
            found = [s.found for s, _ in got]
            cols = [pa.array([f and f.ids for f in found], pa.list_(pa.int64()))]
            cols += [pa.array([getattr(f, n) if f else None for f in found], t) for n, t in _OUT.items()]
            cols.append(pa.array([bool(f) and f.ids == o for f, (_, o) in zip(found, got, strict=True)], pa.bool_()))
            cols += [pa.array([s.reason for s, _ in got], pa.string()), pa.array([s.trials for s, _ in got], pa.list_(_TRIAL))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "ids", *_OUT, "exact", "reason", "trials"])

    counts = ", ".join(f"{n} bigint" for n in _OUT)
    more = f"ids array<bigint>, {counts}, exact boolean, reason string, trials array<struct<drop:bigint,window:bigint,exact:boolean,reason:string>>"
    return rows.mapInArrow(run, extended(rows.schema, more))


_FOUND = {**_OUT, "n_ids": pa.int64(), "ids_sha256": pa.string(), "exact": pa.bool_(), "reason": pa.string(), "n_trials": pa.int64()}


def repair_turns(conversations: DataFrame, tokenizer: Tokenizer, *, version: int = 2, fixed_drop: int | None = None, max_drop: int = 8, trials: bool = False) -> DataFrame:
    """``repair`` of each turn (conv_id, turn, text) against all earlier turns, one pass over a conversation's turns in order.

    The full tokenization after one turn is the snapshot that the next turn starts from, so each is made once. Results have the
    candidate's geometry, n_ids, ids_sha256 (of the ids in decimal, comma-joined), exact, reason and n_trials, and with ``trials``
    the trials themselves; ids would grow with the square of a conversation. A conversation is one task's unit: its turns come
    as sorted rows, which may spread over batches, and only the text and ids of the one at hand are in memory.
    """
    given = conversations.sparkSession.sparkContext.broadcast(tokenizer)
    rows = conversations.select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("delta"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "delta")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, at, prefix, ids, ends = given.value, run, b"", [], []
        for b in sliced(batches, "delta"):
            out: list[tuple] = []
            tried: list[list[dict]] = []
            for conv, delta in zip(b.column("conv_id").to_pylist(), b.column("delta").to_pylist(), strict=True):
                if at is run or not (conv == at or (conv != conv and at != at)):  # NaN is one key as well
                    at, prefix, ids, ends = conv, b"", [], []
                whole = prefix + delta
                oracle = tok.encode(whole) if whole else []
                s = _search(tok, prefix, ids, ends, delta, oracle, version, fixed_drop, max_drop) if prefix else Search(reason="empty prefix")
                f = s.found
                out.append((
                    *[getattr(f, n) if f else None for n in _OUT], len(f.ids) if f else None, hashlib.sha256(",".join(map(str, f.ids)).encode()).hexdigest() if f else None,
                    bool(f) and f.ids == oracle, s.reason, len(s.trials),
                ))
                if trials:
                    tried.append(s.trials)
                prefix, ids = whole, oracle
                ends = ends_of(tok, ids) if version == 2 else []
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), _FOUND.values(), strict=True)]
            more = {"trials": pa.array(tried, pa.list_(_TRIAL))} if trials else {}
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), *cols, *more.values()], ["conv_id", "turn", *_FOUND, *more])

    counts = ", ".join(f"{n} bigint" for n in _OUT)
    kinds = f"{counts}, n_ids bigint, ids_sha256 string, exact boolean, reason string, n_trials bigint" + (", trials array<struct<drop:bigint,window:bigint,exact:boolean,reason:string>>" if trials else "")
    return rows.mapInArrow(run, extended(rows.select("conv_id", "turn").schema, kinds))


def appends(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, prefix (all earlier turns' text) and delta (this turn's), as UTF-8.

    A conversation's texts are gathered once and joined per turn; the output itself holds every prefix.
    """
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    rows = turns.select("conv_id", F.transform("t", lambda x: x["text"]).alias("texts"), F.posexplode("t").alias("i", "own"))
    before = F.array_join(F.slice("texts", F.lit(1), F.col("i")), "")
    return rows.select("conv_id", "own.turn", F.encode(before, "UTF-8").alias("prefix"), F.encode("own.text", "UTF-8").alias("delta"))


def histogram(repaired: DataFrame, by: list[str] | None = None, drops: int = 8) -> DataFrame:
    """Cases, exact ones and whether all are, largest drop and tail, medians of tail and window, and cases per drop 0 to ``drops``."""
    median = lambda c: F.percentile(c, F.lit(0.5)).alias(f"median_{c}")
    return repaired.groupBy(*(by or [])).agg(
        F.count("*").alias("cases"), F.count_if("exact").alias("exact_cases"), (F.count_if("exact") == F.count("*")).alias("all_exact"), F.max("drop").alias("max_drop"), F.max("tail").alias("max_tail"),
        median("tail"), median("window"), *[F.count_if(F.col("drop") == k).alias(f"drop_{k}") for k in range(drops + 1)],
    )


_SPAN = pa.struct([("id", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("bytes_hex", pa.string())])


def _lists(rows: list, kind: pa.DataType, values=None) -> pa.ListArray:
    """A list column from rows of lists, whose flat values may be made already."""
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for r in rows for x in r], kind) if values is None else values)


def du_state(column: str, tokenizer: Tokenizer, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the DU state (ids, parts, bounds) of a binary column behind them; map-only."""
    given = rows.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, column):
            states = [_state(given.value, v.as_py() or b"") for v in b.column(column)]
            yield pa.RecordBatch.from_arrays([*b.columns, _state_column(states)], [*b.schema.names, name])

    return rows.mapInArrow(run, extended(rows.schema, f"{name} struct<ids:array<bigint>,parts:array<binary>,bounds:array<bigint>>"))


def _state(tok: Tokenizer, raw: bytes) -> tuple[list[int], list[bytes], list[int]]:
    ids = tok.encode(raw) if raw else []
    parts = parts_of(tok, ids)
    return ids, parts, [0, *np.cumsum([len(p) for p in parts], dtype=np.int64).tolist()]


def _state_column(states: list[tuple]) -> pa.StructArray:
    kinds = (pa.int64(), pa.binary(), pa.int64())
    return pa.StructArray.from_arrays([_lists([s[i] for s in states], k) for i, k in enumerate(kinds)], ["ids", "parts", "bounds"])


def snapshot(rows: DataFrame, native: Tokenizer, du: Tokenizer) -> DataFrame:
    """Snapshot table of ``rows`` (doc_id, prefix): native ids and spans, and the DU state (ids, parts, bounds); map-only.

    Other columns of ``rows`` stay behind the snapshot's, so nothing has to be joined again. A native id that does not fit 32 bits fails the query.
    """
    given = rows.sparkSession.sparkContext.broadcast((native, du))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, d = given.value
        for b in sliced(batches, "prefix"):
            raws = [v.as_py() or b"" for v in b.column("prefix")]
            own = [_state(a, r) for r in raws]
            flat = lambda i, cut=slice(None): np.array([x for s in own for x in s[i][cut]], np.int64)  # noqa: B023, E731
            spans = pa.StructArray.from_arrays([pa.array(flat(0)), pa.array(flat(2, slice(-1))), pa.array(flat(2, slice(1, None))), pa.array([p.hex() for s in own for p in s[1]], pa.string())], fields=list(_SPAN))
            ids = [s[0] for s in own]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array([len(r) for r in raws], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raws]), _lists(ids, pa.int64()), _lists(ids, _SPAN, spans), _state_column([_state(d, r) for r in raws]), *b.columns[2:]],
                ["doc_id", "prefix", "prefix_len", "prefix_sha256", "native_ids", "native_spans", "du_state", *b.schema.names[2:]],
            )

    wide = F.exists("native_ids", lambda x: ~u32_ok(x))
    more = [f for f in rows.schema.fields if f.name not in ("doc_id", "prefix")]
    out = rows.select("doc_id", "prefix", *[f.name for f in more]).mapInArrow(run, T.StructType([*T.StructType.fromDDL(SNAPSHOT).fields, *more]))
    return out.withColumn("native_ids", F.when(wide, F.raise_error(F.lit("a native id does not fit 32 bits")).cast("array<bigint>")).otherwise(F.col("native_ids")))


@dataclass
class _Snapshot:
    """One snapshot row, read from Arrow columns."""

    prefix: bytes
    size: int
    sha: str
    ids: np.ndarray
    span_ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hexed: memoryview
    hex_bounds: np.ndarray
    du: memoryview

    def fault(self) -> str | None:
        """The first failing check."""
        raw, n = self.prefix, len(self.span_ids)
        if not raw:
            return "empty prefix"
        if self.size != len(raw):
            return "length"
        if self.sha != hashlib.sha256(raw).hexdigest():
            return "hash"
        if self.du != raw:
            return "du rebuild"
        if len(self.ids) != n:
            return "count"
        if not n:
            return "no spans"
        before = np.concatenate([[0], self.ends[:-1]])
        wrong = (self.span_ids != self.ids) | (self.starts != before) | (self.ends <= self.starts) | (self.ends > self.size)
        first = int(wrong.argmax()) if wrong.any() else n
        whole = not wrong.any() and bytes(self.hexed).lower() == raw[: int(self.ends[-1])].hex().encode() and (np.diff(self.hex_bounds) == 2 * (self.ends - self.starts)).all()
        for i in range(0 if whole else first):  # spans before the first wrong one may differ in their bytes
            text = bytes(self.hexed[self.hex_bounds[i] : self.hex_bounds[i + 1]])
            if len(text) % 2 or not all(c in b"0123456789abcdefABCDEF" for c in text):
                return "hex"
            if bytes.fromhex(text.decode()) != raw[self.starts[i] : self.ends[i]]:
                return "bytes"
        if first < n:
            if self.span_ids[first] != self.ids[first]:
                return "span id"
            return "contiguity" if self.starts[first] != before[first] else "empty span" if self.ends[first] <= self.starts[first] else "range"
        return None if self.ends[-1] == self.size else "final end"


def _snapshots(b: pa.RecordBatch) -> Iterator[_Snapshot]:
    spans, ids, du = b.column("native_spans"), Numbers(b.column("native_ids")), Parts(b.column("du_state").field("parts"))
    flat = {f: spans.values.field(f) for f in ("id", "byte_start", "byte_end", "bytes_hex")}
    numbers = {f: flat[f].to_numpy(zero_copy_only=False) for f in ("id", "byte_start", "byte_end")}
    text, rows = Parts(pa.ListArray.from_arrays(spans.offsets, flat["bytes_hex"])), spans.offsets.to_numpy()
    for i, (prefix, size, sha) in enumerate(zip(b.column("prefix").to_pylist(), b.column("prefix_len").to_pylist(), b.column("prefix_sha256").to_pylist(), strict=True)):
        own = slice(rows[i], rows[i + 1])
        hexed, bounds = text.row(i)
        yield _Snapshot(prefix or b"", size, sha, ids.row(i), numbers["id"][own], numbers["byte_start"][own], numbers["byte_end"][own], hexed, bounds, du.row(i)[0])


def snapshot_errors(rows: DataFrame) -> DataFrame:
    """The other columns of snapshot rows, with ``error``: the first failing check, or null. Whole arrays are compared; map-only."""
    used = [c.split()[0] for c in ("prefix", "prefix_len", "prefix_sha256", "native_ids", "native_spans", "du_state")]
    kept = [c for c in rows.columns if c not in used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "prefix"):
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array([s.fault() for s in _snapshots(b)], pa.string())], [*kept, "error"])

    return rows.mapInArrow(run, extended(rows.select(*kept).schema, "error string"))


def repair_snapshots(rows: DataFrame, tokenizer: Tokenizer, *, fixed_drop: int | None = None, max_drop: int = 8) -> DataFrame:
    """DU-aware repair of stored snapshots: ``rows`` has a snapshot's columns, delta (binary) and delta_state (its DU state).

    Results replace the snapshot's columns: ids, the candidate's geometry, du_delta_exact, full_window, exact (ids equal the full
    tokenization), decode_exact, reason and trials.
    """
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer)
    used = ["prefix", "prefix_len", "prefix_sha256", "native_ids", "native_spans", "du_state", "delta", "delta_state"]
    kept = [c for c in rows.columns if c not in used]
    state = F.col("delta_state")
    checked = rows.withColumn("_delta_error", arrays_error(state["ids"], state["parts"], state["bounds"]))

    def one(tok, s: _Snapshot, parts: list[bytes], bounds: list[int], delta: bytes, built: bytes) -> tuple[Search, list[int]]:
        starts, ends = s.starts.tolist(), s.ends.tolist()
        ids = Ids(s.ids.tolist(), [s.prefix[x:y] for x, y in zip(starts, ends, strict=True)])  # the validated spans tell pieces of equal ids apart
        oracle = tok.encode(s.prefix + delta)
        own = State(parts, bounds)
        build = lambda k: candidate_du(tok, ids, ends, s.size, own, built, k)
        return search(build, oracle if fixed_drop is None else None, drops_of(fixed_drop, max_drop)), oracle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.value
        for b in sliced(batches, "prefix"):
            out, du, delta_parts = [], b.column("du_state"), Parts(b.column("delta_state").field("parts"))
            parts, bounds = du.field("parts"), Numbers(du.field("bounds"))
            for i, (s, delta, wrong) in enumerate(zip(_snapshots(b), b.column("delta").to_pylist(), b.column("_delta_error").to_pylist(), strict=True)):
                delta, fault = delta or b"", s.fault()
                if fault or wrong:
                    out.append((Search(reason=fault if fault == "empty prefix" else f"invalid snapshot: {fault}" if fault else f"invalid delta: {wrong}"), None, None, None))
                    continue
                built = bytes(delta_parts.row(i)[0])
                got, oracle = one(tok, s, parts[i].as_py(), bounds.row(i).tolist(), delta, built)
                decoded = None if got.found is None else tok.decode(got.found.ids) == s.prefix + delta
                out.append((got, oracle, built == delta, decoded))
            found = [o[0].found for o in out]
            cols = [pa.array([f and f.ids for f in found], pa.list_(pa.int64()))]
            cols += [pa.array([getattr(f, n) if f else None for f in found], t) for n, t in _OUT.items()]
            cols += [pa.array([o[2] for o in out], pa.bool_()), pa.array([None if f is None else f.repair_start == 0 for f in found], pa.bool_())]
            cols += [pa.array([bool(f) and f.ids == o[1] for f, o in zip(found, out, strict=True)], pa.bool_()), pa.array([o[3] for o in out], pa.bool_())]
            cols += [pa.array([o[0].reason for o in out], pa.string()), pa.array([o[0].trials for o in out], pa.list_(_TRIAL))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *cols], [*kept, "ids", *_OUT, "du_delta_exact", "full_window", "exact", "decode_exact", "reason", "trials"])

    counts = ", ".join(f"{n} bigint" for n in _OUT)
    more = f"ids array<bigint>, {counts}, du_delta_exact boolean, full_window boolean, exact boolean, decode_exact boolean, reason string, trials array<struct<drop:bigint,window:bigint,exact:boolean,reason:string>>"
    return checked.mapInArrow(run, extended(rows.select(*kept).schema, more))


def gates(found: str = "") -> Column:
    """The first condition of a receipt that a row of ``repair_snapshots`` fails, or null: reason, delta, full window, ids, decode."""
    c = lambda n: F.col(found + n)
    return F.when(c("repair_start").isNull(), "reason").when(~c("du_delta_exact"), "delta").when(c("full_window"), "full window").when(~c("exact"), "ids").when(~c("decode_exact"), "decode")


def first_divergence(a: Column, b: Column) -> Column:
    """Null for equal arrays of ids, else index and both values (null past an end)."""
    n = F.greatest(F.size(a), F.size(b))
    at = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)))
    i = F.try_element_at(at, F.lit(1))
    return F.when((n > 0) & i.isNotNull(), F.struct((i - 1).cast("bigint").alias("index"), F.try_element_at(a, i).alias("left"), F.try_element_at(b, i).alias("right")))


def full_window(rows: DataFrame, tokenizer: Tokenizer, original: str = "fixture", restored: str = "restored") -> DataFrame:
    """V0: both byte strings tokenized whole; restore_exact, ids_exact, decode_exact and exit_code (0 or 2)."""
    given = rows.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = given.value
        for b in batches:
            out = []
            for x, y in zip(b.column(original), b.column(restored), strict=True):
                x, y = x.as_py() or b"", y.as_py() or b""
                p, q = tok.encode(x), tok.encode(y)
                out.append((x == y, p == q, tok.decode(p) == x and tok.decode(q) == y))
            cols = [pa.array([o[i] for o in out], pa.bool_()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols, pa.array([0 if o[0] and o[1] else 2 for o in out], pa.int64())], [*b.schema.names, "restore_exact", "ids_exact", "decode_exact", "exit_code"])

    return rows.mapInArrow(run, extended(rows.schema, "restore_exact boolean, ids_exact boolean, decode_exact boolean, exit_code bigint"))
