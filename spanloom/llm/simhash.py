"""SimHash near-dedup: byte-position inverted index with count filtering, then connected components.

Fingerprints that differ in at most ``MAX_BITS`` = 4 bits agree in at least ``NEED`` = 4 of their 8 byte positions. A plain
index of single positional bytes has only 2,048 posting lists, so its tally would grow with the square of the input;
postings are therefore joined several at a time: a key is a set of positions with their bytes, and the sets are chosen such
that any four agreeing positions contain one of them (7 sets of two, 20 of three, 70 of four).

Within a posting list, the shared positional bytes of pairs are tallied, pairs that reach the guaranteed minimum are kept, and
their Hamming distance is verified. Short lists do it for all pairs at once, others breadth-first over the members not yet
reached: a list of near copies is linked by a spanning tree, without its square of pairs being made. The lists' lengths are
counted first (combined before the shuffle). Members of a list longer than ``SPLIT_LIST`` are dealt anew by one more position,
up to four; beyond that by four more half-bytes of the other eight (at most four of these differ), where a list cannot hold
more than 65,536 fingerprints. So no task gathers a list of unbounded length, and no case is dropped at any size. Only
distinct fingerprints are ever indexed: a text repeated a million times is one entry. Links are then contracted by
alternating large-star and small-star steps, each written to the shared folder.

Defined cases: a null text counts as empty and has fingerprint zero, which is linked like any other; a null doc_id takes
part but is never a component_id unless its whole component is null; repeated rows each keep their row; other columns are
ignored (and kept by ``keep_one``); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, row_keyed, table

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BYTES = 8
NEED = BYTES - MAX_BITS
SMALL_LIST = 16
SPLIT_LIST = 4096
HOT_KEYS = 1 << 16
BLOCK = 1 << 15
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        h = np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=True)], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``carried`` and fp (the fingerprint as a signed long)."""
    kept = ["doc_id", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(fp)], [*kept, "fp"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, "text").mapInArrow(run, f"{kinds}, fp long")


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` positions such that any NEED agreeing positions contain one."""
    if width == NEED:
        return list(combinations(range(BYTES), NEED))
    groups = [range(0, 3), range(3, 6), range(6, 8)]
    if width == 2:  # of four positions in three groups, two share a group
        return [s for g in groups for s in combinations(g, 2)]
    # four positions hold three of one group, or else two of a group and one of the next: Turan's covering by triples
    return [s for s in combinations(range(BYTES), 3) if (k := [sum(p in g for p in s) for g in groups]) and (max(k) == 3 or any(k[i] == 2 and k[(i + 1) % 3] == 1 for i in range(3)))]


def choose_width(n: int) -> int:
    """Positions per key: some tens of strangers are expected to share a key by chance. Any choice gives the same links."""
    return 2 if n <= 1 << 22 else 3


def _linked(a: np.ndarray, b) -> np.ndarray:
    """Over aligned fingerprints: tally of shared positional bytes, then verification of the pairs that reach the minimum."""
    x = np.atleast_1d(np.bitwise_xor(a, b))
    good = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1) >= NEED
    good[good] = np.bitwise_count(x[good]) <= MAX_BITS
    return good


def _explore(fps: np.ndarray) -> list[np.ndarray]:
    """A spanning forest of the links among ``fps``, by breadth-first search over what is not yet reached."""
    out, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _linked(rest, at)
            if near.any():
                found = rest[near]
                out.append(np.stack([np.full(len(found), at), found], 1))
                queue.extend(found)
                rest = rest[~near]
    return out


def _link_sorted(key: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
    """Links within each run of equal keys."""
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    size = np.diff(bounds)
    out = []
    for i in np.flatnonzero(size > SMALL_LIST):
        out += _explore(np.unique(fp[bounds[i] : bounds[i + 1]]))
    small = np.repeat((size > 1) & (size <= SMALL_LIST), size)
    key, fp = key[small], fp[small]
    for shift in range(1, SMALL_LIST):  # all pairs of the short lists, a distance in the list at a time
        same = np.flatnonzero(key[shift:] == key[:-shift]) if len(key) > shift else np.empty(0, np.int64)
        if not len(same):
            break
        a, b = fp[same], fp[same + shift]
        good = _linked(a, b) & (a != b)
        out.append(np.stack([a[good], b[good]], 1))
    return out


def _nibble_key(fp: np.ndarray, nibbles: tuple[int, ...]) -> np.ndarray:
    """Which of the 16 half-bytes a key fixes (16 bits), and their values (at most 48 bits)."""
    key = np.zeros(len(fp), np.uint64)
    for i in nibbles:
        key = (key << np.uint64(4)) | ((fp >> np.uint64(4 * (15 - i))) & np.uint64(15))
    return key | np.uint64(sum(1 << i for i in nibbles) << 48)


def _positions(key: np.ndarray) -> np.ndarray:
    return key.view(np.uint64) >> np.uint64(48)


def postings(nodes: DataFrame, width: int) -> DataFrame:
    """fp and key for each set of ``width`` positions: a mask of half-bytes and their values."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * (7 - p)).bitwiseAND(F.lit(255))

    def key(s: tuple[int, ...]):
        mask, k = sum(3 << 2 * p for p in s) << 48, F.lit(0).cast("long")
        for p in s:
            k = F.shiftleft(k, 8).bitwiseOR(byte(p))
        return k.bitwiseOR(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))

    return nodes.select("fp", F.explode(F.array(*[key(s) for s in position_sets(width)])).alias("key"))


def deal_anew(posted: DataFrame) -> DataFrame:
    """fp and keys with more fixed than ``posted`` (fp, key) has: every link within a list is within a list of the result."""

    def more(mask: int) -> list[tuple[int, ...]]:
        fixed = tuple(i for i in range(16) if mask >> i & 1)
        left = [p for p in range(BYTES) if 2 * p not in fixed]
        if len(left) > BYTES - NEED:  # agreeing positions are too many to avoid all of these
            return [tuple(sorted((*fixed, 2 * p, 2 * p + 1))) for p in left[: len(left) - (NEED - len(fixed) // 2) + 1]]
        return [tuple(sorted((*fixed, *c))) for c in combinations([i for i in range(16) if i not in fixed], 8 - MAX_BITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            masks = _positions(key)
            for m in np.unique(masks):
                own = fp[masks == m]
                for nibbles in more(int(m)):
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(_nibble_key(own, nibbles).view(np.int64))], ["fp", "key"])

    return posted.mapInArrow(run, "fp long, key long").distinct()


def list_links(posted: DataFrame) -> DataFrame:
    """Pairs (u, v) of linked fingerprints within the lists of ``posted`` (fp, key), as many as connect what is linked."""
    dealt = posted.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs):
            if pairs := [p for p in pairs if len(p)]:
                p = np.concatenate(pairs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(p.max(1)), pa.array(p.min(1))], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            k, f = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            if held and len(k) and k[-1] == held[-1][0][-1]:  # still the same list
                held.append((k, f))
                continue
            held.append((k, f))
            k, f = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            yield from out(_link_sorted(k[:cut], f[:cut]) if cut else [])
            held = [(k[cut:], f[cut:])]
        if held:
            k, f = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from out(_link_sorted(k, f))

    return dealt.mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, width: int, split: int = SPLIT_LIST) -> DataFrame:
    """Pairs (u, v) of linked fingerprints that connect all that are linked. ``nodes``: distinct fp."""
    level, found = postings(nodes, width), []
    for _ in range(width, NEED + 1):
        hot = materialize(level.groupBy("key").count().where(F.col("count") > split).select("key"), "simhash-hot")
        n = hot.count()
        if not n:
            break
        long = F.broadcast(hot) if n <= HOT_KEYS else hot.hint("merge")
        found.append(list_links(level.join(long, "key", "left_anti")))
        level = materialize(deal_anew(level.join(long, "key", "left_semi")), "simhash-anew")
    found.append(list_links(level))  # no long list is left, or its keys fix 48 bits
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of ``edges`` (u, v): alternating large-star and small-star until nothing changes."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            m = materialize(m, "cc-min")  # then both sides of the join are exchanged, and a hub's rows can be split
            return both.where(F.col("v") > F.col("u")).join(m.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        rest = down.join(m.hint("merge"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return rest.unionByName(m.select("u", F.col("m").alias("v"))).distinct()

    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    e, was = edges, None
    while True:
        e = materialize(star(materialize(star(e, True), "cc-large"), False), "cc-small")
        now = state(e)
        if now == was or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = now


def grouped(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``carried``, fp, root (one fingerprint of each component) and component_id for every row of ``docs``."""
    fps = materialize(fingerprints(docs, carried), "simhash-fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    edges = materialize(links(nodes.select("fp"), choose_width(nodes.count())), "simhash-links")
    roots = components(edges)
    own = materialize(nodes.join(roots.hint("merge"), nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = materialize(own.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-components")
    named = materialize(own.join(least.hint("merge"), "root").select("fp", "root", "component_id"), "simhash-named")
    return fps.join(named.hint("merge"), "fp")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row of ``docs``."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component: the smallest doc_id's (null last), also where ids repeat."""
    rows = row_keyed(docs, "_simhash_row")
    every = grouped(rows.select("doc_id", "text", "_simhash_row"), ("_simhash_row",))
    first = every.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_simhash_row")).alias("first")).select(F.col("first._simhash_row").alias("_simhash_row"))
    return rows.join(materialize(first, "simhash-kept").hint("merge"), "_simhash_row", "left_semi").select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


ORACLE = None
