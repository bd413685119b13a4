"""Exact dedup, SimHash, sharding: against brute force, with ties, nulls, hot groups and repeated rows."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from spanloom.llm import exact_dedup as E
from spanloom.llm import sharding, simhash

DOCS = "doc_id long, text string, digest string"


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 5, 100, 3000):
        keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
        assert sorted(E.PerfectHash(keys).slot(keys)) == list(range(n))


def dedup_brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(low), []).append(i)
    keep = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((i, keep[(t or "").translate(low)], len(groups[(t or "").translate(low)]), i == keep[(t or "").translate(low)], hashlib.sha256((t or "").translate(low).encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("split", [None, 0, 300])
def test_exact_dedup(spark, split):
    r = random.Random(2)
    rows = [(i, r.choice(["Same", "same", "É", "é", None, "", "x" * 100_000, f"own {i}"])) for i in range(300)] + [(5, "again"), (5, "again"), (None, "again"), (None, "lonely null")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], DOCS)
    if split is None:
        got = E.dedup(df)
    else:
        got = E.dedup(df.where(f"coalesce(doc_id, 0) >= {split}"), df.where(f"coalesce(doc_id, 0) < {split}"))
    assert sorted((tuple(x) for x in got.collect()), key=str) == dedup_brute(rows)
    assert E.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("history", [None, "none", "half", "all"])
def test_exact_dedup_of_ids_beyond_doubles(spark, history):
    """Neighbouring ids that no double tells apart, with nulls among them on either side, in many shards."""
    r = random.Random(7)
    rows = [(r.choice([None, (1 << 53) + i, (1 << 60) + i, -(1 << 60) - i]), f"text {r.randrange(150)}") for i in range(500)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], DOCS)
    cut = {"none": 0, "half": 250, "all": 500}.get(history)
    frame = lambda part: spark.createDataFrame([(*x, "clash") for x in part], DOCS)
    got = E.dedup(df, shard_keys=16) if history is None else E.dedup(frame(rows[cut:]), frame(rows[:cut]), shard_keys=16)
    assert sorted((tuple(x) for x in got.collect()), key=str) == dedup_brute(rows)


def test_exact_dedup_of_string_ids(spark):
    rows = [(f"id{i:03}", f"t{i % 7}") for i in range(40)] + [(None, "t1"), (None, "alone")]
    got = E.dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((tuple(x) for x in got), key=str) == dedup_brute(rows)


def test_members_and_nonmembers_of_the_history(spark):
    frame = lambda rows: E.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    old, new = [(i, f"t{i}") for i in range(50)], [(100 + i, f"t{i}") for i in range(40, 90)] + [(300, "t60"), (301, "t45")]
    got = {r.digest.hex(): (r.keep_id, r.group_size, r.member) for r in E.group_results(frame(new), frame(old), shard_keys=8).collect()}
    key = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == 90 and got[key("t3")] == (3, 1, True) and got[key("t45")] == (301, 3, True) and got[key("t60")] == (300, 2, False) and got[key("t89")] == (189, 1, False)


def fingerprint_brute(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    r = random.Random(4)
    for t in [None, "", " \t\n", "One", "one  TWO\x0bthree", "é\u00a0x y z w", *(" ".join(r.choice("ab cd Ef\u2003 é".split(" ")) for _ in range(r.randrange(40))) for _ in range(100))]:
        assert simhash.fingerprint(t) == fingerprint_brute(t)


@pytest.mark.parametrize("width", [2, 3, 4])
def test_position_sets_cover(width):
    sets = [set(s) for s in simhash.position_sets(width)]
    assert len(sets) == {2: 7, 3: 20, 4: 70}[width]
    assert all(any(s <= set(f) for s in sets) for f in combinations(range(8), 4))


def union(fps):
    label = {int(f): int(f) for f in fps}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in combinations(sorted(label), 2):
        if bin(a ^ b).count("1") <= 4:
            label[find(a)] = find(b)
    return {frozenset(x for x in label if find(x) == k) for k in {find(x) for x in label}}


def cluster(r, n):
    """Near copies in chains and balls, and strangers."""
    out = {0, (1 << 64) - 1}
    for _ in range(6):
        at = r.getrandbits(64)
        for _ in range(n):
            out.add(at)
            x = at if r.random() < 0.7 else r.getrandbits(64)
            for b in r.sample(range(64), r.randrange(0, 6)):
                x ^= 1 << b
            at = x
    return sorted(out)


@pytest.mark.parametrize("width", [2, 3, 4])
def test_links_connect_what_brute_force_connects(spark, width):
    fps = cluster(random.Random(width), 40)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = simhash.links(df, width)
    pairs = [(r.u % (1 << 64), r.v % (1 << 64)) for r in edges.collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in pairs)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(edges).collect()}
    got = {}
    for f in fps:
        got.setdefault(roots.get(f, f), set()).add(f)
    assert {frozenset(v) for v in got.values()} == union(fps)


def found_by(spark, fps, width, split):
    edges = simhash.links(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long"), width, split)
    assert all(bin(r.u % (1 << 64) ^ r.v % (1 << 64)).count("1") <= 4 for r in edges.collect())
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(edges).collect()}
    got = {}
    for f in fps:
        got.setdefault(roots.get(f, f), set()).add(f)
    return {frozenset(v) for v in got.values()}


def test_long_lists_are_dealt_anew_exactly(spark):
    """Lists longer than three members at any number of fixed positions, down to keys that fix twelve half-bytes."""
    r = random.Random(9)
    near = {7 << 48 | r.getrandbits(16) for _ in range(60)} | {7 << 48 | 5 << 40 | sum(1 << r.randrange(32) for _ in range(3)) for _ in range(60)}
    fps = sorted(near | set(cluster(r, 15)))
    assert found_by(spark, fps, 2, 3) == union(fps)


def test_dealing_anew_loses_no_link():
    """Whatever four positions or more agree, a pair shares one key at every level."""
    r = random.Random(3)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for i in r.sample(range(64), r.randrange(1, 5)):
            b ^= 1 << i
        nibbles = {i for i in range(16) if a >> 4 * (15 - i) & 15 == b >> 4 * (15 - i) & 15}
        agree = [p for p in range(8) if {2 * p, 2 * p + 1} <= nibbles]
        assert len(agree) >= 4 and len(nibbles - {i for p in agree[:4] for i in (2 * p, 2 * p + 1)}) >= 4


def test_keep_one_of_repeated_and_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(5, base), (5, base + " tail"), (5, "another text altogether " * 3), (None, base), (None, "nobody has an id here"), (None, "nobody has an id here"), (9, None)]
    got = simhash.keep_one(spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, root string"))
    assert got.columns == ["doc_id", "text", "root"]
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    fp = [simhash.fingerprint(t) for _, t in rows]
    assert len(kept) == len(union(set(fp))) and (9, None) in kept and (None, "nobody has an id here") in kept and sum(i == 5 for i, _ in kept) == 2


def test_near_dedup(spark):
    r = random.Random(6)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(80)) for _ in range(10)]
    rows = [(i, base[i % 10] if i % 3 else base[i % 10] + " tail") for i in range(60)] + [(60, None), (61, ""), (7, base[3]), (None, base[3]), (None, "only a row without an id has this")]
    got = simhash.near_dedup(spark.createDataFrame([(*x, "clash") for x in rows], DOCS)).collect()
    fp = {(x.doc_id, x.fingerprint): x.component_id for x in got}
    assert len(got) == len(rows)
    groups = union({int(f, 16) for _, f in fp})
    for g in groups:
        ids = {i for i, f in fp if int(f, 16) in g} - {None}
        assert {fp[k] for k in fp if int(k[1], 16) in g} == {min(ids, default=None)}
    assert simhash.near_dedup(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 16, 1000])
def test_sharding_law_and_links(spark, n):
    r = random.Random(n)
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i % 97}" if i % 5 == 0 else f"own {i}" if i % 7 else None) for i in range(n)]
    got = sharding.shard(spark.createDataFrame([(*x, "clash") for x in rows], DOCS)).collect()
    assert sorted(x.doc_id for x in got) == sorted(i for i, _ in rows)
    by = {s: sorted(x.slot for x in got if x.shard == s) for s in range(16)}
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(v == list(range(len(v))) for v in by.values())
    import zlib

    text = dict(rows)
    assert all(x.size == len((text[x.doc_id] or "").encode()) + 1 and x.text_crc32 == zlib.crc32((text[x.doc_id] or "").encode()) for x in got)
    if n == 1000:
        apart = lambda shard_of: sum(len({shard_of[i] for i in g}) - 1 for g in groups)
        groups = [[i for i, t in rows if t == k] for k in {t for _, t in rows if t and not t.startswith("own")}]
        assert apart({x.doc_id: x.shard for x in got}) < 0.3 * apart({i: r.randrange(16) for i, _ in rows})


def test_sharding_of_null_and_repeated_ids(spark):
    """Rows that are equal in every column, ids that are null, repeated or strings: each row its own slot."""
    rows = [(None, "same")] * 200 + [(7, "same")] * 30 + [(7, f"own {i}") for i in range(30)] + [(None, None)] * 20
    for kind in ("long", "string"):
        given = [(i if i is None or kind == "long" else f"id{i}", t, 0) for i, t in rows]
        got = sharding.shard(spark.createDataFrame(given, f"doc_id {kind}, text string, shard int")).collect()
        assert sorted((x.doc_id is None, x.size) for x in got) == sorted((i is None, len(t or "") + 1) for i, t in rows)
        by = {s: sorted(x.slot for x in got if x.shard == s) for s in range(16)}
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(v == list(range(len(v))) for v in by.values())


def test_row_keys_are_unique_whatever_the_frame(spark, tmp_path):
    from pyspark.sql import functions as F

    from spanloom.llm.common import row_keyed

    spark.range(20).select("id", F.lit("t").alias("text")).repartition(3).write.parquet(f"{tmp_path}/p")
    spark.range(20).select("id", F.lit("t").alias("text")).write.json(f"{tmp_path}/j")
    rows = spark.read.parquet(f"{tmp_path}/p")
    twice = rows.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    frames = [(rows, 20), (rows.where("id > 4").select("id"), 15), (twice, 40), (rows.join(rows.select("id").withColumnRenamed("id", "j").limit(2), F.col("j") >= 0), 40), (rows.union(rows), 40), (spark.read.json(f"{tmp_path}/j"), 20), (spark.range(5), 5), (rows.withColumn("_metadata", F.lit(1)), 20)]
    for i, (df, n) in enumerate(frames):
        keyed = row_keyed(df, "key")
        first, again = sorted(map(str, keyed.collect())), sorted(map(str, keyed.select(*keyed.columns).collect()))
        assert first == again and keyed.select("key").distinct().count() == n, i
        assert ("file:" in str(first[0])) == (i < 2), i
