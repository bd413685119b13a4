"""Alignment, validation, ledger, segmentation and repair: exhaustive and golden cases."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from spanloom.functions.tokenizers import GreedyTokenizer, RegexTokenizer
from spanloom.operators import align, bridge, ledger, remap, repair, segment, spans, validate, vocabulary
from spanloom.operators.views import LEXEMES, WORDS
from spanloom.schema import TOKENS


def cut(doc, stream, parts):
    out, at = [], 0
    for pos, p in enumerate(parts):
        b = p.encode() if isinstance(p, str) else p
        out.append((doc, stream, pos, 100 + pos, at, at + len(b), b))
        at += len(b)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, TOKENS)


def test_all_partitions_of_eight_bytes(spark):
    """All 128 x 128 pairs of partitions, as 16,384 documents: sweep, arrays and the plain definition agree."""
    parts = []
    for mask in range(128):
        ends = [i + 1 for i in range(7) if mask >> i & 1] + [8]
        parts.append(list(zip([0, *ends[:-1]], ends, strict=True)))
    left = spark.createDataFrame([(m, i, i, a, b) for m in range(128) for i, (a, b) in enumerate(parts[m])], "m int, pos bigint, id bigint, byte_start bigint, byte_end bigint")
    pairs = spark.range(128).select(F.col("id").cast("int").alias("r"))
    l = left.crossJoin(pairs).select((F.col("m") * 128 + F.col("r")).cast("bigint").alias("doc_id"), "pos", "id", "byte_start", "byte_end")
    r = left.withColumnRenamed("m", "r").crossJoin(pairs.withColumnRenamed("r", "m")).select((F.col("m") * 128 + F.col("r")).cast("bigint").alias("doc_id"), "pos", "id", "byte_start", "byte_end")
    want = {}
    for x, y in product(range(128), repeat=2):
        starts, ends = {a for a, _ in parts[y]}, {b for _, b in parts[y]}
        for i, (a, b) in enumerate(parts[x]):
            hit = [j for j, (c, d) in enumerate(parts[y]) if c < b and d > a]
            want[x * 128 + y, i] = (hit[0], hit[-1] + 1, len(hit), a in starts, b in ends)
    got = {(v.doc_id, v.left_index): (v.right_start, v.right_end, v.covered, v.starts_on, v.ends_on) for v in align.align_tokens(l, r).collect()}
    assert got == want
    some = F.col("doc_id") % 97 == 0
    plain = {(v.doc_id, v.left_index): (v.right_start, v.right_end, v.covered, v.starts_on, v.ends_on) for v in align.align_join(l.where(some), r.where(some)).collect()}
    assert plain == {k: v for k, v in want.items() if k[0] % 97 == 0}
    arrays = spark.createDataFrame([(x * 128 + y, [b - a for a, b in parts[x]], [b - a for a, b in parts[y]]) for x, y in product(range(0, 128, 5), repeat=2)], "doc_id bigint, a array<int>, b array<int>")
    by_arrays = {v.doc_id: tuple(v[3:]) for v in align.length_stats(arrays, "a", "b").collect()}
    by_rows = {v.doc_id: tuple(v[1:]) for v in align.boundary_stats(align.align_tokens(l, r)).collect()}
    assert by_arrays == {k: by_rows[k] for k in by_arrays}


@pytest.mark.parametrize(("spans_", "error"), [
    ([(0, 2, b"he"), (3, 5, b"lo")], ("gap", 1, 1)), ([(0, 3, b"hel"), (2, 5, b"llo")], ("overlap", 1, -1)), ([(0, 5, b"hullo")], ("bytes", 0, 1)), ([(0, 0, b"")], ("empty", 0, None)),
    ([(0, 9, b"hello")], ("beyond", 0, None)), ([(0, 2, b"he")], ("trailing", None, 3)), ([(0, 5, b"hello")], (None, None, None)), ([(0, -1, b"")], ("reversed", 0, None)), ([(1, 0, b"")], ("gap", 0, 1)),
])
def test_validation(spark, spans_, error):
    rows = [(1, "s", i, i, a, b, x) for i, (a, b, x) in enumerate(spans_)]
    docs = spark.createDataFrame([(1, b"hello")], "doc_id bigint, raw binary")
    r = validate.token_errors(frame(spark, rows), docs)
    assert tuple(r.first())[2:] == error
    if error[0]:
        with pytest.raises(Exception, match=error[0]):
            validate.strict(r).collect()


def test_streamless_documents(spark):
    docs = spark.createDataFrame([(1, b"x"), (2, b"")], "doc_id bigint, raw binary")
    r = {x.doc_id: x.error_code for x in validate.token_errors(frame(spark, cut(3, "s", ["q"])), docs).collect()}
    assert r == {1: "trailing", 2: None}


def test_bridge_golden(spark):
    rows = cut(1, "source", ["hé", "界"]) + cut(1, "du", ["h", "é", "界"]) + cut(1, "target", ["hé界"])
    rows += cut(2, "source", ["abcd", "ef"][:1] + ["ef"]) + cut(2, "du", ["abc", "def"]) + cut(2, "target", ["a", "bcd", "ef"])
    docs = spark.createDataFrame([(1, "hé界".encode()), (2, b"abcdef")], "doc_id bigint, raw binary")
    t = frame(spark, rows)
    r = {x.doc_id: x for x in bridge.report(t, docs).collect()}
    assert r[1].source_to_du_max_covered == 2 and r[1].du_to_target_cross_or_cut == 3 and r[1].target_to_du_exact == 1
    assert r[2].source_to_du_cross_or_cut == 2 and r[2].target_to_du_max_covered == 2 and all(x.source_exact and x.du_exact and x.target_exact and x.mismatch_stream is None for x in r.values())


def test_ledger_golden(spark):
    docs = spark.createDataFrame([(1, b"abcdefg")], "doc_id bigint, raw binary")
    d, t = frame(spark, cut(1, "du", ["ab", "cde", "fg"])), frame(spark, cut(1, "target", ["ab", "cd", "efg"]))
    r = ledger.ledger(docs, d, t, 100).first()
    assert (r.exact, r.cross_or_cut, r.start_inside, r.end_inside, r.max_covered, r.du_tokens) == (1, 2, 1, 1, 2, 3)
    assert ledger.ledger(docs, d, t, 0).first().fraction_exact is None
    s = ledger.crossing_samples(d, t, 1, 1).first()
    assert (s.sample, s.left_index, s.right_start, s.right_end, s.context_start, s.context_end) == (1, 1, 1, 2, 0, 3)


def test_ranges_cuts_chunks(spark):
    t = frame(spark, cut(1, "s", ["ab", "cde", "f"]))
    ranges = spark.createDataFrame([(1, a, b) for a in range(7) for b in range(a, 8)], "doc_id bigint, lo bigint, hi bigint")
    for a in range(7):
        for r in spans.reconstruct_range(t, ranges.where(f"lo = {a} AND hi = {a + 1} OR lo = {a} AND hi = 7").limit(1)).collect():
            assert (None if r.hi > 6 else b"abcdef"[r.lo : r.hi]) == (None if r.bytes is None else bytes(r.bytes))
    assert [x.pos for x in spans.prefix_cut(t, 0).collect()] == [0]
    assert sorted(x.pos for x in spans.prefix_cut(t, 3).collect()) == [0, 1]
    chunks = spark.range(1).select(*[spans.reset_chunks(F.lit(v).cast("array<int>"), 4).alias(f"c{i}") for i, v in enumerate(([3, 3, 3], [4], [], [1]))]).first()
    assert tuple(chunks) == (2, 1, 0, 1)


V = [(0, b"a"), (1, b"ab"), (2, b"ab"), (3, b"b"), (9, b"")]


def test_greedy_and_minimum():
    p = segment.Pieces(V)
    assert p.greedy(b"abab") == ([1, 1], None) and p.greedy(b"abc") == (None, 2) and p.greedy(b"") == ([], None) and p.minimum(b"") == [] and p.minimum(b"xa") is None
    q = segment.Pieces([(0, b"a"), (1, b"aa"), (2, b"aab"), (3, b"b"), (4, b"aaa")])
    assert q.greedy(b"aaab") == ([4, 3], None) and q.minimum(b"aaab") == [0, 2]  # ties keep the longest last piece


def test_remap_golden(spark):
    vocab = spark.createDataFrame([(0, b"a"), (1, b"b"), (2, b"ab"), (3, b"c")], "id bigint, bytes binary")
    lex = spark.createDataFrame([(0, b"ab"), (1, b"c"), (2, b"ba")], "gid bigint, bytes binary")
    m = remap.build_map(lex, vocab)
    assert {r.gid: r.target_ids for r in m.collect()} == {0: [2], 1: [3], 2: [1, 0]}
    assert tuple(remap.map_size(m).first()) == (3, 4, 16, 48)
    assert {r.gid: r.ids for r in segment.segment_join(lex, vocab).collect()} == {0: [2], 1: [3], 2: [1, 0]}
    stream = spark.createDataFrame([(1, 0, 2), (1, 1, 0)], "doc_id bigint, pos bigint, gid bigint")
    assert [(r.pos, r.sub, r.target_id) for r in remap.expand(stream, m).orderBy("pos", "sub").collect()] == [(0, 0, 1), (0, 1, 0), (1, 0, 2)]
    s = remap.summary(stream, m, vocab, 1).first()
    assert (s.positions, s.emitted, s.du_bytes, s.target_bytes, s.distinct_gids, s.chunks) == (2, 3, 4, 4, 2, 2) and s.du_sha256 == s.target_sha256
    with pytest.raises(Exception, match="gid 1"):
        remap.build_map(lex, vocab.where("id < 3")).collect()
    with pytest.raises(Exception, match="out of range"):
        remap.expand(stream.withColumn("gid", F.lit(7)), m).collect()
    total, failed = remap.coverage(lex, vocab.where("id < 3"))
    assert total.first().bad_types == 1 and [(r.gid, r.failed_at) for r in failed.collect()] == [(1, 0)]
    with pytest.raises(Exception, match="out of range"):
        vocabulary.bytes_of(spark.createDataFrame([(77,)], "id bigint"), vocab).collect()


class Scripted:
    """A tokenizer of single bytes that merges "bc" only when both are in one window."""

    def encode(self, raw):
        out, at = [], 0
        while at < len(raw):
            k = 2 if raw[at : at + 2] == b"bc" else 1
            out.append(int.from_bytes(raw[at : at + k], "big"))
            at += k
        return out

    def decode(self, ids):
        return b"".join(i.to_bytes(2 if i > 255 else 1, "big") for i in ids)


@pytest.mark.parametrize("version", [1, 2])
def test_repair_golden(spark, version):
    rows = spark.createDataFrame([(1, b"xyab", b"cd"), (2, b"ab", b""), (3, b"b", b"c"), (4, b"", b"q"), (5, b"xy", b"z")], "k int, prefix binary, delta binary")
    r = {x.k: x for x in repair.repair(rows, Scripted(), version=version, max_drop=2).collect()}
    assert (r[1].drop, r[1].tail, r[1].window, r[1].exact, len(r[1].trials)) == (1, 1, 3, True, 2)
    assert r[1].ids == Scripted().encode(b"xyabcd")
    assert (r[2].drop, r[2].window, r[2].exact) == (0, 0, True) and (r[5].drop, r[5].exact) == (0, True)
    assert r[3].drop is None and [t.reason for t in r[3].trials] == [None, repair.FULL, repair.DROP] and not r[3].exact
    assert r[4].reason == "empty prefix"
    f = {x.k: x for x in repair.repair(rows, Scripted(), version=version, fixed_drop=1).collect()}
    assert f[1].exact and f[3].reason == repair.FULL and f[5].exact


def test_forbidden_full_window_never_tokenizes():
    class Never:
        def encode(self, raw):
            raise AssertionError

        def decode(self, ids):
            return b""

    with pytest.raises(repair.Rejected, match="full window"):
        repair.candidate_v1(Never(), b"a", [97], b"x", 1)
    with pytest.raises(repair.Rejected, match="full window"):
        repair.candidate_v2(Never(), b"a", [97], [1], b"x", 1)


def test_kept_bytes_must_be_a_prefix():
    class Odd:
        def decode(self, ids):
            return b"other"

    with pytest.raises(repair.Rejected, match="prefix"):
        repair.candidate_v1(Odd(), b"abc", [1, 2], b"", 0)


BASES = ["plain words here", "a  b   ", "\n\n\n", "x = {'k': 1}", "w" * 70, "Zwölf 世界 ", "\t", "1234 5678"]
DELTAS = ["x", "'", "42", "...", "é", "\n", "y" * 64, "mixed 世界 text\n" * 16, ""]


def test_append_matrix(spark):
    vocab = [(i, bytes([i])) for i in range(256)] + [(300 + i, w.encode()) for i, w in enumerate(["  ", "words", "wo", "www", "wwwww", " h", "here", "12", "34 5", "\n\n", "yyyy", "世", "é"])]
    for tok in (RegexTokenizer(WORDS), GreedyTokenizer(vocab)):
        rows = spark.createDataFrame([(b.encode(), d.encode()) for b in BASES for d in DELTAS], "prefix binary, delta binary")
        out = repair.repair(rows, tok, max_drop=12).collect()
        assert len(out) == len(BASES) * len(DELTAS)
        for r in out:
            full = tok.encode(bytes(r.prefix) + bytes(r.delta))
            assert r.ids == full if r.exact else r.reason is not None
    assert sum(r.exact for r in out) >= 0.8 * len(out)


def test_bridge_rows_and_columns_agree(spark):
    """Token rows and columns give the same report, also where streams are missing, spoilt or empty; strict fails there."""
    rows = cut(1, "source", ["hé", "界"]) + cut(1, "du", ["h", "é", "界"]) + cut(1, "target", ["hé界"]) + cut(2, "source", ["ab"]) + cut(2, "du", ["x", "b"]) + cut(2, "target", ["a", "b"])
    rows += cut(3, "source", ["a"])
    docs = spark.createDataFrame([(1, "hé界".encode()), (2, b"ab"), (3, b"a"), (4, b"")], "doc_id bigint, raw binary")
    got = {r.doc_id: r for r in bridge.report(frame(spark, rows), docs).collect()}
    parts = {(d, s): [b for doc, st, *_, b in rows if (doc, st) == (d, s)] for d in range(1, 5) for s in bridge.STREAMS}
    views = spark.createDataFrame([(d.doc_id, d.raw, *[parts[d.doc_id, s] for s in bridge.STREAMS]) for d in docs.collect()], "doc_id bigint, raw binary, source array<binary>, du array<binary>, target array<binary>")
    assert {r.doc_id: r for r in bridge.report_columns(views).collect()} == got
    assert (got[2].du_exact, got[2].mismatch_stream, got[2].mismatch_offset) == (False, "du", 0) and (got[3].mismatch_stream, got[3].mismatch_offset) == ("du", 0) and got[4].target_exact
    with pytest.raises(Exception, match="stream du does not rebuild document"):
        bridge.strict(bridge.report(frame(spark, rows), docs)).collect()
    assert bridge.strict(bridge.report(frame(spark, rows), docs.where("doc_id IN (1, 4)"))).count() == 2


def test_ledger_of_lengths_equals_rows(spark):
    import random

    r = random.Random(2)
    texts = ["".join(r.choice("ab é 界 ") for _ in range(r.randrange(60))) for _ in range(40)] + [""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    from spanloom.operators.views import cap, lengths, tokens

    raw = d.select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    views = d.select("doc_id", F.octet_length("text").cast("bigint").alias("raw_len"), lengths(F.col("text"), WORDS).alias("du"), lengths(F.col("text"), cap(5)).alias("target"))
    for limit in (0, 7, 30, 1000):
        for legacy in (False, True):
            rows = ledger.ledger(raw, tokens(d, "doc_id", WORDS, "du"), tokens(d, "doc_id", cap(5), "target"), limit, legacy=legacy)
            assert sorted(map(str, rows.collect())) == sorted(map(str, ledger.ledger_lengths(views, limit, legacy=legacy).collect()))


def test_target_du_span_with_empty_tokens():
    bounds = [0, 2, 2, 5, 5, 7]
    for s in range(7):
        for e in range(s + 1, 8):
            lo = max(i for i, b in enumerate(bounds) if b <= s)
            hi = min(i for i, b in enumerate(bounds) if b >= e)
            assert align.target_du_span(bounds, s, e) == (lo, hi, hi - lo, s in bounds, e in bounds)


def test_translate_equals_summary(spark):
    import random

    r = random.Random(5)
    lex = [(i, w) for i, w in enumerate([b"ab", b"c", b"ba", "é".encode(), b"abcabc"])]
    vocab = spark.createDataFrame([(i, bytes([i])) for i in range(256)] + [(300, b"ab"), (301, b"abc")], "id bigint, bytes binary")
    docs = {d: [r.choice(lex) for _ in range(r.randrange(1, 50))] for d in range(20)}
    stream = spark.createDataFrame([(d, i, g) for d, v in docs.items() for i, (g, _) in enumerate(v)], "doc_id bigint, pos bigint, gid bigint")
    rows = remap.summary(stream, remap.build_map(spark.createDataFrame(lex, "gid bigint, bytes binary"), vocab), vocab, 7)
    views = spark.createDataFrame([(d, [b for _, b in v]) for d, v in docs.items()], "doc_id bigint, parts array<binary>")
    columns = remap.translate(views, vocab, 7)
    assert sorted(map(str, rows.collect())) == sorted(map(str, columns.collect()))
    raw = spark.createDataFrame([(d, b"".join(b for _, b in v) + (b"x" if d == 3 else b"")) for d, v in docs.items()], "doc_id bigint, raw binary")
    assert {x.doc_id: x.exact for x in remap.triangle(columns, raw).collect()} == {d: d != 3 for d in docs}
    with pytest.raises(Exception, match="cannot be mapped"):
        remap.translate(views, vocab.where("id <> 99"), 7).collect()


def test_decoder_and_round_trip(spark):
    d = segment.Decoder([(0, b"a"), (1, b""), (5, "é".encode()), (9, b"xyz")])
    import numpy as np

    assert d.decode(np.array([9, 0, 1, 5, 9])) == b"xyza" + "é".encode() + b"xyz" and d.decode(np.array([], np.int64)) == b"" and d.decode(np.array([2])) is None and d.decode(np.array([10])) is None and d.decode(np.array([-1])) is None
    assert segment.Decoder([(1 << 40, b"q")]).decode(np.array([1 << 40])) == b"q" and segment.Decoder([]).decode(np.array([3])) is None
    vocab = spark.createDataFrame(V, "id bigint, bytes binary")
    rows = spark.createDataFrame([(1, b"abab"), (2, b"abc"), (3, b""), (4, None)], "k int, bytes binary")
    got = {r.k: r for r in segment.round_trip(rows, vocab).collect()}
    import hashlib

    assert (got[1].n_ids, got[1].n_bytes, got[1].decoded_sha256, got[1].exact) == (2, 4, hashlib.sha256(b"abab").hexdigest(), True)
    assert got[2].n_ids is None and not got[2].exact and got[3].n_bytes == got[4].n_bytes == 0
    back = segment.decode(segment.segment(rows, vocab), vocab)
    assert {r.k: r.decoded for r in back.collect()} == {1: b"abab", 2: None, 3: b"", 4: None}


def stored(spark, rows):
    """Snapshots of (doc_id, prefix, delta), with the delta's DU state."""
    df = spark.createDataFrame(rows, "doc_id bigint, prefix binary, delta binary")
    out = repair.snapshot(df.select("doc_id", "prefix"), Scripted(), Pairs()).join(df.drop("prefix"), "doc_id")
    return repair.du_state("delta", Pairs(), out, "delta_state")


class Pairs:
    """A DU tokenizer of two bytes at a time."""

    def encode(self, raw):
        return [int.from_bytes(raw[i : i + 2], "big") << 1 | (i + 1 == len(raw)) for i in range(0, len(raw), 2)]

    def decode(self, ids):
        return b"".join((i >> 1).to_bytes(1 if i & 1 else 2, "big") for i in ids)


def test_du_aware_repair(spark):
    """The tail comes from the DU state across its lexemes; empty deltas, full windows, exhaustion and broken inputs."""
    s = stored(spark, [(1, b"xyab", b"cd"), (2, b"ab", b""), (3, b"b", b"c"), (4, b"", b"q"), (5, b"xyz", b"z")])
    r = {x.doc_id: x for x in repair.repair_snapshots(s, Scripted(), max_drop=2).withColumn("gate", repair.gates()).collect()}
    assert (r[1].drop, r[1].repair_start, r[1].tail, r[1].window, r[1].exact, len(r[1].trials), r[1].gate) == (1, 3, 1, 3, True, 2, None)
    assert r[1].ids == Scripted().encode(b"xyabcd") and r[1].du_delta_exact and r[1].decode_exact and not r[1].full_window
    assert (r[2].drop, r[2].window, r[2].repair_start, r[2].exact) == (0, 0, 2, True) and r[2].ids == Scripted().encode(b"ab")
    assert r[3].drop is None and [t.reason for t in r[3].trials] == [None, repair.FULL, repair.DROP] and r[3].gate == "reason"
    assert r[4].reason == "empty prefix" and (r[5].drop, r[5].exact) == (0, True)
    fixed = {x.doc_id: x for x in repair.repair_snapshots(s, Scripted(), fixed_drop=0).withColumn("gate", repair.gates()).collect()}
    assert fixed[1].gate == "ids" and fixed[5].gate is None
    spoilt = s.withColumn("prefix_sha256", F.when(F.col("doc_id") == 1, "0").otherwise(F.col("prefix_sha256")))
    d = F.col("delta_state")
    spoilt = spoilt.withColumn("delta_state", F.when(F.col("doc_id") == 5, F.struct(d["ids"].alias("ids"), d["parts"].alias("parts"), F.transform(d["bounds"], lambda b: b * 2).alias("bounds"))).otherwise(d))
    spoilt = spoilt.withColumn("delta", F.when(F.col("doc_id") == 2, F.lit(b"other")).otherwise(F.col("delta")))
    r = {x.doc_id: x for x in repair.repair_snapshots(spoilt, Scripted()).withColumn("gate", repair.gates()).collect()}
    assert r[1].reason == "invalid snapshot: hash" and not r[1].trials and r[5].reason == "invalid delta: sum" and not r[5].exact and r[2].du_delta_exact is False


def test_du_tail_and_start_checks():
    s = repair.State([b"ab", b"", b"cde"], [0, 2, 2, 5])
    assert all(s.bytes_from(i, j) == b"abcde"[i:j] for i in range(6) for j in range(i, 6))

    class Never:
        def encode(self, raw):
            raise AssertionError

    for ends, size, reason in (([0], 5, repair.FULL), ([7], 5, repair.OUTSIDE), ([3], 6, repair.TAIL)):
        with pytest.raises(repair.Rejected, match=reason):
            repair.candidate_du(Never(), [1], ends, size, s, b"x", 0)
    with pytest.raises(repair.Rejected, match=repair.DROP):
        repair.candidate_du(Never(), [1], [1], 5, s, b"x", 2)


def test_turns_equal_rows(spark):
    """One pass over a conversation gives what independent rows give."""
    import hashlib
    import random

    r = random.Random(8)
    turns = [(c, t, r.choice([None, "", "the ", "  two", "words here", "x\\n\\n", "é世"])) for c in range(12) for t in range(r.randrange(1, 9))]
    df = spark.createDataFrame(turns, "conv_id bigint, turn int, text string")
    for tok in (RegexTokenizer(WORDS), Scripted()):
        for version, fixed in ((1, None), (2, None), (2, 1)):
            rows = repair.repair(repair.appends(df), tok, version=version, fixed_drop=fixed, max_drop=3).collect()
            one = lambda x: (x.conv_id, x.turn, x.drop, x.kept, x.repair_start, x.tail, x.window, x.fresh, x.exact, x.reason)
            want = {(*one(x), None if x.ids is None else hashlib.sha256(",".join(map(str, x.ids)).encode()).hexdigest(), len(x.trials)) for x in rows}
            got = {(*one(x), x.ids_sha256, x.n_trials) for x in repair.repair_turns(df, tok, version=version, fixed_drop=fixed, max_drop=3).collect()}
            assert got == want
    h = repair.histogram(repair.repair_turns(df, RegexTokenizer(WORDS)), ["conv_id"])
    assert h.count() == 12 and h.agg(F.sum("cases")).first()[0] == len(turns)


@pytest.fixture
def small_batches(spark):
    """Two rows a batch, and one plan from first to last."""
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_turns_over_batches_give_the_rows_trials(spark, small_batches):
    """Conversations that begin and end inside batches, null and NaN keys, null and repeated turns."""
    turns = [(c, None if t == 5 else t // 2, "xyab c"[(i + t) % 5 :] if t % 4 else None) for i, c in enumerate((1.0, None, float("nan"), 2.0, -3.0)) for t in range(3 + i)]
    df = spark.createDataFrame(turns, "conv_id double, turn int, text string")
    for tok in (RegexTokenizer(WORDS), Scripted()):
        for version, fixed in ((1, None), (2, None), (2, 1)):
            rows = repair.repair(repair.appends(df), tok, version=version, fixed_drop=fixed, max_drop=3)
            got = repair.repair_turns(df, tok, version=version, fixed_drop=fixed, max_drop=3, trials=True)
            seen = [sorted(map(str, x.select("conv_id", "turn", "drop", "window", "exact", "reason", "trials").collect())) for x in (rows, got)]
            assert seen[0] == seen[1] and len(seen[0]) == len(turns)


def test_trials_send_each_text_once(spark, small_batches, tmp_path):
    """The bytes sent to Python grow with the texts, not with the square of a conversation."""
    from spanloom.plans.repairs import repair_trials

    text = "some words " * 20
    spark.createDataFrame([(1, i, text) for i in range(100)], "conv_id bigint, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = repair_trials(spark, str(tmp_path))
    assert len(out.collect()) >= 99

    def nodes(plan):
        kids = plan.children()
        return [plan, *(n for i in range(kids.size()) for n in nodes(kids.apply(i)))]

    sent = [n.metrics().apply("pythonDataSent").value() for n in nodes(out._jdf.queryExecution().executedPlan()) if n.nodeName() == "MapInArrow"]
    assert len(sent) == 1 and 0 < sent[0] < 10 * 100 * len(text)


def test_snapshot_errors_in_order(spark):
    good = stored(spark, [(1, b"xyab", b"")]).first().asDict(recursive=True)
    span = lambda i, **more: [s | more if j == i else s for j, s in enumerate(good["native_spans"])]
    cases = [
        ({}, None), ({"prefix": b""}, "empty prefix"), ({"prefix_len": 9}, "length"), ({"prefix_sha256": "0"}, "hash"), ({"du_state": {"ids": [1], "parts": [b"xy"], "bounds": [0, 2]}}, "du rebuild"),
        ({"native_ids": [1]}, "count"), ({"native_ids": [], "native_spans": []}, "no spans"), ({"native_spans": span(1, id=7)}, "span id"), ({"native_spans": span(1, byte_start=0)}, "contiguity"),
        ({"native_spans": span(0, byte_end=0)}, "empty span"), ({"native_spans": span(3, byte_end=5)}, "range"), ({"native_spans": span(2, bytes_hex="6")}, "hex"), ({"native_spans": span(2, bytes_hex="zz")}, "hex"),
        ({"native_spans": span(2, bytes_hex="62")}, "bytes"), ({"native_spans": span(2, bytes_hex="6161")}, "bytes"), ({"native_spans": good["native_spans"][:3], "native_ids": good["native_ids"][:3]}, "final end"),
        ({"native_spans": [s | {"bytes_hex": "6G"} if j == 0 else s | {"id": 7} if j == 1 else s for j, s in enumerate(good["native_spans"])]}, "hex"), ({"native_spans": span(0, bytes_hex="78".upper())}, None),
    ]
    from spanloom.schema import SNAPSHOT

    rows = spark.createDataFrame([tuple({**good, "doc_id": i, **change}[c] for c in ("doc_id", "prefix", "prefix_len", "prefix_sha256", "native_ids", "native_spans", "du_state")) for i, (change, _) in enumerate(cases)], SNAPSHOT)
    assert [r.error for r in repair.snapshot_errors(rows).orderBy("doc_id").collect()] == [e for _, e in cases]
    with pytest.raises(Exception, match="32 bits"):
        repair.snapshot(spark.createDataFrame([(1, b"abc")], "doc_id bigint, prefix binary"), Wide(), Pairs()).collect()


class Wide(Pairs):
    def encode(self, raw):
        return [i + (1 << 40) for i in Pairs.encode(self, raw)]

    def decode(self, ids):
        return Pairs.decode(self, [i - (1 << 40) for i in ids])


def test_pieces_that_share_an_id(monkeypatch):
    """The piece that was encoded last is the one that its id decodes to."""
    from spanloom.functions import tokenizers

    monkeypatch.setattr(tokenizers, "piece_id", lambda raw: len(raw))
    t = RegexTokenizer(WORDS)
    for text in (b"ab cd", b"xy", b"ab cd", b"xy zzz"):
        assert t.decode(t.encode(text)) == text


def test_one_text_with_pieces_that_share_an_id(spark):
    """Different words of equal hash in one text keep their own bytes, in rows, states, snapshots and repairs."""
    from spanloom.functions.tokenizers import piece_id
    from spanloom.operators import fixtures
    from spanloom.operators.views import from_loaded

    a, b = clashing_words()
    assert a != b and piece_id(a) == piece_id(b)
    text = a + b"\n" + b + b"\n" + a
    t = RegexTokenizer(LEXEMES)
    assert t.decode(t.encode(text)) == text and t.decode(t.encode(text)[:3] + t.encode(b"x")) == a + b"\n" + b + b"x"
    d = spark.createDataFrame([(1, text.decode())], "doc_id bigint, text string")
    rows = fixtures.records(d, RegexTokenizer(LEXEMES), "native").orderBy("pos").collect()
    assert b"".join(bytes(r.bytes) for r in rows) == text
    raw = d.select("doc_id", F.encode("text", "UTF-8").alias("prefix"))
    s = repair.du_state("prefix", RegexTokenizer(LEXEMES), raw, "s").select("doc_id", "s.*")
    assert b"".join(bytes(r.bytes) for r in from_loaded(s, "du").orderBy("pos").collect()) == text
    assert [r.error for r in repair.snapshot_errors(repair.snapshot(raw, RegexTokenizer(LEXEMES), RegexTokenizer(LEXEMES))).collect()] == [None]
    turns = spark.createDataFrame([(1, 0, text.decode()), (1, 1, " more")], "conv_id bigint, turn int, text string")
    found = repair.repair_turns(turns, RegexTokenizer(LEXEMES), version=1).where("turn = 1").first()
    assert found.exact and found.drop == 0


def test_stored_snapshots_with_pieces_that_share_an_id(spark):
    a, b = clashing_words()
    tok = RegexTokenizer(LEXEMES)
    d = spark.createDataFrame([(1, a + b" " + b, b" more")], "doc_id bigint, prefix binary, delta binary")
    s = repair.snapshot(d, tok, tok)
    r = repair.repair_snapshots(repair.du_state("delta", tok, s, "delta_state"), tok).withColumn("gate", repair.gates()).first()
    assert (r.exact, r.decode_exact, r.gate, r.drop) == (True, True, None, 0)


def clashing_words() -> tuple[bytes, bytes]:
    """The first two numbered words whose ids are the same."""
    from spanloom.functions.tokenizers import piece_id

    seen = {}
    for i in range(1 << 20):
        w = b"w%d" % i
        if (other := seen.setdefault(piece_id(w), w)) != w:
            return other, w
    raise AssertionError("no clash")


def test_the_tokenizer_forgets(monkeypatch):
    from spanloom.functions import tokenizers

    monkeypatch.setattr(tokenizers, "KNOWN_PIECES", 10)
    t = RegexTokenizer(WORDS)
    for i in range(100):
        assert t.decode(t.encode(b"w%d x%d" % (i, i))) == b"w%d x%d" % (i, i) and len(t.known) <= 12 >= len(t.seen)


def test_snapshots_keep_other_columns_and_pass_in_slices(spark, monkeypatch):
    from spanloom.operators import columns

    rows = [(i, b"word %d  x" % i * (i % 3), i % 5, b"d%d" % i) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id bigint, prefix binary, turn int, delta binary")
    monkeypatch.setattr(columns, "SLICE_BYTES", 20)
    tok = RegexTokenizer(LEXEMES)
    s = repair.du_state("delta", tok, repair.snapshot(d, tok, tok), "delta_state")
    assert sorted((r.doc_id, bytes(r.prefix), r.turn, bytes(r.delta)) for r in s.collect()) == rows
    assert {r.error for r in repair.snapshot_errors(s.where("prefix <> X''")).collect()} == {None}
    assert s.where("prefix <> X''").count() == repair.repair_snapshots(s, tok).where("exact").count()


def test_sliced_batches_lose_nothing():
    import pyarrow as pa

    from spanloom.operators.columns import Numbers, Parts, sliced

    texts = [b"a" * n for n in (0, 5, 50, 1, 1, 1, 0, 9)] + [None]
    lists = [[t or b"", b"x"] for t in texts]
    b = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(lists, pa.list_(pa.binary())), pa.array([[len(x)] for x, _ in lists])], ["t", "l", "n"])
    got = list(sliced(iter([b]), "t", most=6))
    assert [r for g in got for r in g.to_pylist()] == b.to_pylist() and max(g.num_rows for g in got) < 6
    assert [bytes(Parts(g.column("l")).row(i)[0]) for g in got for i in range(g.num_rows)] == [x + y for x, y in lists]
    assert [Numbers(g.column("n")).row(i).tolist() for g in got for i in range(g.num_rows)] == [[len(x)] for x, _ in lists]


TEXTS = [(1, "Zé wörd  a\n\tlong stony"), (2, ""), (3, None), (4, "x"), (5, " é世 " * 40), (6, "ab cd")]


def test_map_only_forms_equal_token_rows(spark):
    """Operators on one row per document give what those on token rows give, without an exchange."""
    from spanloom.operators.views import cap, gathered, id_of, lengths, parts, tokens

    d = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    raw, text = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.col("text")
    t = {n: tokens(d, "doc_id", p, n) for n, p in (("source", WORDS), ("du", LEXEMES), ("target", cap(5)))}
    rows = lambda f: sorted((tuple(r) for r in f.collect()), key=str)
    views = d.select("doc_id", F.transform(parts(text, WORDS), id_of).alias("ids"), lengths(text, WORDS).alias("source"), lengths(text, LEXEMES).alias("du"), lengths(text, cap(5)).alias("target"))
    pairs = [(align.align_tokens(t["source"], t["du"]), align.align_lengths(views, "ids", "source", "du")), (ledger.crossing_samples(t["du"], t["target"], 5), ledger.crossing_lengths(views, 5))]
    bytes_ = d.where("text <> ''").select("doc_id", F.lit("du").alias("stream"), parts(text, LEXEMES).alias("du"))
    pairs.append((spans.reconstruct(t["du"]), spans.reconstruct_parts(bytes_, "du")))
    for lo, hi in ((0, 0), (1, 4), (3, 40), (0, 1), (2, 1)):
        ranges = d.select("doc_id", F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi"))
        pairs.append((spans.reconstruct_range(t["du"], ranges), spans.reconstruct_range_parts(bytes_.join(F.broadcast(ranges), "doc_id").select("doc_id", "stream", "lo", "hi", "du"), "du")))
    own = d.select("doc_id", "text", raw.alias("raw"))
    short = F.when(F.col("doc_id") == 5, F.slice("t", F.lit(1), F.lit(9))).otherwise(F.col("t"))
    spoilt = t["source"].where("doc_id <> 5 OR pos < 9")
    pairs.append((validate.token_errors(spoilt, own.select("doc_id", "raw"), ("source",)), validate.gathered_errors(gathered(own, "doc_id", WORDS, "source").withColumn("t", short))))
    for x, y in pairs:
        assert rows(x) == rows(y.select(*x.columns)) and rows(x)
    for f in [t["du"], *[y for _, y in (pairs[0], pairs[1], pairs[2], pairs[-1])]]:
        assert "Exchange" not in f._jdf.queryExecution().executedPlan().toString()


def test_lane_counts_equal_single_searches():
    import random

    r = random.Random(3)
    vocab = list(enumerate([b"a", b"b", b" ", b"ab", b"aba", b"bb", b"  ", b"abab"]))
    for own in (vocab, [*vocab, (9, b"b a")]):
        for lacking in (own, [x for x in own if x[1] != b"b"]):
            p, q = segment.Pieces(lacking), segment.Pieces(lacking)
            for _ in range(200):
                s = bytes(r.choices(b"ab \n", (4, 4, 2, 0.1), k=r.randrange(12)))
                for lexemes in ([x for x in segment._RUNS.findall(s)], [s[:3], s[3:]]):
                    greedy = lambda x: len(q.greedy(x)[0] or ())  # noqa: B023, E731
                    assert p.counts(s, lexemes) == (sum(map(greedy, lexemes)), greedy(s), len(q._minimum(s) or ()))


def test_single_lexemes_are_not_kept():
    """Distinct lexemes of a dictionary come once each, so a worker keeps none of them."""
    p = segment.Pieces([(i, bytes([i])) for i in range(256)])
    assert [len(p.packed(b"w%d" % i)[0]) for i in range(1000)] == [8 * len(b"w%d" % i) for i in range(1000)] and not p.known
    assert len(p.packed(b"two words two")[0]) == 8 * 13 and set(p.known) == {b"two", b" ", b"words"}
