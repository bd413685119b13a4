"""The queries over whole texts and all rows, against plain Python on texts longer than any prefix in use."""

import base64
import re

import pytest

from spanloom.operators.views import WORDS, cap
from spanloom.plans import catalog

TEXTS = {1: "Zé wörd  a\n\tlong stony " * 200, 2: "short", 3: "é" * 1500 + " x", 4: "", 5: "ab", 6: "abc", 7: "x" * 999 + " limit", 8: "a" * 1000}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(f"i{i}", t) for i, t in TEXTS.items()], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def bounds(text, pattern):
    out, at = [], 0
    for p in re.findall(pattern, text):
        out.append((at, at + len(p.encode())))
        at = out[-1][1]
    return out


def brute_ledger(text, legacy):
    du, target = bounds(text, WORDS), bounds(text, cap(5))
    starts, ends = {a for a, _ in du}, {b for _, b in du}
    covered = [sum(x < b and y > a for x, y in du) for a, b in target]
    crossing = [a not in starts or b not in ends or (legacy and n != 1) for (a, b), n in zip(target, covered, strict=True)]
    n, exact = len(target), crossing.count(False)
    share = exact / n if n else None
    return (len(text.encode()), n, exact, n - exact, sum(a not in starts for a, _ in target), sum(b not in ends for _, b in target), max(covered, default=0), len(du), round(share, 6) if legacy and n else share)


@pytest.mark.parametrize("name,legacy", [("span_ledger", False), ("span_ledger_legacy", True)])
def test_ledgers_count_whole_texts(spark, folder, name, legacy):
    got = {r[0]: tuple(r)[1:] for r in catalog.QUERIES[name](spark, folder).select("doc_id", "byte_limit", "target_tokens", "exact", "cross_or_cut", "start_inside", "end_inside", "max_covered", "du_tokens", "fraction_exact").collect()}
    assert got == {i: brute_ledger(t, legacy) for i, t in TEXTS.items()}


def test_tokenizer_records_take_whole_texts(spark, folder):
    got = sorted((r.doc_id, r.pos, r.byte_start, r.byte_end) for r in catalog.QUERIES["tokenizer_records"](spark, folder).collect())
    assert got == [(i, k, a, b) for i, t in TEXTS.items() for k, (a, b) in enumerate(bounds(t, WORDS))]


def test_hex_codes_whole_texts(spark, folder):
    got = {(r.doc_id, r.variant): r.decoded for r in catalog.QUERIES["hex_codec"](spark, folder).collect()}
    assert got == {(i, v): t.encode().hex().upper() if v < 2 else None for i, t in TEXTS.items() for v in range(4)}


def test_base64_codes_whole_texts_of_any_padding(spark, folder):
    assert {base64.b64encode(t.encode()).count(b"=") for t in TEXTS.values()} == {0, 1, 2}
    got = {(r.doc_id, r.variant): (r.decoded, r.error) for r in catalog.QUERIES["base64_strict"](spark, folder).collect()}
    want = {}
    for i, t in TEXTS.items():
        good = (t.encode().hex().upper(), None) if t else (None, "empty")
        errors = ["pad bits" if len(t.encode()) % 3 else "length", "alphabet", "empty", "inner padding", "padding"]
        want |= {(i, v): good if v < 2 else (None, errors[v - 2]) for v in range(7)}
    assert got == want


def test_jsonl_holds_all_items(spark, folder):
    got = sorted((r.pos, r.byte_start, r.byte_end, bytes.fromhex(r.bytes_hex)) for r in catalog.QUERIES["jsonl_roundtrip"](spark, folder).collect())
    assert b"".join(r[3] for r in got) == "".join(TEXTS.values()).encode()
    whole = [p.encode() for t in TEXTS.values() for p in re.findall(WORDS, t)]
    ends = [sum(map(len, whole[: k + 1])) for k in range(len(whole))]
    assert got == [(k, e - len(p), e, p) for k, (p, e) in enumerate(zip(whole, ends, strict=True))]


def test_corrupted_bytes_differ_even_from_a_nul(spark, tmp_path):
    """The third token's second byte is spoilt, whatever it was."""
    spark.createDataFrame([(6, "a b \x00"), (14, "a b \x00c"), (22, "a b c"), (30, "a b é")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[2:] for r in catalog.QUERIES["validate_corrupted"](spark, str(tmp_path)).collect()}
    assert got == {i: ("bytes", 2, 1) for i in (6, 14, 22, 30)}


def test_jsonl_moves_no_token_rows(spark, folder, monkeypatch):
    """Documents are put in order, not tokens; the lines are written packed, in the order of the stream."""
    from spanloom.sources import files, sinks

    seen = {}

    def write(tokens, path, *args, **more):
        seen["plan"], seen["path"] = tokens._jdf.queryExecution().optimizedPlan().toString(), path
        return own(tokens, path, *args, **more)

    own = sinks.write_jsonl
    monkeypatch.setattr(sinks, "write_jsonl", write)
    n = catalog.QUERIES["jsonl_roundtrip"](spark, folder).count()
    assert n == sum(len(re.findall(WORDS, t)) for t in TEXTS.values())
    above = seen["plan"][: seen["plan"].index("Generate")]
    assert "Sort" not in above and "Repartition" not in above
    raw = b"".join(bytes(r.bytes) for r in files.token_jsonl(spark, seen["path"]).orderBy("pos").collect())
    assert raw == "".join(TEXTS.values()).encode()
