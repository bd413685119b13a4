"""Scalar functions and strict decoders, table-driven."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import bytestrings as B


@pytest.mark.parametrize(("line", "want"), [
    ("a\x03b\x01c\x023\x02", b"a\nb\tc   "), ("\x045LiW55WM\x05", "世界".encode()), ("plain", b"plain"), ("", b""), ("a\x05b", b"a\x05b"), ("\x020\x02x", b"x"),
    ("\x04YQ==\x05\x04YQ\x05", b"aa"), ("\x04Cg\x05\x03", b"\n\n"),
])
def test_lexeme_decodes(line, want):
    assert B.decode_lexeme(line) == (want, None)


@pytest.mark.parametrize(("line", "error"), [("\x04YWJ=x\x05", "base64"), ("\x02oops\x02", "space count"), ("\x02\x02", "space count"), ("\x04abc", "unterminated text"), ("a\0", "nul"), ("\x04YWJ\x05", "base64"), ("\x04\x05", "base64"), ("\x04/w\x05", "utf-8"), ("\x0212", "unterminated spaces")])
def test_lexeme_errors(line, error):
    assert B.decode_lexeme(line) == (None, error)


def test_base64_column_equals_scalar(spark):
    cases = ["", "YWI=", "YWI", "YWJ=", "YWJ", "Y", "YQ==", "YQ=", "YQ===", "=YQ=", "Y=Q=", "YW*j", "YWJj", "YWJjZA", "AA==", "AB==", "////", "++++", "YWJj\n"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = {r.s: (bytes(r.b) if r.b is not None else None, r.e) for r in df.select("s", B.from_base64(F.col("s")).alias("b"), B.base64_error(F.col("s")).alias("e")).collect()}
    for c in cases:
        assert got[c][0] == B.decode_base64(c), c
        assert (got[c][1] is None) == (got[c][0] is not None)


def test_hex_is_strict(spark):
    df = spark.createDataFrame([("abc",), ("0aFF",), ("",), ("0g",), (None,)], "s string")
    assert [r[0] and bytes(r[0]) if r[0] is not None else None for r in df.select(B.from_hex(F.col("s"))).collect()] == [None, b"\x0a\xff", b"", None, None]


def test_first_mismatch(spark):
    cases = [(b"abc", b"abc", None), (b"abc", b"abd", 2), (b"ab", b"abc", 2), (b"", b"", None), (b"", b"x", 0), (None, b"", None)]
    df = spark.createDataFrame([c[:2] for c in cases], "a binary, b binary")
    rows = df.select(B.first_mismatch(F.col("a"), F.col("b")).alias("m"), B.mismatch_struct(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.m for r in rows] == [c[2] for c in cases]
    assert rows[1].s.asDict() == {"byte_offset": 2, "expected_byte": 99, "actual_byte": 100, "expected_len": 3, "actual_len": 3}
    assert rows[2].s.expected_byte is None and rows[2].s.actual_byte == 99 and rows[0].s is None


def test_ratio_packing_and_trim(spark):
    r = spark.range(1).select(
        B.ratio(F.lit(1), F.lit(0)).alias("zero"), B.ratio(F.lit(1), F.lit(4)).alias("quarter"), B.u32le(F.array(F.lit(1), F.lit(258).cast("bigint"))).alias("packed"),
        *[B.valid_prefix_len(F.encode(F.lit("aé世🙂"), "UTF-8"), F.lit(n)).alias(f"n{n}") for n in range(12)],
    ).first()
    assert r.zero is None and r.quarter == 0.25 and bytes(r.packed) == bytes([1, 0, 0, 0, 2, 1, 0, 0])
    raw = "aé世🙂".encode()
    for n in range(12):
        k = min(n, len(raw))
        while True:
            try:
                raw[:k].decode()
                break
            except UnicodeDecodeError:
                k -= 1
        assert r[f"n{n}"] == k
