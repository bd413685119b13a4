"""Column functions over byte strings: strict codecs, digests, mismatches, packed IDs. Offsets are bytes, never characters.

Built-in decoders are laxer than the formats here (odd hex, spare pad bits), so the strict ones wrap them and give null for
what they reject; ``*_error`` functions name the reason.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def hex_ok(s: Column) -> Column:
    return (F.length(s) % 2 == 0) & s.rlike("^[0-9A-Fa-f]*$")


def from_hex(s: Column) -> Column:
    """Strict: null unless an even number of hex digits."""
    return F.when(hex_ok(s), F.unhex(s))


def require(condition: Column, message: str, value: Column) -> Column:
    """``value`` where ``condition`` holds, else the query fails."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def to_base64(b: Column) -> Column:
    """One line, however long: the built-in function breaks lines after 76 digits."""
    return F.translate(F.base64(b), "\r\n", "")


def padded(s: Column) -> Column:
    return F.when(s.endswith("="), s).otherwise(F.rpad(s, F.length(s) + F.pmod(-F.length(s), F.lit(4)), F.lit("=")))


def base64_error(s: Column) -> Column:
    """Reason why ``s`` is no strict base64 (padding is optional), or null."""
    full = padded(s)
    pads = F.length(s) - F.length(F.rtrim(s, F.lit("=")))
    body = F.rtrim(s, F.lit("="))
    return (
        F.when(s == "", "empty")
        .when((pads > 2) | ((pads > 0) & (F.length(s) % 4 != 0)), "padding")
        .when(body.contains("="), "inner padding")
        .when(~body.rlike("^[A-Za-z0-9+/]*$"), "alphabet")
        .when(F.length(body) % 4 == 1, "length")
        .when(to_base64(F.try_to_binary(full, F.lit("base64"))) != full, "pad bits")
    )


def from_base64(s: Column) -> Column:
    return F.when(base64_error(s).isNull(), F.try_to_binary(padded(s), F.lit("base64")))


def sha256(b: Column) -> Column:
    return F.sha2(b, 256)


def ratio(a: Column, b: Column) -> Column:
    """Null on a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def u32le(ids: Column) -> Column:
    """Packed little-endian bytes of an array of IDs that fit 32 bits."""
    one = lambda x: F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)])
    return F.unhex(F.array_join(F.transform(ids, lambda x: one(x.cast("bigint"))), ""))


def ids_sha256(ids: Column) -> Column:
    return sha256(u32le(ids))


def byte_at(b: Column, offset: Column) -> Column:
    """Byte value at a 0-based offset, null past the end."""
    return F.when((offset >= 0) & (offset < F.octet_length(b)), F.conv(F.hex(F.substring(b, (offset + 1).cast("int"), F.lit(1))), 16, 10).cast("smallint"))


@F.pandas_udf(T.LongType())
def _mismatch(a: pd.Series, b: pd.Series) -> pd.Series:
    import numpy as np

    def one(x, y):
        if x is None or y is None:
            return None
        n = min(len(x), len(y))
        d = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
        return int(d[0]) if len(d) else None if len(x) == len(y) else n

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def first_mismatch(a: Column, b: Column) -> Column:
    """First differing byte offset; the shorter length if one is a prefix of the other; null if equal or null."""
    return _mismatch(a, b)


def mismatch_struct(expected: Column, actual: Column) -> Column:
    """Null if equal, else offset, the two bytes there and the two lengths."""
    at = first_mismatch(expected, actual)
    return F.when(at.isNotNull(), F.struct(
        at.alias("byte_offset"), byte_at(expected, at).alias("expected_byte"), byte_at(actual, at).alias("actual_byte"),
        F.octet_length(expected).cast("bigint").alias("expected_len"), F.octet_length(actual).cast("bigint").alias("actual_len"),
    ))


def valid_prefix_len(b: Column, most: Column) -> Column:
    """Largest k <= most such that the first k bytes are whole UTF-8 characters (``b`` itself is valid UTF-8)."""
    most = F.least(most.cast("int"), F.octet_length(b))
    # the cut is whole iff the byte behind it is no continuation byte; a character has three of these at most
    tail = lambda k: F.conv(F.hex(F.substring(b, (k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    whole = lambda k: (k >= F.octet_length(b)) | (F.coalesce(tail(k), F.lit(0)).bitwiseAND(F.lit(0xC0)) != 0x80)
    return F.coalesce(*[F.when(whole(most - i), most - i) for i in range(4)]).cast("bigint")


#: Fixed values of the dictionary format: control codes of a lexeme line.
TAB, SPACES, NEWLINE, TEXT_BEGIN, TEXT_END = "\x01", "\x02", "\x03", "\x04", "\x05"
_B64 = re.compile(r"[A-Za-z0-9+/]+={0,2}")


def decode_base64(s: str) -> bytes | None:
    body = s.rstrip("=")
    if not s or len(s) - len(body) > 2 or (body != s and len(s) % 4) or len(body) % 4 == 1 or not _B64.fullmatch(s):
        return None
    full = body + "=" * (-len(body) % 4)
    out = base64.b64decode(full)
    return out if base64.b64encode(out).decode() == full else None


def decode_lexeme(line: str) -> tuple[bytes | None, str | None]:
    """(bytes, error) of one dictionary line, read once from left to right."""
    out, at = bytearray(), 0
    while at < len(line):
        c = line[at]
        if c == "\0":
            return None, "nul"
        if c == TEXT_BEGIN:
            stop = line.find(TEXT_END, at + 1)
            if stop < 0:
                return None, "unterminated text"
            raw = decode_base64(line[at + 1 : stop])
            if raw is None:
                return None, "base64"
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError:
                return None, "utf-8"
            out += raw
            at = stop + 1
        elif c == SPACES:
            stop = line.find(SPACES, at + 1)
            if stop < 0:
                return None, "unterminated spaces"
            digits = line[at + 1 : stop]
            if not (digits.isascii() and digits.isdigit()):
                return None, "space count"
            out += b" " * int(digits)
            at = stop + 1
        else:
            out += {NEWLINE: b"\n", TAB: b"\t"}.get(c) or c.encode("utf-8")
            at += 1
    return bytes(out), None


@F.pandas_udf(T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("error", T.StringType())]))
def lexeme_decode(lines: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Struct of bytes and error for each dictionary line; null lines give nulls."""
    for s in lines:
        yield pd.DataFrame([(None, None) if x is None else decode_lexeme(x) for x in s], columns=["bytes", "error"])
