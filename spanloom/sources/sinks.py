"""Writers: JSON lines, packed ids, binary vocabularies and runs, receipts, fixtures. All go through Hadoop file systems."""

from __future__ import annotations

import hashlib
import json
import struct
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.bytestrings import to_hex
from spanloom.operators.validate import u32_ok


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_bytes(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> int:
    """Stream chunks into one file; folders are made. Returns the byte count."""
    fs, p = _fs(spark, path)
    out, n = fs.create(p, True), 0
    try:
        for c in chunks:
            out.write(bytearray(c))
            n += len(c)
    finally:
        out.close()
    return n


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def jsonl_line() -> Column:
    """The compact line of a token row: id, byte_start, byte_end, bytes_hex in this order."""
    return F.to_json(F.struct("id", "byte_start", "byte_end", to_hex(F.col("bytes")).alias("bytes_hex")))


def write_jsonl(tokens: DataFrame, path: str, compression: str | None = None, *, placed: bool = False) -> int:
    """One stream in the order of ``pos``; returns its rows. Sorted range partitions become part files in order.

    The rows are counted as they are written. ``placed``: partitions and their rows are in that order already and stay as they
    are. ``compression`` (such as ``gzip``) packs each part file; readers unpack it by its name.
    """
    seen = Observation("written")
    ordered = (tokens if placed else tokens.orderBy("pos")).select(jsonl_line().alias("value")).observe(seen, F.count("*").alias("n"))
    ordered.write.text(path, compression=compression)
    return seen.get["n"]


def pack_u32(ids: Iterable[int]) -> bytes:
    ids = list(ids)
    return struct.pack(f"<{len(ids)}I", *ids)


def write_u32(stream: DataFrame, path: str, column: str = "id", order: tuple[str, ...] = ("pos",)) -> int:
    """A stream's ids as little-endian 32-bit words in one file; an id that does not fit fails the query.

    Executors pack their sorted partitions; the driver, which writes the one file, passes packed blocks on, one partition at a time.
    """
    fits = F.when(u32_ok(F.col(column)), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("id does not fit 32 bits: "), F.col(column).cast("string"))).cast("bigint"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column("id").to_numpy().astype("<u4").tobytes()], pa.binary())], ["block"])

    blocks = stream.orderBy(*order).select(fits.alias("id")).mapInArrow(pack, "block binary")
    return write_bytes(stream.sparkSession, path, (bytes(r.block) for r in blocks.toLocalIterator()))


def model_bin_bytes(entries: list[bytes], magic: bytes = b"") -> bytes:
    return magic + struct.pack("<I", len(entries)) + b"".join(struct.pack("<I", len(e)) + e for e in entries)


def report_json(row: dict) -> str:
    """A one-row report, pretty, with a final newline."""
    return json.dumps(row, indent=2, ensure_ascii=False, default=str) + "\n"


def write_receipt(spark: SparkSession, folder: str, stem: str, row: dict, epoch: int | None = None) -> str:
    """``{stem}-{epoch}.json``; returns its path."""
    path = f"{folder}/{stem}-{int(time.time()) if epoch is None else epoch}.json"
    write_bytes(spark, path, [report_json(row).encode()])
    return path


def write_report(spark: SparkSession, folder: str, stem: str, row: dict, epoch: int | None = None) -> tuple[str, str]:
    """``report.json`` beside a receipt."""
    write_bytes(spark, f"{folder}/report.json", [report_json(row).encode()])
    return f"{folder}/report.json", write_receipt(spark, folder, stem, row, epoch)


def provenance(name: str, origin: str, raw: bytes, lines: bytes) -> dict:
    """The record beside a token fixture."""
    return {"tokenizer_name": name, "tokenizer_provenance": origin, "input_byte_length": len(raw), "input_sha256": hashlib.sha256(raw).hexdigest(), "token_count": lines.count(b"\n"), "fixture_sha256": hashlib.sha256(lines).hexdigest()}


def verify_fixture(spark: SparkSession, path: str, expected: bytes | Callable[[], bytes]) -> tuple[str, int]:
    """(OK, 0), (MISSING, 1) or (MISMATCH, 1); (DEPENDENCY, 2) where a function that makes the bytes lacks an optional library."""
    try:
        want = expected() if callable(expected) else expected
    except ImportError:
        return "DEPENDENCY", 2
    got = read_bytes(spark, path)
    return ("MISSING", 1) if got is None else ("OK", 0) if got == want else ("MISMATCH", 1)


def write_dense_ids(mapped: DataFrame, path: str) -> None:
    """A lexeme map as JSON lines, one for each gid in order: gid and its target ids."""
    mapped.orderBy("gid").select("gid", "target_ids").write.json(path)


def write_samples(rows: DataFrame, path: str) -> None:
    """Sample rows (crossings, failures) as JSON lines."""
    rows.write.json(path)
