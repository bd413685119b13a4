"""Readers of the binary and text formats of token streams. Every reader checks sizes and fails closed.

Files are read by Spark's ``binaryFile`` and ``text`` sources, so any store that Spark reaches will do; formats without fixed
width are not splittable and take one task per file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.bytestrings import decode_lexeme, from_hex, hex_ok
from spanloom.operators.ranks import accumulated
from spanloom.schema import TOKEN_JSONL

MAX_TOKEN_BYTES = 1_000_000


def raw_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, stem, content of a folder's files with a suffix (or of one file); order them by ``path``, byte-wise."""
    df = spark.read.format("binaryFile").load(path)
    if suffix:
        df = df.where(F.col("path").endswith(suffix))
    return df.select("path", F.regexp_extract("path", r"([^/]*?)(?:\.[^/.]*)?$", 1).alias("stem"), "content")


def raw_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row: a whole file's bytes."""
    return raw_files(spark, path).select(F.col("content").alias("raw"))


def _blobs(df: DataFrame, read, schema: str, keep: list[str], columns: dict[str, pa.DataType]) -> DataFrame:
    """Rows that ``read(content)`` yields as arrays, with the ``keep`` columns repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                arrays = read(b.column("content")[i].as_py())
                n = len(arrays[0])
                own = [pa.array([b.column(k)[i].as_py()] * n, b.schema.field(k).type) for k in keep]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(a, t) for a, t in zip(arrays, columns.values(), strict=True)]], [*keep, *columns])

    return df.mapInArrow(run, schema)


def parse_model_bin(data: bytes, magic: bytes = b"", most: int | None = None) -> list[bytes]:
    """Entries of a length-prefixed vocabulary: u32 count, then u32 length and bytes each; the index is the id."""
    if not data.startswith(magic):
        raise ValueError("wrong magic")
    at = len(magic)
    if len(data) < at + 4:
        raise ValueError("missing count")
    (count,) = struct.unpack_from("<I", data, at)
    at += 4
    out = []
    for i in range(count):
        if len(data) < at + 4:
            raise ValueError(f"truncated length of entry {i}")
        (n,) = struct.unpack_from("<I", data, at)
        at += 4
        if most is not None and n > most:
            raise ValueError(f"entry {i} has {n} bytes")
        if len(data) < at + n:
            raise ValueError(f"truncated entry {i}")
        out.append(data[at : at + n])
        at += n
    if at != len(data):
        raise ValueError("trailing bytes")
    return out


def model_bin(spark: SparkSession, path: str, *, legacy: bool = False) -> DataFrame:
    """id, bytes; ``legacy`` files begin with a magic and bound the entries' size."""

    def read(data: bytes):
        e = parse_model_bin(data, b"MB01" if legacy else b"", MAX_TOKEN_BYTES if legacy else None)
        return range(len(e)), e

    return _blobs(raw_files(spark, path), read, "id bigint, bytes binary", [], {"id": pa.int64(), "bytes": pa.binary()})


def parse_dictionary(data: bytes) -> list[bytes]:
    """Lexemes of a dictionary file by line: one final empty line and one carriage return per line are dropped."""
    lines = data.decode("utf-8").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    out = []
    for i, line in enumerate(lines):
        got, error = decode_lexeme(line.removesuffix("\r"))
        if error:
            raise ValueError(f"dictionary line {i + 1}: {error}")
        out.append(got)
    return out


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """gid, bytes."""

    def read(data: bytes):
        e = parse_dictionary(data)
        return range(len(e)), e

    return _blobs(raw_files(spark, path), read, "gid bigint, bytes binary", [], {"gid": pa.int64(), "bytes": pa.binary()})


def unpack(data: bytes, width: int) -> np.ndarray:
    """Little-endian unsigned integers of 2, 3 or 4 bytes."""
    if width not in (2, 3, 4):
        raise ValueError(f"width {width} is not supported")
    if len(data) % width:
        raise ValueError(f"size {len(data)} is no multiple of {width}")
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    return sum(raw[:, i].astype(np.int64) << (8 * i) for i in range(width)) if len(raw) else np.empty(0, np.int64)


def packed(spark: SparkSession, path: str, width: int, suffix: str = "") -> DataFrame:
    """path, stem, pos, value of every file of fixed-width integers."""

    def read(data: bytes):
        v = unpack(data, width)
        return np.arange(len(v)), v

    return _blobs(raw_files(spark, path, suffix), read, "path string, stem string, pos bigint, value bigint", ["path", "stem"], {"pos": pa.int64(), "value": pa.int64()})


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line (from 1 within its file) and pos (from 0 over all lines that are not blank), in file order.

    Text splits are read in order; only their counts reach the driver, one row per split, and set the numbers off.
    """
    at = ["file", "block"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("_a", F.monotonically_increasing_id())
    solid = F.trim("value", F.lit(" \t\r\n\x0b\x0c")) != ""
    full = lines.where(solid).withColumn("_b", F.monotonically_increasing_id())
    counts = {tuple(r)[:2]: r for r in lines.groupBy(*at).agg(F.min("_a").alias("a"), F.count("*").alias("n"), F.count_if(solid).alias("solid")).collect()}
    rows, pos, line, last, starts, held = [], 0, 1, None, {}, {}
    for key, c in sorted(counts.items(), key=lambda x: x[1].a):  # a task's lines that are not blank are numbered through its splits
        task = c.a >> 33
        starts[key] = (task << 33) + held.get(task, 0)
        held[task] = held.get(task, 0) + c.solid
    for key in sorted(counts):
        line = 1 if key[0] != last else line
        rows.append((*key, counts[key].a - line, starts[key] - pos))
        line, pos, last = line + counts[key].n, pos + counts[key].solid, key[0]
    side = F.broadcast(spark.createDataFrame(rows, "file string, block bigint, _line bigint, _pos bigint"))  # one row per split
    return full.join(side, at).select("value", "file", (F.col("_a") - F.col("_line")).alias("line"), (F.col("_b") - F.col("_pos")).alias("pos"))


def token_jsonl(spark: SparkSession, path: str, doc_id: int = 0, stream: str = "source") -> DataFrame:
    """Token rows of a JSON-lines file in file order; blank lines are skipped, unknown keys ignored.

    A bad line fails the query, which names its number.
    """
    parsed = numbered_lines(spark, path).withColumn("r", F.from_json("value", TOKEN_JSONL, {"mode": "PERMISSIVE"}))
    bad = F.col("r").isNull() | F.col("r.id").isNull() | F.col("r.byte_start").isNull() | F.col("r.byte_end").isNull() | F.col("r.bytes_hex").isNull() | ~hex_ok(F.col("r.bytes_hex")) | (F.col("r.id") < 0)
    text = F.concat(F.lit("bad token line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"), F.lit(": "), F.left("value", F.lit(200)))
    id_ = F.when(bad, F.raise_error(text).cast("bigint")).otherwise(F.col("r.id"))
    return parsed.select(F.lit(doc_id).cast("bigint").alias("doc_id"), F.lit(stream).alias("stream"), "pos", id_.alias("id"), "r.byte_start", "r.byte_end", from_hex(F.col("r.bytes_hex")).alias("bytes"))


def _inclusive(rows: DataFrame, max_bytes: int | None) -> DataFrame:
    """Running bounds of one stream, and the rows up to the one that reaches ``max_bytes`` (at least the first)."""
    rows = accumulated(rows.withColumn("_n", F.octet_length("bytes").cast("bigint")), ["path", "local_pos"], "_n", "pos", "byte_end")
    rows = rows.withColumn("byte_start", F.col("byte_end") - F.col("_n")).drop("_n")
    if max_bytes is not None:
        rows = rows.where((F.col("byte_start") < max_bytes) | (F.col("pos") == 0))
    return rows


def _known(value, message: str):
    return F.when(value.isNull(), F.raise_error(F.lit(message)).cast("bigint"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def gmap_of(spark: SparkSession, path: str) -> str:
    """The folder of global ids of a run: ``gmap24`` where it is there, else ``gmap32``; neither is an error."""
    for name in ("gmap24", "gmap32"):
        if exists(spark, f"{path}/{name}"):
            return name
    raise ValueError(f"{path} has neither gmap24 nor gmap32")


def du_vocabulary_size(spark: SparkSession, path: str) -> int:
    """Entries of a run's dictionary."""
    return dictionary(spark, f"{path}/merged.dict").count()


def du_run(spark: SparkSession, path: str, *, gmap: str | None = None, max_bytes: int | None = None, doc_id: int = 0) -> DataFrame:
    """Token rows of a dictionary-encoded run: local ids, their global ids by file, and the lexemes' bytes.

    ``gmap``: ``gmap24`` or ``gmap32``; by default the one that is there. A local or global id without an entry fails the query.
    """
    gmap = gmap or gmap_of(spark, path)
    local = packed(spark, f"{path}/local_u16", 2, ".u16").withColumnRenamed("pos", "local_pos")
    if gmap not in ("gmap24", "gmap32"):
        raise ValueError(f"{gmap} is not supported")
    maps = packed(spark, f"{path}/{gmap}", 3 if gmap == "gmap24" else 4, f".{gmap}").select("stem", F.col("pos").alias("value"), F.col("value").alias("gid"))
    lexemes = dictionary(spark, f"{path}/merged.dict")
    rows = local.join(maps, ["stem", "value"], "left")
    rows = rows.withColumn("gid", F.coalesce("gid", _known(F.col("gid"), "local id out of range")))
    rows = rows.join(lexemes.withColumn("known", F.lit(1)), "gid", "left").withColumn("gid", F.coalesce(F.when(F.col("known") == 1, F.col("gid")), _known(F.col("known"), "global id out of range")))
    rows = rows.select(F.lit(doc_id).cast("bigint").alias("doc_id"), F.lit("du").alias("stream"), "path", "local_pos", F.col("gid").alias("id"), "bytes")
    return _inclusive(rows, max_bytes).select("doc_id", "stream", "pos", "id", "byte_start", "byte_end", "bytes")


def target_run(spark: SparkSession, path: str, *, max_bytes: int | None = None, doc_id: int = 0) -> DataFrame:
    """Token rows of ``tokens.u32`` with the bytes of ``model.bin``."""
    from spanloom.operators.vocabulary import bytes_of

    ids = packed(spark, f"{path}/tokens.u32", 4).select("path", F.col("pos").alias("local_pos"), F.col("value").alias("id"))
    rows = bytes_of(ids, model_bin(spark, f"{path}/model.bin")).select(F.lit(doc_id).cast("bigint").alias("doc_id"), F.lit("target").alias("stream"), "path", "local_pos", "id", "bytes")
    return _inclusive(rows, max_bytes).select("doc_id", "stream", "pos", "id", "byte_start", "byte_end", "bytes")


def ranked_vocabulary(spark: SparkSession, path: str, *, id_offset: int = 0, entries: int | None = None) -> DataFrame:
    """id, bytes of a text file of ``base64 rank`` lines; ``id_offset`` empty entries stand before them.

    With ``entries`` the ids must be exactly 0 to ``entries`` - 1, each once, or it is an error.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), " ")
    own = lines.select((parts[1].cast("bigint") + id_offset).alias("id"), F.to_binary(parts[0], F.lit("base64")).alias("bytes"))
    out = spark.range(id_offset).select("id", F.unhex(F.lit("")).alias("bytes")).unionByName(own)
    if entries is not None:
        n, distinct, least, most = out.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
        if (n, distinct, least, most) != (entries, entries, 0 if entries else None, entries - 1 if entries else None):
            raise ValueError(f"ids of {path}: {n} entries, {distinct} distinct, from {least} to {most}; expected 0 to {entries - 1}")
    return out
