"""Command line and the functions behind it: ``python -m spanloom.cli COMMAND``.

Commands: doctor, hex, smoke, lexeme-decode, span-ledger, bridge-jsonl, remap, repair, repair-du. Reports go to standard output and, with
``--receipts``, to a receipt file.
"""

from __future__ import annotations

import argparse
import hashlib
import platform
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import bytestrings as B
from spanloom.functions.tokenizers import HttpTokenizer
from spanloom.operators import bridge, ledger, remap, repair, validate
from spanloom.operators.vocabulary import usable
from spanloom.sources import files, sinks

MAX_BYTES = 2_000_000


def doctor(spark: SparkSession) -> dict:
    return {"python": platform.python_version(), "spark": spark.version, "master": spark.sparkContext.master, "default_parallelism": spark.sparkContext.defaultParallelism}


def hex_of(spark: SparkSession, path: str) -> str:
    return files.raw_bytes(spark, path).select(B.to_hex(F.col("raw"))).first()[0]


def smoke(raw: bytes) -> dict:
    """Bytes survive hex and back."""
    again = bytes.fromhex(raw.hex())
    return {"bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest(), "exact": again == raw}


def lexeme(line: str) -> bytes:
    out, error = B.decode_lexeme(line)
    if error:
        raise ValueError(f"lexeme: {error}")
    return out


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return files.raw_bytes(spark, path).select(F.lit(0).cast("bigint").alias("doc_id"), "raw")


def span_ledger(spark: SparkSession, raw: str, du_run: str, target: str, max_bytes: int = MAX_BYTES, gmap: str | None = None) -> dict:
    """The ledger of one run: its counters, whether both prefixes rebuild the raw bytes, and up to 80 samples."""
    docs, du, tg = _raw(spark, raw), files.du_run(spark, du_run, gmap=gmap, max_bytes=max_bytes), files.target_run(spark, target, max_bytes=max_bytes)
    row = ledger.ledger(docs, du, tg, max_bytes).first().asDict()
    for name, t in (("du", du), ("target", tg)):
        here = F.substring("raw", (F.col("byte_start") + 1).cast("int"), F.octet_length("bytes"))
        row[f"{name}_exact"] = t.where(F.col("byte_end") <= row["byte_limit"]).join(docs, "doc_id").where(here != F.col("bytes")).isEmpty()
    row["samples"] = [r.asDict() for r in ledger.crossing_samples(du, tg.where(F.col("byte_end") <= row["byte_limit"])).orderBy("sample").collect()]
    return row


def bridge_jsonl(spark: SparkSession, raw: str, source: str, du: str, target: str) -> dict:
    """Three token files over one raw file: validated (the first error raises), aligned and summarised."""
    docs, t = _raw(spark, raw), None
    for name, path in zip(bridge.STREAMS, (source, du, target), strict=True):
        own = files.token_jsonl(spark, path, stream=name)
        t = own if t is None else t.unionByName(own)
    validate.strict(validate.token_errors(t, docs, bridge.STREAMS)).collect()
    return bridge.report(t, docs).first().asDict()


def remap_run(spark: SparkSession, raw: str, du_run: str, vocabulary: str, chunk_bytes: int, gmap: str | None = None) -> dict:
    """Map a run's dictionary into a vocabulary, expand its stream, and compare raw, DU and target bytes by length and digest."""
    vocab, stream = usable(files.model_bin(spark, vocabulary)), files.du_run(spark, du_run, gmap=gmap)
    mapped = remap.build_map(files.dictionary(spark, f"{du_run}/merged.dict"), vocab)
    summed = remap.summary(stream.select("doc_id", "pos", F.col("id").alias("gid")), mapped, vocab, chunk_bytes)
    row = remap.triangle(summed, _raw(spark, raw)).first().asDict() | remap.map_size(mapped).first().asDict()
    return row | {"raw_sha256": files.raw_bytes(spark, raw).select(F.sha2("raw", 256)).first()[0], "vocabulary_size": files.du_vocabulary_size(spark, du_run)}


def repair_files(spark: SparkSession, server: str, prefix: str, delta: str, *, version: int = 2, max_drop: int = 8, fixed_drop: int | None = None, tokenizer=None) -> dict:
    """Repair of one append against a tokenizer server: the candidate's geometry, its trials, and whether it is exact."""
    row = spark.createDataFrame([tuple(sinks.read_bytes(spark, p) or b"" for p in (prefix, delta))], "prefix binary, delta binary")
    out = repair.repair(row, tokenizer or HttpTokenizer(server), version=version, max_drop=max_drop, fixed_drop=fixed_drop).drop("prefix", "delta").first().asDict(recursive=True)
    return out | {"n_ids": len(out.pop("ids") or ())}


def _du_state(run: DataFrame, name: str) -> DataFrame:
    """One row: the DU state of one run's token rows; a snapshot holds it whole."""
    rows = run.agg(F.array_sort(F.collect_list(F.struct("pos", "id", "bytes", "byte_end"))).alias("t"))
    pick = lambda f: F.transform("t", lambda x: x[f])
    return rows.select(F.struct(pick("id").alias("ids"), pick("bytes").alias("parts"), F.concat(F.array(F.lit(0).cast("bigint")), pick("byte_end")).alias("bounds")).alias(name))


def repair_du_files(spark: SparkSession, server: str, prefix: str, delta: str, spans: str, prefix_run: str, delta_run: str, *, max_drop: int = 8, fixed_drop: int | None = None, tokenizer=None) -> dict:
    """DU-aware repair of one append: a snapshot from a prefix, its native token lines and its DU run, and the delta's DU run.

    The report has the candidate, its trials and digests; ``gate`` names the first condition that failed, or is null.
    """
    raw, more = (sinks.read_bytes(spark, p) or b"" for p in (prefix, delta))
    native = files.token_jsonl(spark, spans).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "byte_start", "byte_end", B.to_hex(F.col("bytes")).alias("bytes_hex")))).alias("t"))
    native = native.select(F.transform("t", lambda x: x["id"]).alias("native_ids"), F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["byte_start"].alias("byte_start"), x["byte_end"].alias("byte_end"), x["bytes_hex"].alias("bytes_hex"))).alias("native_spans"))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    row = spark.createDataFrame([(0, raw, len(raw), digest(raw), more)], "doc_id bigint, prefix binary, prefix_len bigint, prefix_sha256 string, delta binary")
    for one in (native, _du_state(files.du_run(spark, prefix_run), "du_state"), _du_state(files.du_run(spark, delta_run), "delta_state")):
        row = row.join(one.withColumn("doc_id", F.lit(0).cast("bigint")), "doc_id")  # one row each
    found = repair.repair_snapshots(row, tokenizer or HttpTokenizer(server), max_drop=max_drop, fixed_drop=fixed_drop)
    out = found.withColumns({"gate": repair.gates(), "ids_sha256": B.ids_sha256(F.col("ids")), "n_ids": F.size("ids")}).drop("doc_id", "ids").first().asDict(recursive=True)
    return out | {"prefix_sha256": digest(raw), "delta_sha256": digest(more), "full_sha256": digest(raw + more), "drop_selection": "search" if fixed_drop is None else "fixed", "exact": out["gate"] is None}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spanloom", description=__doc__.splitlines()[0])
    p.add_argument("--receipts", help="folder for receipt files")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor")
    sub.add_parser("hex").add_argument("path")
    sub.add_parser("smoke").add_argument("path")
    d = sub.add_parser("lexeme-decode")
    one = d.add_mutually_exclusive_group(required=True)
    one.add_argument("line", nargs="?")
    one.add_argument("--file")
    s = sub.add_parser("span-ledger")
    b = sub.add_parser("bridge-jsonl")
    r = sub.add_parser("remap")
    for q, names in ((s, ("raw", "du-run", "target")), (b, ("raw", "source", "du", "target")), (r, ("raw", "du-run", "vocabulary"))):
        for n in names:
            q.add_argument(f"--{n}", required=True)
    s.add_argument("--max-bytes", type=int, default=MAX_BYTES)
    r.add_argument("--chunk-bytes", type=int, default=100_000_000)
    for q in (s, r):
        q.add_argument("--gmap", choices=("gmap24", "gmap32"))
    t = sub.add_parser("repair")
    for n in ("server", "prefix", "delta"):
        t.add_argument(f"--{n}", required=True)
    t.add_argument("--version", type=int, default=2, choices=(1, 2))
    u = sub.add_parser("repair-du")
    for n in ("server", "prefix", "delta", "spans", "prefix-run", "delta-run"):
        u.add_argument(f"--{n}", required=True)
    for q in (t, u):
        q.add_argument("--max-drop", type=int, default=8)
        q.add_argument("--fixed-drop", type=int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("spanloom").getOrCreate()
    if a.command == "doctor":
        out = doctor(spark)
    elif a.command == "hex":
        print(hex_of(spark, a.path))
        return 0
    elif a.command == "smoke":
        out = smoke(sinks.read_bytes(spark, a.path) or b"")
    elif a.command == "lexeme-decode":
        text = a.line if a.file is None else (sinks.read_bytes(spark, a.file) or b"").decode("utf-8").removesuffix("\n")
        sys.stdout.buffer.write(lexeme(text))
        return 0
    elif a.command == "span-ledger":
        out = span_ledger(spark, a.raw, a.du_run, a.target, a.max_bytes, a.gmap)
    elif a.command == "bridge-jsonl":
        out = bridge_jsonl(spark, a.raw, a.source, a.du, a.target)
    elif a.command == "repair":
        out = repair_files(spark, a.server, a.prefix, a.delta, version=a.version, max_drop=a.max_drop, fixed_drop=a.fixed_drop)
    elif a.command == "repair-du":
        out = repair_du_files(spark, a.server, a.prefix, a.delta, a.spans, a.prefix_run, a.delta_run, max_drop=a.max_drop, fixed_drop=a.fixed_drop)
    else:
        out = remap_run(spark, a.raw, a.du_run, a.vocabulary, a.chunk_bytes, a.gmap)
    print(sinks.report_json(out), end="")
    if a.receipts:
        sinks.write_report(spark, a.receipts, a.command, out)
    return 0 if out.get("exact", True) else 2


if __name__ == "__main__":
    sys.exit(main())
