"""Queries that write the reference formats to the shared folder and scan them again."""

from __future__ import annotations

import base64
import re

from pyspark.sql import functions as F

from spanloom import scratch
from spanloom.functions import bytestrings as B
from spanloom.operators import remap, vocabulary
from spanloom.operators.ranks import accumulated
from spanloom.operators.views import LEXEMES, WORDS, gathered, id_of, lengths
from spanloom.plans.remapping import DICT, lexeme_rows, shipped
from spanloom.plans.spans import docs, items
from spanloom.plans.sql import VOCAB, greedy, view, with_
from spanloom.sources import files, sinks

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: All benchmark texts in the order of their ids as one stream: the fixture of the single-stream formats.
_ALL = "al AS (SELECT 0 AS doc_id, string_agg(text, '' ORDER BY item_id) AS text FROM benchmark)"


def fixture(spark, sf_dir) -> list[tuple[str, str]]:
    """The benchmark's rows on the driver; it is the fixture written to files here, whose size is checked."""
    d = items(spark, sf_dir)
    if d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] > 64 << 20:
        raise ValueError("the benchmark is too large for a file fixture")
    return [(str(r[0]), r[1] or "") for r in d.orderBy("doc_id").collect()]


@query(with_(VOCAB) + "SELECT id, h AS bytes_hex FROM vocab")
def model_bin_scan(spark, sf_dir):
    entries = [b for _, b in sorted(shipped(spark, sf_dir))]
    path = scratch.folder(spark, "vocabulary") + "/model.bin"
    sinks.write_bytes(spark, path, [sinks.model_bin_bytes(entries)])
    return files.model_bin(spark, path).select("id", B.to_hex(F.col("bytes")).alias("bytes_hex"))


@query(with_(view("w", "words"), "o AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS pos, id, CAST(sum(n) OVER (ORDER BY doc_id, pos) AS BIGINT) AS byte_end, n, tok FROM w)")
       + "SELECT pos, id, byte_end - n AS byte_start, byte_end, lower(hex(encode(tok))) AS bytes_hex FROM o")
def jsonl_roundtrip(spark, sf_dir):
    """All documents, one after the other in the order of their ids, as one stream in a file of token lines."""
    sizes = lengths(F.col("text"), WORDS)
    d = docs(spark, sf_dir).select("doc_id", "text", F.size(sizes).cast("bigint").alias("n"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    d = accumulated(d, ["doc_id"], "n", "place", "n_upto", ("size", "size_upto"))
    # whole documents are put in order, never token rows: each spreads out into its lines where it stands
    d = d.select("doc_id", "text", (F.col("n_upto") - F.col("n")).alias("first"), (F.col("size_upto") - F.col("size")).alias("base"))
    t = gathered(d.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), "doc_id", WORDS, "source").select("first", "base", F.explode("t").alias("t"))
    t = t.select((F.col("first") + F.col("t.pos")).alias("pos"), id_of(F.col("t.bytes")).alias("id"), (F.col("base") + F.col("t.byte_start")).alias("byte_start"), (F.col("base") + F.col("t.byte_end")).alias("byte_end"), "t.bytes")
    path = scratch.folder(spark, "tokens") + "/source.jsonl"
    sinks.write_jsonl(t, path, "gzip", placed=True)
    return files.token_jsonl(spark, path).select("pos", "id", "byte_start", "byte_end", B.to_hex(F.col("bytes")).alias("bytes_hex"))


def line_of(lexeme: str) -> str:
    """A dictionary line for a lexeme."""
    if lexeme.isascii() and not re.search(r"[\x00-\x20]", lexeme):
        return lexeme
    if re.fullmatch(r"[ \t\n]+", lexeme):
        return re.sub(" +", lambda m: f"{B.SPACES}{len(m[0])}{B.SPACES}", lexeme).replace("\n", B.NEWLINE).replace("\t", B.TAB)
    return B.TEXT_BEGIN + base64.b64encode(lexeme.encode()).decode().rstrip("=") + B.TEXT_END


def write_du_run(spark, texts: list[tuple[str, str]], folder: str, width: int = 3) -> None:
    """A dictionary-encoded run: one chunk per text, local ids by first appearance."""
    gids: dict[str, int] = {}
    for n, (_, text) in enumerate(texts):
        local: dict[str, int] = {}
        ids = [local.setdefault(p, len(local)) for p in re.findall(LEXEMES, text)]
        globals_ = [gids.setdefault(p, len(gids)) for p in local]
        name = f"{n:08d}"
        sinks.write_bytes(spark, f"{folder}/local_u16/{name}.u16", [b"".join(i.to_bytes(2, "little") for i in ids)])
        sinks.write_bytes(spark, f"{folder}/gmap{8 * width}/{name}.gmap{8 * width}", [b"".join(g.to_bytes(width, "little") for g in globals_)])
    sinks.write_bytes(spark, f"{folder}/merged.dict", ["".join(line_of(x) + "\n" for x in gids).encode()])


_DU = with_("parts AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) AS k FROM benchmark)", view("d", "lexemes", "parts", "k"),
            "o AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS pos, CAST(sum(n) OVER (ORDER BY doc_id, pos) AS BIGINT) AS byte_end, n, tok FROM d)") + "SELECT pos, byte_end - n AS byte_start, byte_end, lower(hex(encode(tok))) AS bytes_hex FROM o"


@query(_DU)
def du_run_scan(spark, sf_dir):
    folder = scratch.folder(spark, "du-run")
    write_du_run(spark, fixture(spark, sf_dir), folder)
    return files.du_run(spark, folder).select("pos", "byte_start", "byte_end", B.to_hex(F.col("bytes")).alias("bytes_hex"))


@query(_DU + " WHERE byte_end - n < 1000")
def du_run_scan_limited(spark, sf_dir):
    folder = scratch.folder(spark, "du-run")
    write_du_run(spark, fixture(spark, sf_dir), folder, width=4)
    return files.du_run(spark, folder, max_bytes=1000).select("pos", "byte_start", "byte_end", B.to_hex(F.col("bytes")).alias("bytes_hex"))


@query(with_("al AS (SELECT string_agg(text, '' ORDER BY item_id) AS t FROM benchmark)") + "SELECT sha256(t) AS sha256, CAST(strlen(t) AS BIGINT) AS n_bytes FROM al")
def target_run_scan(spark, sf_dir):
    """Ids written as packed words, read with their vocabulary, and joined to the fixture's bytes again."""
    from spanloom.functions.tokenizers import GreedyTokenizer
    from spanloom.operators.spans import reconstruct

    v = sorted(shipped(spark, sf_dir))
    folder = scratch.folder(spark, "target-run")
    sinks.write_bytes(spark, f"{folder}/model.bin", [sinks.model_bin_bytes([b for _, b in v])])
    sinks.write_bytes(spark, f"{folder}/tokens.u32", [sinks.pack_u32(GreedyTokenizer(v).encode("".join(t for _, t in fixture(spark, sf_dir)).encode()))])
    out = reconstruct(files.target_run(spark, folder))
    return out.select(B.sha256(F.col("bytes")).alias("sha256"), F.octet_length("bytes").cast("bigint").alias("n_bytes"))


@query("SELECT '{\"documents\":' || count(*) || ',\"bytes\":' || CAST(sum(strlen(text)) AS BIGINT) || '}' AS receipt FROM documents")
def receipt(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).alias("bytes"))
    return d.select(F.to_json(F.struct("documents", "bytes")).alias("receipt"))


@query(with_(VOCAB) + "SELECT id, h AS bytes_hex FROM vocab")
def model_bin_legacy_scan(spark, sf_dir):
    """The form with a magic and bounded entries."""
    path = scratch.folder(spark, "vocabulary") + "/model.bin"
    sinks.write_bytes(spark, path, [sinks.model_bin_bytes([b for _, b in sorted(shipped(spark, sf_dir))], b"MB01")])
    return files.model_bin(spark, path, legacy=True).select("id", B.to_hex(F.col("bytes")).alias("bytes_hex"))


@query(with_(VOCAB) + "SELECT CAST(i AS BIGINT) AS id, '' AS bytes_hex FROM range(100) r(i) UNION ALL SELECT id + 100, h FROM vocab")
def ranked_vocabulary_scan(spark, sf_dir):
    """A rank file behind a hundred placeholders; every id must be there once."""
    entries = sorted(shipped(spark, sf_dir))
    path = scratch.folder(spark, "ranks") + "/vocabulary.ranks"
    sinks.write_bytes(spark, path, [b"".join(base64.b64encode(b) + f" {i}\n".encode() for i, b in entries)])
    return files.ranked_vocabulary(spark, path, id_offset=100, entries=100 + len(entries)).select("id", B.to_hex(F.col("bytes")).alias("bytes_hex"))


@query("SELECT row_number() OVER (ORDER BY CAST(item_id AS VARCHAR)) - 1 AS place, CAST(item_id AS VARCHAR) AS stem, sha256(text) AS sha256 FROM benchmark")
def folder_scan(spark, sf_dir):
    """A folder of raw files in byte-wise order of their paths; files of another extension are left out."""
    from pyspark.sql import Window

    folder = scratch.folder(spark, "raw")
    for name, text in fixture(spark, sf_dir):
        sinks.write_bytes(spark, f"{folder}/{name}.raw", [text.encode()])
    sinks.write_bytes(spark, f"{folder}/0.other", [b"left out"])
    place = (F.row_number().over(Window.orderBy("path")) - 1).cast("bigint")  # a listing of files
    return files.raw_files(spark, folder, ".raw").select(place.alias("place"), "stem", F.sha2("content", 256).alias("sha256"))


@query("SELECT 'report.json' AS file, '{\n  \"documents\": ' || count(*) || ',\n  \"bytes\": ' || CAST(sum(strlen(text)) AS BIGINT) || E'\n}\n' AS content FROM documents UNION ALL SELECT 'run-7.json', '{\n  \"documents\": ' || count(*) || ',\n  \"bytes\": ' || CAST(sum(strlen(text)) AS BIGINT) || E'\n}\n' FROM documents".replace("'{\n", "E'{\\n").replace(",\n", ",\\n").replace("',\\n", "E',\\n").replace("E'\n}\n'", "E'\\n}\\n'"))
def report_files(spark, sf_dir):
    """A report and its receipt, written and read again."""
    row = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).alias("bytes")).first().asDict()
    folder = scratch.folder(spark, "reports")
    sinks.write_report(spark, folder, "run", row, 7)
    return files.raw_files(spark, folder, ".json").select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.decode("content", "UTF-8").alias("content"))


@query("SELECT * FROM (VALUES ('same', 'OK', 0), ('changed', 'MISMATCH', 1), ('gone', 'MISSING', 1), ('library', 'DEPENDENCY', 2)) v(fixture, status, code)")
def fixture_verification(spark, sf_dir):
    """A fixture of the benchmark's texts against its bytes, other bytes, no file, and a generator that lacks its library."""
    raw = "".join(t for _, t in fixture(spark, sf_dir)).encode()
    folder = scratch.folder(spark, "fixtures")
    sinks.write_bytes(spark, f"{folder}/a", [raw])

    def lacking() -> bytes:
        raise ImportError("an optional library")

    cases = [("same", "a", raw), ("changed", "a", raw + b"."), ("gone", "b", raw), ("library", "a", lacking)]
    return spark.createDataFrame([(name, *sinks.verify_fixture(spark, f"{folder}/{file}", want)) for name, file, want in cases], "fixture string, status string, code int")


@query(with_(VOCAB, view("d", "lexemes"), DICT, "src AS (SELECT gid AS key, h FROM dict)", greedy("g", "src"), recursive=True) + "SELECT key AS gid, rtrim(ids, ',') AS target_ids FROM g_done")
def dense_ids_roundtrip(spark, sf_dir):
    """The lexeme map as JSON lines, read again."""
    path = scratch.folder(spark, "dense") + "/ids.jsonl"
    sinks.write_dense_ids(remap.build_map(vocabulary.dictionary(lexeme_rows(docs(spark, sf_dir))), shipped(spark, sf_dir)), path)
    return spark.read.schema("gid bigint, target_ids array<bigint>").json(path).select("gid", F.array_join("target_ids", ",").alias("target_ids"))
