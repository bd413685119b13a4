"""Readers and writers: round trips, strictness; the tokenizer server; the streaming form."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from spanloom.functions.tokenizers import GreedyTokenizer, HttpTokenizer, RegexTokenizer
from spanloom.operators.views import WORDS
from spanloom.sources import files, sinks
from spanloom.streaming.repair_stream import append, run_available


@pytest.mark.parametrize(("data", "error"), [(b"", "count"), (b"\1\0\0\0", "length"), (b"\1\0\0\0\2\0\0\0a", "truncated"), (b"\0\0\0\0x", "trailing")])
def test_model_bin_errors(data, error):
    with pytest.raises(ValueError, match=error):
        files.parse_model_bin(data)


def test_model_bin(spark, tmp_path):
    entries = [b"", b"a", b"\xff\xfe"]
    assert files.parse_model_bin(sinks.model_bin_bytes(entries)) == entries
    assert files.parse_model_bin(sinks.model_bin_bytes(entries, b"MB01"), b"MB01", 10) == entries
    with pytest.raises(ValueError, match="magic"):
        files.parse_model_bin(b"xxxx", b"MB01")
    with pytest.raises(ValueError, match="bytes"):
        files.parse_model_bin(sinks.model_bin_bytes(entries, b"MB01"), b"MB01", 1)
    sinks.write_bytes(spark, f"{tmp_path}/m.bin", [sinks.model_bin_bytes(entries)])
    assert [(r.id, bytes(r.bytes)) for r in files.model_bin(spark, f"{tmp_path}/m.bin").orderBy("id").collect()] == list(enumerate(entries))


def test_dictionary_lines():
    assert files.parse_dictionary(b"a\r\n\n\x03\nlast") == [b"a", b"", b"\n", b"last"] and files.parse_dictionary(b"") == [] and files.parse_dictionary(b"a\n") == [b"a"]
    with pytest.raises(ValueError, match="line 2"):
        files.parse_dictionary(b"ok\n\x04zz\n")


def test_packed():
    assert files.unpack(b"\1\0\2\1", 2).tolist() == [1, 258] and files.unpack(b"\1\2\3", 3).tolist() == [0x030201] and files.unpack(b"\xff\xff\xff\xff", 4).tolist() == [2**32 - 1] and files.unpack(b"", 4).tolist() == []
    with pytest.raises(ValueError, match="multiple"):
        files.unpack(b"abc", 2)
    with pytest.raises(ValueError, match="width"):
        files.unpack(b"", 5)


def run_folder(spark, at, gmap, width):
    sinks.write_bytes(spark, f"{at}/merged.dict", [b"a\nab\n"])
    sinks.write_bytes(spark, f"{at}/local_u16/10.u16", [b"\0\0\0\0"])
    sinks.write_bytes(spark, f"{at}/local_u16/2.u16", [b"\1\0"])
    sinks.write_bytes(spark, f"{at}/{gmap}/10.{gmap}", [(1).to_bytes(width, "little")])
    sinks.write_bytes(spark, f"{at}/{gmap}/2.{gmap}", [(1).to_bytes(width, "little") + (0).to_bytes(width, "little")])


@pytest.mark.parametrize(("gmap", "width"), [("gmap24", 3), ("gmap32", 4)])
def test_du_run(spark, tmp_path, gmap, width):
    run_folder(spark, tmp_path, gmap, width)
    rows = files.du_run(spark, str(tmp_path), gmap=gmap).orderBy("pos").collect()
    assert [(r.pos, r.id, r.byte_start, r.byte_end, bytes(r.bytes)) for r in rows] == [(0, 1, 0, 2, b"ab"), (1, 1, 2, 4, b"ab"), (2, 0, 4, 5, b"a")]  # 10.u16 before 2.u16
    assert files.du_run(spark, str(tmp_path), gmap=gmap, max_bytes=0).count() == 1 and files.du_run(spark, str(tmp_path), gmap=gmap, max_bytes=3).count() == 2
    sinks.write_bytes(spark, f"{tmp_path}/local_u16/3.u16", [b"\5\0"])
    with pytest.raises(Exception, match="out of range"):
        files.du_run(spark, str(tmp_path), gmap=gmap).collect()


def test_target_run_and_u32(spark, tmp_path):
    sinks.write_bytes(spark, f"{tmp_path}/model.bin", [sinks.model_bin_bytes([b"x", b"yz"])])
    ids = spark.createDataFrame([(2, 1), (0, 1), (1, 0)], "pos bigint, id bigint")
    assert sinks.write_u32(ids, f"{tmp_path}/tokens.u32") == 12
    rows = files.target_run(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.id, r.byte_start, r.byte_end) for r in rows] == [(1, 0, 2), (0, 2, 3), (1, 3, 5)]


def test_token_jsonl(spark, tmp_path):
    good = '{"id":123,"byte_start":0,"byte_end":5,"bytes_hex":"68656C6c6f","extra":1}\n  \n{"id":4,"byte_start":5,"byte_end":6,"bytes_hex":"21"}\n'
    (tmp_path / "t.jsonl").write_text(good)
    rows = files.token_jsonl(spark, f"{tmp_path}/t.jsonl").orderBy("pos").collect()
    assert [(r.pos, r.id, bytes(r.bytes)) for r in rows] == [(0, 123, b"hello"), (1, 4, b"!")]
    line = spark.createDataFrame([(123, 0, 5, b"hello")], "id bigint, byte_start bigint, byte_end bigint, bytes binary").select(sinks.jsonl_line()).first()[0]
    assert line == '{"id":123,"byte_start":0,"byte_end":5,"bytes_hex":"68656c6c6f"}'
    for bad in ('{"id":1}', "nonsense", '{"id":1,"byte_start":0,"byte_end":1,"bytes_hex":"abc"}', '{"id":-1,"byte_start":0,"byte_end":1,"bytes_hex":"ab"}'):
        (tmp_path / "bad.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception):
            files.token_jsonl(spark, f"{tmp_path}/bad.jsonl").collect()


def test_receipts_and_fixtures(spark, tmp_path):
    path = sinks.write_receipt(spark, f"{tmp_path}/deep/er", "run", {"a": 1}, epoch=7)
    assert path.endswith("run-7.json") and sinks.read_bytes(spark, path) == b'{\n  "a": 1\n}\n'
    report, receipt = sinks.write_report(spark, str(tmp_path), "x", {"b": None}, epoch=8)
    assert sinks.read_bytes(spark, report) == sinks.read_bytes(spark, receipt)
    assert sinks.verify_fixture(spark, report, b"no") == ("MISMATCH", 1) and sinks.verify_fixture(spark, f"{tmp_path}/none", b"") == ("MISSING", 1) and sinks.verify_fixture(spark, path, b'{\n  "a": 1\n}\n') == ("OK", 0)
    assert sinks.provenance("n", "o", b"ab", b"1\n2\n")["token_count"] == 2


def test_ranked_vocabulary(spark, tmp_path):
    (tmp_path / "v.txt").write_text("YQ== 0\nYWI= 1\n")
    rows = files.ranked_vocabulary(spark, f"{tmp_path}/v.txt", id_offset=3).orderBy("id").collect()
    assert [(r.id, bytes(r.bytes)) for r in rows] == [(0, b""), (1, b""), (2, b""), (3, b"a"), (4, b"ab")]


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        out = {"tokens": list(body["content"].encode())} if self.path == "/tokenize" else {"text": bytes(body["tokens"]).decode()}
        if body.get("content") == "bad":
            out = {"ids": [1 << 40]}
        raw = json.dumps(out).encode()
        self.send_response(201 if self.path == "/tokenize" else 200)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *a):
        pass


def test_http_tokenizer():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    t = HttpTokenizer(f"http://127.0.0.1:{server.server_port}")
    assert t.encode("hé".encode()) == list("hé".encode()) and t.decode([104, 105]) == b"hi"
    with pytest.raises(ValueError, match="32-bit"):
        t.encode(b"bad")
    with pytest.raises(UnicodeDecodeError):
        t.encode(b"\xff")
    with pytest.raises(ValueError, match="http"):
        HttpTokenizer("https://x:1").encode(b"a")
    server.shutdown()


def test_horizon_bounds_the_change():
    tok = GreedyTokenizer([(i, bytes([i])) for i in range(256)] + [(300, b"abc"), (301, b"bcd"), (302, b"abcdefgh")])
    import random

    r = random.Random(3)
    for _ in range(300):
        raw, ids, ends = b"", [], []
        for _ in range(6):
            delta = bytes(r.choice(b"abcdefgh") for _ in range(r.randrange(6)))
            ids, ends, _, _ = append(tok, raw, ids, ends, delta, None)
            raw += delta
            assert ids == tok.encode(raw)


def test_stream_equals_batch(spark, tmp_path):
    texts = ["a b", " c", "d ", " e f"]
    for turn, t in enumerate(texts):
        spark.createDataFrame([(1, turn, t), (2, turn, t + "!")], "conv_id bigint, turn bigint, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("conv_id bigint, turn bigint, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tok = RegexTokenizer(WORDS)
    out = run_available(source, tok, f"{tmp_path}/out", f"{tmp_path}/cp", drop=1)
    got = {(r.conv_id, r.turn): r.n_tokens for r in out.collect()}
    want = {}
    for c, end in ((1, ""), (2, "!")):
        raw = ""
        for turn, t in enumerate(texts):
            raw += t + end
            want[c, turn] = len(tok.encode(raw.encode()))
    assert got == want and out.where(F.col("dropped") > 1).count() == 0


def test_ranked_tokenizer_records(spark):
    import public_tokenizers as P

    from spanloom.functions.tokenizers import RankedTokenizer
    from spanloom.operators import fixtures, spans

    tok = RankedTokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "Zwölf naïve 世界 🙂 words\n  and more"
    d = spark.createDataFrame([(1, text), (2, None), (3, "é" * 10)], "doc_id bigint, text string")
    rows = fixtures.records(d, tok, "native")
    got = {r.doc_id: bytes(r.bytes) for r in spans.reconstruct(rows).collect()}
    assert got == {1: text.encode(), 3: ("é" * 10).encode()}
    assert [r.id for r in rows.where("doc_id = 1").orderBy("pos").collect()] == tok.encode(text.encode())
    cut = fixtures.records(d, tok, "native", 5)
    assert {r.doc_id: r.n for r in cut.groupBy("doc_id").agg(F.max("byte_end").alias("n")).collect()} == {1: 5, 3: 4}
    assert all(r.equal == (r.diverges_at is None) for r in fixtures.lexeme_equivalence(d, tok, WORDS).collect())


def test_lines_are_numbered_in_their_files(spark, tmp_path):
    """Errors name the line, blank lines count for it but not for positions; several files follow each other."""
    import os

    good = '{"id":1,"byte_start":0,"byte_end":1,"bytes_hex":"61"}'
    folder = f"{tmp_path}/many"
    os.makedirs(folder)
    for name, lines in (("a.txt", [good, "", good, "  "]), ("b.txt", ["", good])):
        with open(f"{folder}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")
    got = sorted((r.file[-5:], r.line, r.pos) for r in files.numbered_lines(spark, folder).collect())
    assert got == [("a.txt", 1, 0), ("a.txt", 3, 1), ("b.txt", 2, 2)]
    with open(f"{tmp_path}/bad.txt", "w") as f:
        f.write(f"{good}\n\n{good}\nnonsense\n")
    with pytest.raises(Exception, match="bad token line 4 of .*bad.txt"):
        files.token_jsonl(spark, f"{tmp_path}/bad.txt").collect()
    small = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    with open(f"{tmp_path}/long.txt", "w") as f:
        f.write("".join(good.replace('"id":1', f'"id":{i}') + "\n" * (1 + i % 3) for i in range(100)))
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        rows = files.token_jsonl(spark, f"{tmp_path}/long.txt")
        assert sorted((r.pos, r.id) for r in rows.collect()) == [(i, i) for i in range(100)]
    finally:
        for k in small:
            spark.conf.unset(k)


def test_gmap_is_found(spark, tmp_path):
    from spanloom.plans.files import write_du_run

    with pytest.raises(ValueError, match="neither"):
        files.du_run(spark, str(tmp_path))
    write_du_run(spark, [("a", "one two")], f"{tmp_path}/r", width=4)
    assert files.gmap_of(spark, f"{tmp_path}/r") == "gmap32" and files.du_vocabulary_size(spark, f"{tmp_path}/r") == 3
    write_du_run(spark, [("a", "one two")], f"{tmp_path}/r", width=3)
    assert files.gmap_of(spark, f"{tmp_path}/r") == "gmap24"


def test_ranked_ids_must_all_be_there(spark, tmp_path):
    sinks.write_bytes(spark, f"{tmp_path}/v", [b"YQ== 0\nYg== 2\n"])
    assert files.ranked_vocabulary(spark, f"{tmp_path}/v").count() == 2
    with pytest.raises(ValueError, match="expected 0 to 1"):
        files.ranked_vocabulary(spark, f"{tmp_path}/v", entries=2)


def test_ids_that_do_not_fit(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1), (1, 1 << 32)], "pos bigint, id bigint")
    with pytest.raises(Exception, match="does not fit 32 bits: 4294967296"):
        sinks.write_u32(rows, f"{tmp_path}/x.u32")


def test_running_sums(spark):
    from spanloom.operators.ranks import accumulated

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("n")).repartition(7)
    rows = sorted(df.collect())
    got = {r.k: (r.at, r.total) for r in accumulated(df, ["k"], "n", "at", "total").collect()}
    total, want = 0, {}
    for i, (k, n) in enumerate(rows):
        total += n
        want[k] = (i, total)
    assert got == want and accumulated(df.limit(0), ["k"], "n", "at", "total").count() == 0
