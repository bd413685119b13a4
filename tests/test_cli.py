"""Commands end to end on small generated files."""

import json

import pytest

from spanloom import cli
from spanloom.operators.views import LEXEMES, WORDS, cap, tokens
from spanloom.plans.files import write_du_run
from spanloom.sources import sinks

TEXT = "Zwölf  Boxer\tjagen\nViktor 世界 quer "


@pytest.fixture
def run(spark, tmp_path):
    at = str(tmp_path)
    sinks.write_bytes(spark, f"{at}/raw.txt", [TEXT.encode()])
    d = spark.createDataFrame([(0, TEXT)], "doc_id bigint, text string")
    for name, pattern in (("source", WORDS), ("du", LEXEMES), ("target", cap(3))):
        sinks.write_jsonl(tokens(d, "doc_id", pattern, name), f"{at}/{name}.jsonl")
    write_du_run(spark, [("a", TEXT)], f"{at}/run")
    sinks.write_bytes(spark, f"{at}/target/model.bin", [sinks.model_bin_bytes([bytes([i]) for i in range(256)])])
    sinks.write_bytes(spark, f"{at}/target/tokens.u32", [sinks.pack_u32(TEXT.encode())])
    return at


def test_commands(spark, run, capsys):
    assert cli.main(["doctor"]) == 0 and cli.main(["smoke", f"{run}/raw.txt"]) == 0
    capsys.readouterr()
    assert cli.main(["hex", f"{run}/raw.txt"]) == 0 and capsys.readouterr().out.strip() == TEXT.encode().hex()
    assert cli.main(["--receipts", f"{run}/receipts", "bridge-jsonl", "--raw", f"{run}/raw.txt", *[x for n in ("source", "du", "target") for x in (f"--{n}", f"{run}/{n}.jsonl")]]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["source_exact"] and out["du_exact"] and out["target_exact"] and out["mismatch_stream"] is None
    assert json.loads(sinks.read_bytes(spark, f"{run}/receipts/report.json"))["raw_len"] == len(TEXT.encode())
    assert cli.main(["span-ledger", "--raw", f"{run}/raw.txt", "--du-run", f"{run}/run", "--target", f"{run}/target"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["du_exact"] and out["target_exact"] and out["target_tokens"] == len(TEXT.encode()) and out["samples"]
    assert cli.main(["remap", "--raw", f"{run}/raw.txt", "--du-run", f"{run}/run", "--vocabulary", f"{run}/target/model.bin", "--chunk-bytes", "10"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["exact"] and out["emitted"] == out["target_bytes"] == len(TEXT.encode()) and out["target_sha256"] == out["raw_sha256"]
    sinks.write_bytes(spark, f"{run}/other.txt", [TEXT.encode() + b"!"])
    assert cli.main(["remap", "--raw", f"{run}/other.txt", "--du-run", f"{run}/run", "--vocabulary", f"{run}/target/model.bin", "--chunk-bytes", "10"]) == 2


def test_lexeme_needs_one_input(spark):
    with pytest.raises(SystemExit):
        cli.main(["lexeme-decode"])
    with pytest.raises(ValueError, match="nul"):
        cli.lexeme("\0")


def test_repair_files(spark, tmp_path):
    from spanloom.functions.tokenizers import RegexTokenizer

    sinks.write_bytes(spark, f"{tmp_path}/p", [b"one two"])
    sinks.write_bytes(spark, f"{tmp_path}/d", [b"s three"])
    out = cli.repair_files(spark, "", f"{tmp_path}/p", f"{tmp_path}/d", tokenizer=RegexTokenizer(WORDS))
    assert out["exact"] and out["drop"] == 1 and out["n_ids"] == 3 and len(out["trials"]) == 2


def test_repair_du_files(spark, tmp_path):
    """A snapshot from files: the tail is cut from the DU run inside its last lexeme."""
    from spanloom.functions.tokenizers import RegexTokenizer

    prefix, delta = "one two", "s three"
    sinks.write_bytes(spark, f"{tmp_path}/p", [prefix.encode()])
    sinks.write_bytes(spark, f"{tmp_path}/d", [delta.encode()])
    sinks.write_jsonl(tokens(spark.createDataFrame([(0, prefix)], "doc_id bigint, text string"), "doc_id", WORDS, "source"), f"{tmp_path}/spans.jsonl")
    write_du_run(spark, [("a", prefix)], f"{tmp_path}/pr")
    write_du_run(spark, [("a", delta)], f"{tmp_path}/dr", width=4)
    at = lambda *names: [f"{tmp_path}/{n}" for n in names]
    tok = RegexTokenizer(WORDS)
    tok.encode(prefix.encode())  # its ids are hashes, and it decodes only what it has seen
    out = cli.repair_du_files(spark, "", *at("p", "d", "spans.jsonl", "pr", "dr"), tokenizer=tok)
    assert out["gate"] is None and out["exact"] and (out["drop"], out["repair_start"], out["n_ids"], len(out["trials"])) == (1, 3, 3, 2)
    out = cli.repair_du_files(spark, "", *at("p", "d", "spans.jsonl", "pr", "dr"), fixed_drop=0, tokenizer=tok)
    assert out["gate"] == "ids" and not out["exact"]
    out = cli.repair_du_files(spark, "", *at("p", "d", "spans.jsonl", "pr", "pr"), fixed_drop=1, tokenizer=tok)
    assert out["gate"] == "delta"
