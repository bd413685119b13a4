"""The pipeline's stages against plain Python on a small corpus with planted cases."""

import random

import corpus_pipeline
from spanloom.llm import decontaminate, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(21)
    words = {"en": "the and with house from that was night garden river stone window".split(), "fr": "le et avec maison depuis était nuit été jardin fleuve pierre fenêtre".split()}
    rows = []
    for i in range(120):
        k = r.choice(["en", "fr"])
        rows.append((i, " ".join(r.choice(words[k]) + r.choice(["", "s"]) for _ in range(60)), k))
    item = " ".join(r.choice(words["en"]) for _ in range(20))
    rows += [(200, rows[3][1], "en"), (201, rows[3][1].upper().lower(), "en"), (202, rows[4][1] + " end", "en"), (203, item, "en"), (204, "12 !!", "en"), (205, None, None), (206, item + " and so on", "en"), (207, " ".join(f"the {w}{i}" for i in range(300) for w in words["en"]) + " " + item, "en")]
    return [(i, t, k, "s", len(t or "")) for i, t, k in rows], [(1, item)]


def test_stages(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = {i: t for i, t, *_ in rows}
    kept = {i for i, t in text.items() if t and any(c.isalpha() for c in t)}
    last = {}
    for i in kept:
        last[text[i]] = max(last.get(text[i], -1), i)
    kept = set(last.values())
    fp = {i: simhash.fingerprint(text[i]) for i in kept}
    comp = {i: i for i in kept}
    for _ in kept:
        for i in kept:
            comp[i] = min(comp[j] for j in kept if bin(fp[i] ^ fp[j]).count("1") <= 4)
    kept = {i for i in kept if comp[i] == i}
    bad = decontaminate.brute([(i, text[i]) for i in kept], items)
    assert bad[207][1] >= decontaminate.WINDOW and not bad[207][4]  # a whole passage in a long text
    kept = {i for i in kept if not bad[i][1]}
    assert not kept & {203, 206, 207} and 200 not in kept
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
    assert {r.doc_id for r in at.collect()} == kept
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept


def test_empty_and_repeated(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], COLUMNS), str(tmp_path)).count() == 0, name
    twice = spark.createDataFrame([rows[0], rows[0], rows[1]], COLUMNS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_exact_copies(spark, twice, str(tmp_path)).collect()) == [0, 1]


def test_clashing_columns_and_repeated_ids(spark, tmp_path):
    """Columns named like the stages' own, rows read from files or made in memory, several texts and null texts under one id."""
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = "_keep string, _digest string, _row string, digest string, root string, lang_pred string, score string, old string"
    rows = [(*x, *"abcdefgh") for x in rows]
    extra = [(rows[0][0], *rows[1][1:]), (rows[0][0], *rows[2][1:]), rows[5], (None, *rows[6][1:]), (None, *rows[7][1:]), (None, None, *rows[7][2:])]
    docs = spark.createDataFrame(rows + extra, f"{COLUMNS}, {clash}")
    docs.write.parquet(f"{tmp_path}/given")
    kept = []
    for at in (docs, spark.read.parquet(f"{tmp_path}/given")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == docs.columns, name
        kept.append(sorted((tuple(r) for r in at.collect()), key=str))
        assert len({t for _, t, *_ in kept[-1]}) == len(kept[-1])
    assert kept[0] == kept[1] and {r[8] for r in kept[0]} == {"d"}
