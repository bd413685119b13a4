"""Queries on append repair: snapshots, candidates, searches, the streaming form. ``conversations`` are the appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom import scratch
from spanloom.functions.tokenizers import GreedyTokenizer, RegexTokenizer
from spanloom.operators import repair
from spanloom.operators.views import LEXEMES, WORDS
from spanloom.plans.remapping import shipped
from spanloom.plans.spans import docs, items, table
from spanloom.plans.sql import view, with_
from spanloom.streaming import repair_stream

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_C = f"""c AS (SELECT conv_id, turn, coalesce(string_agg(coalesce(text, ''), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS p, coalesce(text, '') AS d FROM conversations),
t AS (SELECT *, regexp_extract_all(p, '{WORDS}') AS tp, regexp_extract_all(p || d, '{WORDS}') AS tf FROM c),
k AS (SELECT *, unnest(range(0, 9)) AS k FROM t),
x AS (SELECT *, tp[1:len(tp) - k] AS kept FROM k WHERE k < len(tp)),
y AS (SELECT *, strlen(array_to_string(kept, '')) AS kb, regexp_extract_all(substr(p || d, length(array_to_string(kept, '')) + 1), '{WORDS}') AS rest FROM x),
z AS (SELECT *, list_concat(kept, rest) = tf AS ok FROM y)"""
_IDS = "sha256(array_to_string(list_transform(tf, lambda v: CAST('0x' || substr(sha256(v), 1, 8) AS BIGINT) & 2147483647), ','))"
_COLS = "CAST(k AS BIGINT) AS \"drop\", CAST(strlen(p) - kb AS BIGINT) AS tail, CAST(strlen(p) - kb + strlen(d) AS BIGINT) AS \"window\", CAST(len(rest) AS BIGINT) AS fresh"


def conversations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def _found(r: DataFrame) -> DataFrame:
    return r.where("exact").select("conv_id", "turn", "drop", "tail", "window", "fresh", "n_ids", "ids_sha256")


@query(f"WITH {_C}, b AS (SELECT conv_id, turn, min(k) AS k FROM z WHERE ok GROUP BY conv_id, turn) SELECT z.conv_id, z.turn, {_COLS.replace('CAST(k', 'CAST(z.k')}, CAST(len(tf) AS BIGINT) AS n_ids, {_IDS} AS ids_sha256 FROM z JOIN b USING (conv_id, turn, k)")
def repair_search(spark, sf_dir):
    return _found(repair.repair_turns(conversations(spark, sf_dir), RegexTokenizer(WORDS)))


@query(f"WITH {_C} SELECT conv_id, turn, {_COLS}, CAST(len(tf) AS BIGINT) AS n_ids, {_IDS} AS ids_sha256 FROM z WHERE ok AND k = 1")
def repair_fixed_k(spark, sf_dir):
    return _found(repair.repair_turns(conversations(spark, sf_dir), RegexTokenizer(WORDS), fixed_drop=1))


@query(f"WITH {_C}, b AS (SELECT conv_id, turn, min(k) AS k FROM z WHERE ok GROUP BY conv_id, turn) SELECT z.conv_id, z.turn, {_COLS.replace('CAST(k', 'CAST(z.k')}, CAST(len(tf) AS BIGINT) AS n_ids, {_IDS} AS ids_sha256 FROM z JOIN b USING (conv_id, turn, k)")
def repair_search_v1(spark, sf_dir):
    return _found(repair.repair_turns(conversations(spark, sf_dir), RegexTokenizer(WORDS), version=1))


_DROPS = ", ".join(f"count(*) FILTER (k = {i}) AS drop_{i}" for i in range(9))


@query(f"WITH {_C}, b AS (SELECT conv_id, turn, min(k) AS k FROM z WHERE ok GROUP BY conv_id, turn), f AS (SELECT c.conv_id % 3 AS model, z.k, strlen(c.p) - kb AS tail, strlen(c.p) - kb + strlen(c.d) AS win FROM c LEFT JOIN b USING (conv_id, turn) LEFT JOIN z ON z.conv_id = c.conv_id AND z.turn = c.turn AND z.k = b.k)"
       + f" SELECT model, count(*) AS cases, count(k) AS exact_cases, count(*) = count(k) AS all_exact, CAST(max(k) AS BIGINT) AS max_drop, CAST(max(tail) AS BIGINT) AS max_tail, CAST(quantile_cont(tail, 0.5) AS DOUBLE) AS median_tail, CAST(quantile_cont(win, 0.5) AS DOUBLE) AS median_window, {_DROPS} FROM f GROUP BY model".replace("count(*) FILTER (k", "count(*) FILTER (k"))
def repair_histogram(spark, sf_dir):
    """The matrix of cases by model; conversations stand for the models of three tokenizers."""
    r = repair.repair_turns(conversations(spark, sf_dir), RegexTokenizer(WORDS)).withColumn("model", F.col("conv_id") % 3)
    return repair.histogram(r, ["model"])


@query(f"WITH {_C}, b AS (SELECT conv_id, turn, min(k) AS k FROM z WHERE ok GROUP BY conv_id, turn) SELECT z.conv_id, z.turn, CAST(z.k AS BIGINT) AS \"drop\", CAST(strlen(p) - kb + strlen(d) AS BIGINT) AS \"window\", ok AS exact, CAST(NULL AS VARCHAR) AS reason FROM z JOIN b USING (conv_id, turn) WHERE z.k <= b.k AND kb > 0")
def repair_trials(spark, sf_dir):
    """Every trial of each search that ends in an exact candidate."""
    r = repair.repair_turns(conversations(spark, sf_dir), RegexTokenizer(WORDS), trials=True).where("exact")
    return r.select("conv_id", "turn", F.explode("trials").alias("t")).select("conv_id", "turn", "t.*")


#: Appends by turn modulo 7: 3 has a false digest in its snapshot, 4 a delta with one bound too many, 5 a raw delta that its DU state does not rebuild.
@query(f"""WITH {_C}, b AS (SELECT conv_id, turn, min(k) AS k FROM z WHERE ok AND kb > 0 GROUP BY conv_id, turn), g AS (SELECT c.conv_id, c.turn, c.p, c.d, z.k, z.kb, len(z.rest) AS fresh, turn % 7 AS m FROM c LEFT JOIN b USING (conv_id, turn) LEFT JOIN z ON z.conv_id = c.conv_id AND z.turn = c.turn AND z.k = b.k WHERE c.p <> '')
SELECT conv_id, turn, CASE WHEN m NOT IN (3, 4, 5) THEN CAST(k AS BIGINT) END AS "drop", CASE WHEN m NOT IN (3, 4, 5) THEN CAST(kb AS BIGINT) END AS repair_start, CASE WHEN m NOT IN (3, 4, 5) THEN CAST(strlen(p) - kb + strlen(d) AS BIGINT) END AS "window",
  CASE WHEN m NOT IN (3, 4, 5) THEN CAST(fresh AS BIGINT) END AS fresh, CASE WHEN m = 3 THEN 'invalid snapshot: hash' WHEN m = 4 THEN 'invalid delta: bounds' WHEN m <> 5 AND k IS NULL THEN 'none' WHEN m = 5 THEN 'not compared' END AS reason,
  CASE WHEN m IN (3, 4) THEN 'reason' WHEN m = 5 THEN 'not compared' WHEN k IS NULL THEN 'reason' END AS gate FROM g""")
def repair_du_aware(spark, sf_dir):
    """Stored, validated snapshots with a DU state, deltas from theirs, and the gates of a receipt."""
    a = repair.appends(conversations(spark, sf_dir)).where("octet_length(prefix) > 0").withColumn("doc_id", F.xxhash64("conv_id", "turn"))
    native, du, m = RegexTokenizer(WORDS), RegexTokenizer(LEXEMES), F.col("turn") % 7
    s, state = repair.du_state("delta", du, repair.snapshot(a, native, du), "delta_state"), F.col("delta_state")
    more = F.struct(state["ids"].alias("ids"), state["parts"].alias("parts"), F.concat(state["bounds"], F.array(F.lit(1).cast("bigint"))).alias("bounds"))
    s = s.withColumns({"prefix_sha256": F.when(m == 3, "0").otherwise(F.col("prefix_sha256")), "delta_state": F.when(m == 4, more).otherwise(state), "delta": F.when(m == 5, F.concat("delta", F.unhex(F.lit("21")))).otherwise(F.col("delta"))})
    r = repair.repair_snapshots(scratch.written(s, "append-snapshots"), native).withColumn("gate", repair.gates())
    spoilt = m == 5  # what its search finds depends on the other delta; only that it never passes is compared
    seen = lambda c: F.when(~spoilt, F.col(c)).alias(c)
    said = lambda c: F.when(spoilt & F.col("gate").isNotNull(), "not compared").otherwise(F.col(c)).alias(c)
    return r.select("conv_id", "turn", *[seen(c) for c in ("drop", "repair_start", "window", "fresh")], F.when(~spoilt & (F.col("reason") == repair.INEXACT), "none").otherwise(said("reason")).alias("reason"), said("gate"))


@query("""SELECT conv_id, turn, p <> '' AS exact, CASE WHEN p = '' THEN 'empty prefix' END AS reason FROM (SELECT conv_id, turn, coalesce(string_agg(coalesce(text, ''), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS p FROM conversations)""")
def repair_greedy(spark, sf_dir):
    """The look-ahead tokenizer: several tokens may change, all within its horizon, so the search always ends in an exact one."""
    tok = GreedyTokenizer(shipped(spark, sf_dir))
    return repair.repair_turns(conversations(spark, sf_dir), tok, max_drop=tok.horizon + 1).select("conv_id", "turn", "exact", "reason")


SNAPSHOT_FAULTS = (None, "length", "hash", "du rebuild", "count", "span id", "contiguity", "hex", "bytes")


def _snapshots(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir).where("text <> ''").select("doc_id", F.encode("text", "UTF-8").alias("prefix"))
    s = repair.snapshot(d, RegexTokenizer(WORDS), RegexTokenizer(LEXEMES))
    k = F.col("doc_id") % 9
    n = F.size("native_spans")

    def span(x, i):
        first = i == 0
        return F.struct(
            F.when(first & (k == 5), x["id"] + 1).otherwise(x["id"]).alias("id"), F.when(first & (k == 6), x["byte_start"] + 1).otherwise(x["byte_start"]).alias("byte_start"), x["byte_end"].alias("byte_end"),
            F.when(first & (k == 7), F.lit("0g")).when(first & (k == 8), F.concat(F.lit("00"), F.substring(x["bytes_hex"], 3, 1 << 20))).otherwise(x["bytes_hex"]).alias("bytes_hex"),
        )

    du = F.col("du_state")
    return s.withColumns({
        "prefix_len": F.col("prefix_len") + (k == 1).cast("int"), "prefix_sha256": F.when(k == 2, "0").otherwise(F.col("prefix_sha256")),
        "du_state": F.when(k == 3, F.struct(du["ids"].alias("ids"), F.slice(du["parts"], F.lit(1), F.size(du["parts"]) - 1).alias("parts"), du["bounds"].alias("bounds"))).otherwise(du),
        "native_ids": F.when(k == 4, F.slice("native_ids", F.lit(1), n - 1)).otherwise(F.col("native_ids")), "native_spans": F.transform("native_spans", span),
    })


@query("SELECT doc_id, [NULL, 'length', 'hash', 'du rebuild', 'count', 'span id', 'contiguity', 'hex', 'bytes'][doc_id % 9 + 1] AS error FROM documents WHERE text <> ''")
def snapshot_valid(spark, sf_dir):
    return repair.snapshot_errors(scratch.written(_snapshots(spark, sf_dir), "snapshots"))  # written, as snapshots are kept


@query(f"""SELECT item_id, CASE WHEN a = b THEN NULL ELSE i END AS index, CASE WHEN a <> b THEN a[i + 1] END AS "left", CASE WHEN a <> b THEN b[i + 1] END AS "right" FROM (SELECT item_id, a, b, CAST(list_min(list_filter(range(greatest(len(a), len(b))), lambda i: a[i + 1] IS DISTINCT FROM b[i + 1])) AS BIGINT) AS i FROM (
  SELECT item_id, list_transform(regexp_extract_all(text, '{WORDS}'), lambda v: CAST('0x' || substr(sha256(v), 1, 8) AS BIGINT) & 2147483647) AS a,
    list_transform(regexp_extract_all(CASE WHEN strlen(text) % 3 = 0 THEN text WHEN strlen(text) % 3 = 1 THEN left(text, 60) ELSE replace(text, ' th', ' ht') END, '{WORDS}'), lambda v: CAST('0x' || substr(sha256(v), 1, 8) AS BIGINT) & 2147483647) AS b FROM benchmark))""")
def first_divergence(spark, sf_dir):
    from spanloom.operators.views import id_of, pieces

    t, k = F.col("text"), F.octet_length("text") % 3
    other = F.when(k == 0, t).when(k == 1, F.left(t, F.lit(60))).otherwise(F.replace(t, F.lit(" th"), F.lit(" ht")))
    ids = lambda x: F.transform(pieces(x, WORDS), lambda p: id_of(F.encode(p, "UTF-8")))
    d = items(spark, sf_dir).select("doc_id", ids(t).alias("a"), ids(other).alias("b"))
    return d.select(F.col("doc_id").alias("item_id"), repair.first_divergence(F.col("a"), F.col("b")).alias("v")).select("item_id", "v.index", "v.left", "v.right")


@query("SELECT item_id, strlen(text) % 2 = 0 AS restore_exact, strlen(text) % 2 = 0 AS ids_exact, true AS decode_exact, CAST(CASE WHEN strlen(text) % 2 = 0 THEN 0 ELSE 2 END AS BIGINT) AS exit_code FROM benchmark")
def full_window(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    d = items(spark, sf_dir).select("doc_id", raw.alias("fixture"), F.when(F.octet_length("text") % 2 == 0, raw).otherwise(F.concat(raw, F.unhex(F.lit("21")))).alias("restored"))
    return repair.full_window(d, RegexTokenizer(WORDS)).drop("fixture", "restored").withColumnRenamed("doc_id", "item_id")


@query(f"""SELECT conv_id, turn, CAST(len(tf) AS BIGINT) AS n_tokens, CAST(strlen(array_to_string(tf, '')) AS BIGINT) AS n_bytes,
  sha256(unhex(array_to_string(list_transform(tf, lambda v: substr(s(v), 7, 2) || substr(s(v), 5, 2) || substr(s(v), 3, 2) || substr(s(v), 1, 2)), ''))) AS ids_sha256
FROM (SELECT conv_id, turn, regexp_extract_all(string_agg(coalesce(text, ''), '') OVER (PARTITION BY conv_id ORDER BY turn), '{WORDS}') AS tf FROM conversations)""".replace("s(v)", "printf('%08x', CAST('0x' || substr(sha256(v), 1, 8) AS BIGINT) & 2147483647)"))
def repair_streaming(spark, sf_dir):
    """Turns arrive as files in the order of their numbers; the state's ids after each equal a full tokenization."""
    folder = scratch.folder(spark, "repair-stream")
    turns = conversations(spark, sf_dir)
    cuts = turns.select(F.percentile_approx("turn", [1 / 3, 2 / 3], 10_000)).first()[0] or [0, 0]  # three batches by turn number
    staged = turns.withColumn("part", 1 + (F.col("turn") > cuts[0]).cast("int") + (F.col("turn") > cuts[1]).cast("int"))
    for part in range(1, 4):
        staged.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1 << 20).parquet(f"{folder}/in")
    out = repair_stream.run_available(source, RegexTokenizer(WORDS), f"{folder}/out", f"{folder}/checkpoint", drop=1)
    return out.select("conv_id", "turn", "n_tokens", "n_bytes", "ids_sha256")


@query(f"""WITH t AS (SELECT item_id, regexp_extract_all(text, '{WORDS}') AS d, regexp_extract_all(text, '{LEXEMES}') AS l FROM benchmark)
SELECT item_id, CAST(len(d) AS BIGINT) AS n_direct, CAST(len(l) AS BIGINT) AS n_lexemes, d = l AS equal, CAST(list_min(list_filter(range(greatest(len(d), len(l))), lambda i: d[i + 1] IS DISTINCT FROM l[i + 1])) AS BIGINT) AS diverges_at FROM t""")
def lexeme_equivalence(spark, sf_dir):
    from spanloom.operators import fixtures

    return fixtures.lexeme_equivalence(items(spark, sf_dir), RegexTokenizer(WORDS), LEXEMES).drop("text").withColumnRenamed("doc_id", "item_id")


@query(with_(view("w", "words")) + "SELECT doc_id, pos, id, byte_start, byte_end FROM w")
def tokenizer_records(spark, sf_dir):
    """Rows of a callback tokenizer over whole texts."""
    from spanloom.operators import fixtures

    return fixtures.records(docs(spark, sf_dir), RegexTokenizer(WORDS), "native").select("doc_id", "pos", "id", "byte_start", "byte_end")
