"""Queries on vocabularies, dictionaries, remaps and segmentation lanes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import bytestrings as B
from spanloom.operators import remap, segment, timings, validate, vocabulary
from spanloom.operators.views import LEXEMES, WORDS, pieces, tokens
from spanloom.plans.spans import docs, items, table
from spanloom.plans.sql import VOCAB, greedy, view, with_

QUERIES, ORACLES = {}, {}
_CUT = re.compile(LEXEMES.encode())


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def lexeme_rows(df: DataFrame) -> DataFrame:
    return df.select(F.explode(pieces(F.col("text"), LEXEMES)).alias("tok")).select(F.encode("tok", "UTF-8").alias("bytes"))


def shipped(spark: SparkSession, sf_dir: str) -> list[tuple[int, bytes]]:
    """256 single bytes, then the benchmark's lexemes of two to six bytes: every text can be represented.

    It is broadcast to segment with, so its size is bounded; it is sorted on the driver, and refused above the bound.
    """
    words = lexeme_rows(table(spark, sf_dir, "benchmark")).where(F.octet_length("bytes").between(2, 6)).distinct().limit(vocabulary.BROADCAST_ENTRIES + 1).collect()
    if len(words) > vocabulary.BROADCAST_ENTRIES:
        raise ValueError("the benchmark has too many lexemes for a broadcast vocabulary")
    return list(enumerate([bytes([i]) for i in range(256)] + sorted(bytes(r.bytes) for r in words)))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(shipped(spark, sf_dir), "id bigint, bytes binary")


DICT = "dict AS (SELECT row_number() OVER (ORDER BY hex(encode(tok))) - 1 AS gid, lower(hex(encode(tok))) AS h, CAST(strlen(tok) AS BIGINT) AS n FROM (SELECT DISTINCT tok FROM d))"


@query(with_(view("d", "lexemes"), DICT) + """SELECT count(*) AS entries, count(*) FILTER (n = 0) AS empty, CAST(sum(n) AS BIGINT) AS total_bytes, avg(n) AS mean_bytes,
  list(n ORDER BY n)[CAST(floor((count(*) - 1) * 0.5) AS BIGINT) + 1] AS p50, list(n ORDER BY n)[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS p90, list(n ORDER BY n)[CAST(floor((count(*) - 1) * 0.99) AS BIGINT) + 1] AS p99, max(n) AS max_bytes FROM dict""")
def vocab_shape(spark, sf_dir):
    return vocabulary.shape(lexeme_rows(docs(spark, sf_dir)).distinct())


@query(with_(view("d", "lexemes"), DICT) + "SELECT gid, h AS bytes_hex, n AS size FROM dict ORDER BY n DESC, gid LIMIT 15")
def longest_lexemes(spark, sf_dir):
    d = vocabulary.dictionary(lexeme_rows(docs(spark, sf_dir)))
    return vocabulary.longest(d).select("gid", B.to_hex(F.col("bytes")).alias("bytes_hex"), "size")


@query(with_(view("d", "lexemes"), DICT) + "SELECT gid, h AS bytes_hex FROM dict")
def du_dictionary(spark, sf_dir):
    return vocabulary.dictionary(lexeme_rows(docs(spark, sf_dir))).select("gid", B.to_hex(F.col("bytes")).alias("bytes_hex"))


@query(with_(VOCAB, view("d", "lexemes"), DICT, "src AS (SELECT gid AS key, h FROM dict)", greedy("g", "src"), recursive=True) + "SELECT key AS gid, h AS bytes_hex, rtrim(ids, ',') AS target_ids, n AS n_ids FROM g_done")
def lexeme_remap(spark, sf_dir):
    m = remap.build_map(vocabulary.dictionary(lexeme_rows(docs(spark, sf_dir))), shipped(spark, sf_dir))
    return m.select("gid", B.to_hex(F.col("bytes")).alias("bytes_hex"), F.array_join("target_ids", ",").alias("target_ids"), F.size("target_ids").cast("bigint").alias("n_ids"))


@query(with_(VOCAB, view("d", "lexemes", "benchmark", "item_id"), DICT, "src AS (SELECT gid AS key, h FROM dict)", greedy("g", "src"), recursive=True) + "SELECT key AS gid, rtrim(ids, ',') AS target_ids FROM g_done")
def lexeme_remap_join(spark, sf_dir):
    m = segment.segment_join(vocabulary.dictionary(lexeme_rows(table(spark, sf_dir, "benchmark"))), vocab(spark, sf_dir))
    return m.select("gid", F.array_join("ids", ",").alias("target_ids"))


@query(with_(VOCAB, view("d", "lexemes"), DICT, "src AS (SELECT gid AS key, h FROM dict)", greedy("g", "src"), recursive=True) + "SELECT count(*) AS entries, CAST(sum(n) AS BIGINT) AS ids, CAST(4 * sum(n) AS BIGINT) AS payload_bytes, CAST(8 * (count(*) + 1) + 4 * sum(n) AS BIGINT) AS map_bytes FROM g_done")
def csr_accounting(spark, sf_dir):
    return remap.map_size(remap.build_map(vocabulary.dictionary(lexeme_rows(docs(spark, sf_dir))), shipped(spark, sf_dir)))


def stream_of(spark, rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, pos, gid of the lexeme view, by the dictionary's bytes."""
    t = tokens(rows, "doc_id", LEXEMES, "du")
    return t.join(dictionary, "bytes").select("doc_id", "pos", "gid")


_DISTINCT = "e AS (SELECT DISTINCT lower(hex(encode(tok))) AS key, lower(hex(encode(tok))) AS h FROM d)"


@query(with_(VOCAB, view("d", "lexemes"), _DISTINCT, greedy("g", "e"), "l AS (SELECT doc_id, list(d.n ORDER BY pos) AS lens, count(*) AS positions, CAST(sum(g_done.n) AS BIGINT) AS emitted, CAST(sum(d.n) AS BIGINT) AS du_bytes, CAST(sum(g_done.off) AS BIGINT) AS target_bytes, count(DISTINCT tok) AS distinct_gids FROM d JOIN g_done ON g_done.key = lower(hex(encode(tok))) GROUP BY doc_id)",
             "r AS (SELECT *, list_reduce(lens, lambda a, x: CASE WHEN a % 1000000 + x >= 64 THEN (a // 1000000 + 1) * 1000000 ELSE a + x END, CAST(0 AS BIGINT)) AS a FROM l)", recursive=True)
       + "SELECT r.doc_id, positions, emitted, du_bytes, target_bytes, distinct_gids, sha256(text) AS du_sha256, sha256(text) AS target_sha256, CAST(a // 1000000 + CASE WHEN a % 1000000 > 0 THEN 1 ELSE 0 END AS BIGINT) AS chunks FROM r JOIN documents USING (doc_id)")
def remap_summary(spark, sf_dir):
    d = docs(spark, sf_dir).where("text <> ''").select("doc_id", pieces(F.col("text"), LEXEMES).alias("parts"))
    return remap.translate(d, shipped(spark, sf_dir), 64)


@query(with_(VOCAB, view("d", "lexemes", "benchmark", "item_id"), _DISTINCT, greedy("g", "e"), recursive=True)
       + "SELECT doc_id AS item_id, count(*) AS positions, CAST(sum(g_done.n) AS BIGINT) AS emitted, CAST(sum(d.n) AS BIGINT) AS du_bytes, count(DISTINCT tok) AS distinct_gids, any_value(sha256(text)) AS du_sha256, any_value(sha256(text)) AS target_sha256 FROM d JOIN g_done ON g_done.key = lower(hex(encode(tok))) JOIN benchmark ON item_id = doc_id GROUP BY doc_id")
def remap_summary_rows(spark, sf_dir):
    """The summary from rows: a numbered dictionary, its map, and the stream of its gids, folded in order."""
    d, v = items(spark, sf_dir), shipped(spark, sf_dir)
    words = vocabulary.dictionary(lexeme_rows(d))
    out = remap.summary(stream_of(spark, d, words), remap.build_map(words, v), v, 64)
    return out.select(F.col("doc_id").alias("item_id"), "positions", "emitted", "du_bytes", "distinct_gids", "du_sha256", "target_sha256")


@query(with_(VOCAB, view("d", "lexemes", "benchmark", "item_id"), DICT, "src AS (SELECT gid AS key, h FROM dict)", greedy("g", "src"), "x AS (SELECT key, string_split(rtrim(ids, ','), ',') AS l FROM g_done)", recursive=True)
       + "SELECT doc_id AS item_id, pos, CAST(s AS BIGINT) AS sub, key AS gid, CAST(l[s + 1] AS BIGINT) AS target_id FROM (SELECT doc_id, pos, key, l, unnest(range(len(l))) AS s FROM d JOIN dict ON dict.h = lower(hex(encode(tok))) JOIN x ON x.key = gid)")
def remap_expand(spark, sf_dir):
    d = items(spark, sf_dir)
    words = vocabulary.dictionary(lexeme_rows(d))
    return remap.expand(stream_of(spark, d, words), remap.build_map(words, shipped(spark, sf_dir))).withColumnRenamed("doc_id", "item_id")


@query("SELECT doc_id, doc_id % 7 <> 3 AS exact, sha256(text) AS target_sha256, CAST(strlen(text) AS BIGINT) AS target_bytes FROM documents WHERE text <> ''")
def remap_hash_triangle(spark, sf_dir):
    """Raw, DU and target bytes of each text agree in length and digest; some raw texts are spoilt."""
    d = docs(spark, sf_dir).where("text <> ''")
    out = remap.translate(d.select("doc_id", pieces(F.col("text"), LEXEMES).alias("parts")), shipped(spark, sf_dir), 64)
    given = d.select("doc_id", F.encode(F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("#"), F.expr("substring(text, 2)"))).otherwise(F.col("text")), "UTF-8").alias("raw"))
    return remap.triangle(out, given).select("doc_id", "exact", "target_sha256", "target_bytes")


#: A vocabulary without the byte of "7" alone, so some lexemes have no segmentation.
_LACK = "v2 AS (SELECT * FROM vocab WHERE h <> '37'), s2 AS (SELECT DISTINCT length(h) // 2 AS k FROM v2)"


@query(with_(VOCAB, _LACK, view("d", "lexemes"), DICT, "src AS (SELECT gid AS key, h FROM dict)", greedy("g", "src", "v2", "s2"), "c AS (SELECT length(h) // 2 AS n, off = length(h) // 2 AS ok FROM g_done)", recursive=True)
       + "SELECT count(*) AS types, count(*) FILTER (ok) AS ok_types, count(*) FILTER (NOT ok) AS bad_types, CAST(sum(n) AS BIGINT) AS all_bytes, CAST(sum(n) FILTER (ok) AS BIGINT) AS ok_bytes, CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) AS fraction FROM c")
def coverage(spark, sf_dir):
    return remap.coverage(vocabulary.dictionary(lexeme_rows(docs(spark, sf_dir))), vocab(spark, sf_dir).where("bytes <> X'37'"))[0]


@query(with_(VOCAB, _LACK, view("d", "lexemes"), DICT, "src AS (SELECT gid AS key, h FROM dict)", greedy("g", "src", "v2", "s2"), recursive=True)
       + "SELECT key AS gid, CAST(off AS BIGINT) AS failed_at FROM g_done WHERE off < length(h) // 2 ORDER BY key LIMIT 50")
def coverage_failures(spark, sf_dir):
    return remap.coverage(vocabulary.dictionary(lexeme_rows(docs(spark, sf_dir))), vocab(spark, sf_dir).where("bytes <> X'37'"))[1]


@query(with_(VOCAB, "dup AS (SELECT id, h FROM vocab UNION ALL SELECT id + 10000, h FROM vocab UNION ALL SELECT 0, ''), low AS (SELECT h, min(id) AS id FROM dup WHERE h <> '' GROUP BY h)", view("d", "words"))
       + "SELECT doc_id, pos, low.id AS piece_id FROM d LEFT JOIN low ON low.h = lower(hex(encode(tok)))")
def piece_lookup(spark, sf_dir):
    v = vocab(spark, sf_dir)
    dup = v.unionByName(v.withColumn("id", F.col("id") + 10_000)).unionByName(v.limit(1).select(F.lit(0).cast("bigint").alias("id"), F.unhex(F.lit("")).alias("bytes")))
    return vocabulary.lookup(tokens(docs(spark, sf_dir), "doc_id", WORDS, "word"), dup).select("doc_id", "pos", "piece_id")


_SRC = "src AS (SELECT item_id AS key, lower(hex(encode(text))) AS h FROM benchmark)"


@query(with_(VOCAB, _SRC, greedy("g", "src"), recursive=True) + "SELECT key AS item_id, rtrim(ids, ',') AS ids, n AS n_ids FROM g_done")
def stream_longest(spark, sf_dir):
    r = segment.segment(items(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("bytes")), shipped(spark, sf_dir))
    return r.select(F.col("doc_id").alias("item_id"), F.array_join("ids", ",").alias("ids"), F.size("ids").cast("bigint").alias("n_ids"))


_WORDS32 = "array_to_string(list_transform(string_split(rtrim(ids, ','), ','), lambda v: printf('%02x%02x%02x%02x', CAST(v AS BIGINT) & 255, (CAST(v AS BIGINT) >> 8) & 255, (CAST(v AS BIGINT) >> 16) & 255, (CAST(v AS BIGINT) >> 24) & 255)), '')"


@query(with_(VOCAB, view("d", "lexemes"), _DISTINCT, greedy("g", "e"), f"x AS (SELECT key, n, {_WORDS32} AS w FROM g_done)", "y AS (SELECT doc_id, CAST(sum(x.n) AS BIGINT) AS n_ids, sha256(unhex(string_agg(w, '' ORDER BY pos))) AS ids_sha256 FROM d JOIN x ON x.key = lower(hex(encode(tok))) GROUP BY doc_id)", recursive=True)
       + "SELECT doc_id, coalesce(n_ids, 0) AS n_ids, coalesce(ids_sha256, sha256('')) AS ids_sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS decoded_sha256, true AS exact FROM documents LEFT JOIN y USING (doc_id)")
def stream_longest_documents(spark, sf_dir):
    """Whole documents, segmented and decoded again in one pass."""
    return segment.round_trip(docs(spark, sf_dir).select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes")), shipped(spark, sf_dir))


#: Breadth-first levels over the offsets that n pieces can reach; the first level to reach the end is the minimum.
_MIN = "f AS (SELECT key, h, 0 AS off, CAST(0 AS BIGINT) AS n FROM src UNION ALL SELECT DISTINCT f.key, f.h, CAST(f.off + s.k AS INT), f.n + 1 FROM f, sizes s, vocab v WHERE v.h = substr(f.h, f.off * 2 + 1, s.k * 2) AND length(v.h) = s.k * 2 AND NOT EXISTS (SELECT 1 FROM f e WHERE e.key = f.key AND e.off * 2 = length(e.h))), m AS (SELECT key, min(n) AS n FROM f WHERE off * 2 = length(h) GROUP BY key)"


@query(with_(VOCAB, _SRC, _MIN, recursive=True) + "SELECT key AS item_id, n AS n_ids FROM m")
def min_token_count(spark, sf_dir):
    r = segment.segment(items(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("bytes")), shipped(spark, sf_dir), "minimum")
    return r.select(F.col("doc_id").alias("item_id"), F.size("ids").cast("bigint").alias("n_ids"))


#: No piece of the vocabulary mixes white space with other bytes, so a text's minimum is the sum of its lexemes' minima.
_MIN_LEXEMES = ("src AS (SELECT key, h FROM e)", _MIN)


@query(with_(VOCAB, view("d", "lexemes"), _DISTINCT, *_MIN_LEXEMES, recursive=True) + "SELECT doc_id, CAST(sum(m.n) AS BIGINT) AS n_ids FROM d JOIN m ON m.key = lower(hex(encode(tok))) GROUP BY doc_id")
def min_token_count_documents(spark, sf_dir):
    d = docs(spark, sf_dir).where("text <> ''").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return segment.segment(d, shipped(spark, sf_dir), "minimum").select("doc_id", F.size("ids").cast("bigint").alias("n_ids"))


def cut_lexemes(raw: bytes) -> list[bytes]:
    return _CUT.findall(raw)


@query(with_(VOCAB, _SRC, greedy("g", "src"), _MIN, view("d", "lexemes", "benchmark", "item_id"), "e AS (SELECT DISTINCT lower(hex(encode(tok))) AS key, lower(hex(encode(tok))) AS h FROM d)", greedy("x", "e"), "a AS (SELECT doc_id AS key, CAST(sum(x_done.n) AS BIGINT) AS n FROM d JOIN x_done ON x_done.key = lower(hex(encode(tok))) GROUP BY doc_id)", recursive=True) + """
SELECT key AS item_id, a.n AS per_lexeme, g_done.n AS stream, m.n AS minimum, a.n - m.n AS per_lexeme_regret, g_done.n - m.n AS stream_regret, 100.0::DOUBLE * (g_done.n - m.n) / m.n AS stream_regret_pct, 100.0::DOUBLE * (a.n - g_done.n) / a.n AS reduction_pct
FROM a JOIN g_done USING (key) JOIN m USING (key)""")
def lane_comparison(spark, sf_dir):
    r = segment.lanes(items(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("bytes")), shipped(spark, sf_dir), cut_lexemes)
    return timings.regret(r.drop("bytes")).withColumnRenamed("doc_id", "item_id")


@query(with_(VOCAB, view("d", "lexemes"), _DISTINCT, greedy("g", "e"), *_MIN_LEXEMES, "t AS (SELECT doc_id, CAST(sum(g_done.n) AS BIGINT) AS a, CAST(sum(m.n) AS BIGINT) AS m FROM d JOIN g_done ON g_done.key = lower(hex(encode(tok))) JOIN m ON m.key = g_done.key GROUP BY doc_id)", recursive=True)
       + "SELECT doc_id, a AS per_lexeme, a AS stream, m AS minimum, a - m AS per_lexeme_regret, a - m AS stream_regret, 100.0::DOUBLE * (a - m) / m AS stream_regret_pct, CAST(0.0 AS DOUBLE) AS reduction_pct FROM t")
def lane_comparison_documents(spark, sf_dir):
    d = docs(spark, sf_dir).where("text <> ''").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return timings.regret(segment.lanes(d, shipped(spark, sf_dir), cut_lexemes).drop("bytes"))


@query(with_(view("d", "lexemes"), DICT, "p AS (SELECT gid, h, decode(unhex(h)) AS text FROM dict WHERE n > 0)")
       + "SELECT gid, h AS bytes_hex, text FROM p WHERE regexp_full_match(text, '[\\x20-\\x7e\\t\\n\\r]*') AND trim(text, E' \\t\\n\\r') <> '' ORDER BY gid LIMIT 20")
def printable_lexemes(spark, sf_dir):
    d = vocabulary.printable(vocabulary.dictionary(lexeme_rows(docs(spark, sf_dir))))
    return d.select("gid", B.to_hex(F.col("bytes")).alias("bytes_hex"), "text")


@query("SELECT doc_id, CAST(strlen(coalesce(text, '')) AS DOUBLE) / 1048576 / nullif(CAST(doc_id % 1000 * 1000 AS DOUBLE) / 1e9, 0) AS mib_per_second FROM documents")
def throughput(spark, sf_dir):
    """Bytes over measured nanoseconds; null where no time passed. The measurements are stood for by a function of the id."""
    d = docs(spark, sf_dir)
    return d.select("doc_id", timings.mib_per_second(F.octet_length(F.coalesce("text", F.lit(""))), F.col("doc_id") % 1000 * 1000).alias("mib_per_second"))


@query("""SELECT source, count(n_chars) AS n, min(n_chars) AS least, avg(n_chars) AS mean, max(n_chars) AS most, list(n_chars ORDER BY n_chars)[count(*) // 2 + 1] AS upper_median,
  CAST((list(n_chars ORDER BY n_chars)[(count(*) + 1) // 2] + list(n_chars ORDER BY n_chars)[count(*) // 2 + 1]) // 2 AS BIGINT) AS mean_median, count(DISTINCT lang) AS outputs FROM documents GROUP BY source""")
def repeat_summary(spark, sf_dir):
    return timings.repeats(table(spark, sf_dir, "documents"), ["source"], "n_chars", "lang")


@query("""SELECT source, list_sort(list(DISTINCT lang) FILTER (doc_id % 2 = 0)) IS NOT DISTINCT FROM list_sort(list(DISTINCT lang) FILTER (doc_id % 2 = 1)) AS same FROM documents GROUP BY source""")
def cold_warm_outputs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("phase", F.when(F.col("doc_id") % 2 == 0, "cold").otherwise("warm"))
    return timings.same_outputs(d, ["source"], "phase", "lang").select("source", "same")


@query("SELECT item_id, v AS variant, e AS error FROM benchmark, (VALUES (0, CAST(NULL AS VARCHAR)), (1, 'count'), (2, 'first'), (3, 'order'), (4, 'last')) x(v, e) WHERE strlen(text) > 1")
def csr_check(spark, sf_dir):
    """Each item's lexeme ends as offsets over its bytes: whole, and with one fault of each kind."""
    sizes = F.transform(pieces(F.col("text"), WORDS), lambda p: F.octet_length(p).cast("bigint"))
    d = items(spark, sf_dir).where(F.octet_length("text") > 1).select("doc_id", F.octet_length("text").cast("bigint").alias("payload"), sizes.alias("sizes"))
    one = F.lit(1).cast("bigint")
    sums = F.transform(F.sequence(F.lit(0), F.size("sizes")), lambda i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x))
    d = d.select("doc_id", "payload", F.size("sizes").alias("entries"), sums.alias("good"))
    # the fault of order needs an inner offset, so an entry without bytes stands before the last
    good, pay = F.col("good"), F.col("payload")
    forms = (good, F.concat(good, F.array(pay)), F.transform(good, lambda x, i: F.when(i == 0, one).otherwise(x)), F.concat(F.array(F.lit(0).cast("bigint"), pay + 1), F.slice(good, F.lit(2), F.size(good) - 1)), F.transform(good, lambda x, i: F.when(i == F.size(good) - 1, x + 1).otherwise(x)))
    v = F.explode(F.array(*[F.struct(F.lit(i).alias("variant"), f.alias("offsets"), (F.col("entries") + (1 if i == 3 else 0)).alias("n")) for i, f in enumerate(forms)])).alias("v")
    return d.select("doc_id", "payload", v).select(F.col("doc_id").alias("item_id"), "v.variant", validate.csr_error(F.col("v.offsets"), F.col("payload"), F.col("v.n")).alias("error"))
