"""URL filters (native): host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Every URL is expanded into the expressions ``host suffix + path prefix`` that some rule could equal. Only the suffix
label counts and prefix lengths that occur among the rules are made; both lists are bounded by ``MAX_LABELS`` and
``MAX_PATH`` because longer rules are refused. The expressions meet the rules by an equi-join on ``PREFIX_HEX`` hex
digits of their SHA-256; the full digests are then compared, and of the confirmed rules the longest wins.

Defined cases: a null URL, or one without ``://``, has empty host and path and gets the default verdict. Equal rules with
different verdicts: block wins. Of two fitting rules of equal length the longer host wins. Repeated rows each keep their
row. Other columns of the input are kept under their names; its columns named like a result column are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import fold, materialize, table

PREFIX_HEX = 8
MAX_LABELS, MAX_PATH = 127, 4096
BROADCAST_RULES = 100_000
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
RESULT = ("host", "path", "rule", "verdict")


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = fold(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule (``host`` + ``path`` of the winning rule, else null) and verdict."""
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)
    r = rules.select(fold(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), "verdict").dropna()
    r = r.withColumn("labels", F.size(F.split("r_host", r"\.")))
    shape = r.agg(
        F.count("*").alias("n"), F.max("labels").alias("labels"), F.max(F.length("r_path")).alias("path"),
        F.array_sort(F.collect_set(F.when(F.col("labels") <= MAX_LABELS, F.col("labels")))).alias("counts"),
        F.array_sort(F.collect_set(F.when(F.length("r_path") <= MAX_PATH, F.length("r_path")))).alias("lengths"),
    ).first()
    if (shape.labels or 0) > MAX_LABELS or (shape.path or 0) > MAX_PATH:
        raise ValueError("a rule exceeds MAX_LABELS host labels or MAX_PATH path characters")
    host, path = split_url(F.col(url))
    rows = urls.drop(*[c for c in RESULT if c in urls.columns]).withColumns({"host": host, "path": path})
    if not shape.n:
        return rows.withColumns({"rule": F.lit(None).cast(T.StringType()), "verdict": F.lit(default)})
    r = r.groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict"))  # "block" > "allow"
    r = r.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("prefix", F.substring("r_digest", 1, PREFIX_HEX))
    # the suffixes and prefixes of each distinct host and path, as arrays within the row
    parts = F.split("host", r"\.")
    suffixes = F.array(*[F.when(F.size("parts") >= n, F.array_join(F.slice("parts", -n, n), ".")) for n in shape.counts])
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in shape.lengths])
    tried = (
        rows.select("host", "path").distinct().withColumn("parts", parts)
        .select("host", "path", F.explode(F.array_compact(suffixes)).alias("suffix"))
        .select("host", "path", "suffix", F.explode(F.array_compact(prefixes)).alias("start"))
        .withColumn("digest", digest(F.col("suffix"), F.col("start")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    hits = tried.join(F.broadcast(r) if shape.n <= BROADCAST_RULES else r, "prefix").where(F.col("digest") == F.col("r_digest"))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("verdict"), F.concat("r_host", "r_path").alias("rule"))).alias("b")
    )
    # a written table: the join below then exchanges both sides, so a hot URL's rows can be split
    best = materialize(best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict")), "url-verdicts")
    return rows.join(best.hint("merge"), ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(
        *[c for c in rows.columns if c not in RESULT], *RESULT
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark)).drop("url")


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, host, path, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.v, length(r.h || r.p)) AS v
      FROM h LEFT JOIN r ON (h.host = r.h OR suffix(h.host, '.' || r.h)) AND starts_with(h.path, r.p) GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m
"""
