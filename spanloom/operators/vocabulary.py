"""Vocabularies: build, shape, lookup, checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A vocabulary is shipped to executors only below these sizes; beyond, ``segment.segment_join`` does without.
BROADCAST_ENTRIES, BROADCAST_BYTES = 4_000_000, 128 << 20


def usable(vocab: DataFrame, min_id: int = 0) -> DataFrame:
    """Non-empty pieces, one row each: the lowest id >= ``min_id`` of equal bytes."""
    return vocab.where((F.octet_length("bytes") > 0) & (F.col("id") >= min_id)).groupBy("bytes").agg(F.min("id").alias("id")).select("id", "bytes")


def lookup(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``tokens`` with ``piece_id``: the lowest vocabulary id of their bytes, or null."""
    return tokens.join(usable(vocab).select(F.col("id").alias("piece_id"), F.col("bytes")), "bytes", "left")


def bytes_of(ids: DataFrame, vocab: DataFrame, id_col: str = "id") -> DataFrame:
    """``ids`` with the bytes of each id; an unknown id fails the query."""
    out = ids.join(vocab.select(F.col("id").alias("_vid"), "bytes"), F.col(id_col) == F.col("_vid"), "left")
    text = F.concat(F.lit("token id out of range: "), F.col(id_col).cast("string"))
    return out.withColumn("bytes", F.when(F.col("_vid").isNull(), F.raise_error(text).cast("binary")).otherwise(F.col("bytes"))).drop("_vid")


def shipped(vocab: DataFrame, min_id: int = 0) -> list[tuple[int, bytes]]:
    """The usable pieces on the driver, for a broadcast; refused above the size bounds."""
    own = usable(vocab, min_id)
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()
    if n > BROADCAST_ENTRIES or size > BROADCAST_BYTES:
        raise ValueError(f"a vocabulary of {n} pieces and {size} bytes is too large to broadcast; use segment_join")
    return [(r.id, bytes(r.bytes)) for r in own.collect()]


def given(vocab: DataFrame | list[tuple[int, bytes]], min_id: int = 0) -> list[tuple[int, bytes]]:
    """``shipped``, unless it was already: one collection then serves several operators."""
    return [(i, b) for i, b in vocab if i >= min_id] if isinstance(vocab, list) else shipped(vocab, min_id)


def shape(vocab: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Entries, empty ones, total and mean bytes, and the lengths at rank int((n - 1) * p) for p of 0.5, 0.9, 0.99 and 1.

    Ranks come from counts per distinct length (a few hundred rows), so no list of all lengths is gathered.
    """
    by = by or []
    sizes = vocab.withColumn("size", F.octet_length("bytes").cast("bigint")).groupBy(*by, "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("size") if by else Window.partitionBy(F.lit(0)).orderBy("size")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(whole)})
    rank = lambda p: F.floor((F.col("total") - 1) * p)
    at = {f"p{int(p * 100)}": F.min(F.when(F.col("upto") > rank(p), F.col("size"))) for p in (0.5, 0.9, 0.99)}
    return sizes.groupBy(*by).agg(
        F.sum("n").alias("entries"), F.coalesce(F.sum(F.when(F.col("size") == 0, F.col("n"))), F.lit(0)).cast("bigint").alias("empty"), F.sum(F.col("n") * F.col("size")).alias("total_bytes"),
        (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean_bytes"), *[e.alias(k) for k, e in at.items()], F.max("size").alias("max_bytes"),
    )


def printable(lexemes: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` lexemes by gid that are printable ASCII, white space included, and not blank; with their text."""
    text = F.decode("bytes", "UTF-8")
    ok = (F.octet_length("bytes") > 0) & text.rlike(r"^[\t\n\r\x20-\x7e]*$") & (F.trim(text, F.lit(" \t\n\r")) != "")
    return lexemes.where(ok).orderBy("gid").limit(n).select("gid", "bytes", text.alias("text"))


def longest(lexemes: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` longest lexemes, lowest gid first among equals."""
    return lexemes.withColumn("size", F.octet_length("bytes").cast("bigint")).orderBy(F.desc("size"), "gid").limit(n)


def dictionary(pieces: DataFrame) -> DataFrame:
    """gid and bytes of the distinct ``bytes`` of ``pieces``, numbered by their bytes.

    The numbering ranges over the distinct entries only; a global rank is their one ordered pass.
    """
    from spanloom.operators.ranks import numbered

    return numbered(pieces.select("bytes").distinct(), ["bytes"], "gid").select("gid", "bytes")
