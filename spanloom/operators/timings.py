"""Summaries of repeated measurements: two medians, digests of outputs, percent differences of lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upper_median(x: Column) -> Column:
    """Element n // 2 of the sorted values; for the few repetitions of one measurement."""
    return F.element_at(F.array_sort(F.collect_list(x)), (F.floor(F.count(x) / 2) + 1).cast("int"))


def mean_median(x: Column) -> Column:
    """Integer mean of the middle two, or the middle one."""
    s, n = F.array_sort(F.collect_list(x)), F.count(x)
    lo = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    hi = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.floor((lo + hi) / 2).cast("bigint")


def repeats(rows: DataFrame, by: list[str], value: str, output: str | None = None) -> DataFrame:
    """min, mean, max, both medians and, with ``output``, the number of distinct outputs per group."""
    v = F.col(value)
    more = [F.countDistinct(output).alias("outputs")] if output else []
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.avg(v).alias("mean"), F.max(v).alias("most"), upper_median(v).alias("upper_median"), mean_median(v).alias("mean_median"), *more)


def same_outputs(rows: DataFrame, by: list[str], phase: str, output: str) -> DataFrame:
    """Whether the two phases (cold, warm) of each group made the same set of outputs."""
    g = rows.groupBy(*by).agg(*[F.array_sort(F.collect_set(F.when(F.col(phase) == p, F.col(output)))).alias(p) for p in ("cold", "warm")])
    return g.withColumn("same", F.col("cold") == F.col("warm"))


def regret(lanes: DataFrame) -> DataFrame:
    """Tokens and percent that each lane spends over the minimum, and what the stream lane saves on the per-lexeme one."""
    pct = lambda a, b: F.try_divide(100.0 * a.cast("double"), b.cast("double"))
    a, b, d = (F.col(c) for c in ("per_lexeme", "stream", "minimum"))
    return lanes.withColumns({"per_lexeme_regret": a - d, "stream_regret": b - d, "stream_regret_pct": pct(b - d, d), "reduction_pct": pct(a - b, a)})


def mib_per_second(nbytes: Column, nanos: Column) -> Column:
    return F.try_divide(nbytes.cast("double") / (1 << 20), nanos.cast("double") / 1e9)
