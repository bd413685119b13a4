"""Helpers that the operators of this subpackage share: input tables, row keys, A-Z folding, and the library's written tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.ranks import numbered
from spanloom.scratch import written as materialize

__all__ = ["fold", "materialize", "numbered", "row_keyed", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows_of_files(docs: DataFrame) -> bool:
    """Whether each row is a row of one file source, only filtered and projected."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "_metadata" not in docs.columns


def row_keyed(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with a unique key of each row that every use of the frame sees alike.

    Rows read from Parquet files are named by file and place; others are numbered and written.
    """
    if _rows_of_files(docs):
        try:
            return docs.withColumn(column, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
        except AnalysisException:  # files without row numbers
            pass
    return materialize(docs.withColumn(column, F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))), "rows")


def fold(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)
