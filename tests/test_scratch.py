"""The shared folder: required on clusters, numbering of ties, cleaning up."""

import os

import pytest
from pyspark.sql import functions as F

from spanloom import scratch
from spanloom.operators.ranks import numbered


class Cluster:
    """A session on a cluster without the setting."""

    class conf:
        @staticmethod
        def get(_, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}


def test_a_cluster_needs_the_setting():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.root(Cluster)


def test_numbering_of_equal_rows(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") % 2).alias("v"))
    got = [tuple(r) for r in numbered(df, ["k", "v"], "at").orderBy("at").collect()]
    assert [r[2] for r in got] == list(range(1000)) and [r[1] for r in got] == [0] * 500 + [1] * 500
    assert numbered(df.limit(0), ["k"], "at").count() == 0


def test_clean(spark):
    at = scratch.written(spark.range(3), "numbers")
    assert at.count() == 3 and os.path.isdir(scratch.own_folder(spark))
    scratch.clean(spark)
    assert not os.path.isdir(scratch.own_folder(spark))
