import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from galvanite.session import GROUP_LIMIT_KEY, build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_groups(spark):
    """Groups above 16 rows count as large inside the test."""
    spark.conf.set(GROUP_LIMIT_KEY, "16")
    yield 16
    spark.conf.unset(GROUP_LIMIT_KEY)


@pytest.fixture
def runs(spark):
    """200 rows per key, uneven values, one key three times as long."""
    from pyspark.sql import functions as F

    a = spark.range(0, 60).select(F.lit("a").alias("k"), F.col("id"), ((F.col("id") * 37) % 101 / 7.0).alias("v"))
    b = spark.range(0, 9).select(F.lit("b").alias("k"), F.col("id"), ((F.col("id") * 11) % 13 / 3.0).alias("v"))
    return a.unionByName(b).withColumn("v", F.when(F.col("id") % 9 != 4, F.col("v")))
