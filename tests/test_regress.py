import math

import pytest
from pyspark.sql import functions as F

from galvanite.keyed import checked_once, has_hot_group
from galvanite.operators import regress as R


def test_keys_without_points_stay(spark):
    df = spark.createDataFrame([("a", 1.0, math.e), ("a", 2.0, math.e**2), ("b", 1.0, None), ("c", 1.0, 5.0)], "k string, x double, y double")
    got = {r["k"]: r for r in R.exponential_fit(df, ["k"], "x", "y").collect()}
    assert got["a"]["beta"] == pytest.approx(1.0) and got["a"]["alpha"] == pytest.approx(1.0)
    assert got["b"]["n"] == 0 and got["b"]["alpha"] is None
    assert got["c"]["n"] == 1 and got["c"]["beta"] is None


def test_fixed_slope_and_intercept(spark):
    df = spark.createDataFrame([("a", float(x), 3.0 * x + 2) for x in range(1, 6)], "k string, x double, y double")
    assert R.linear_fit(df, ["k"], "x", "y", slope=3.0).first()["b"] == pytest.approx(2.0)
    assert R.linear_fit(df, ["k"], "x", "y", intercept=2.0).first()["m"] == pytest.approx(3.0)
    assert R.arrhenius_fit(df, ["k"], "x", "y", ea=0.6).first()["Ea"] == pytest.approx(0.6)


def test_one_check_covers_finer_keys(spark, runs, small_groups):
    short = runs.where("k = 'b'")
    with checked_once(short, ["k"]):
        assert not has_hot_group(runs, ["k"])
    assert has_hot_group(runs, ["k"])
    with checked_once(runs, ["k"]):
        assert has_hot_group(runs, ["k"])
