"""Values of zero, exact ties and the last bit of a logarithm give what the SQL twins give."""

import math

import pytest
from pyspark.sql import functions as F

from galvanite.functions import circuits as C
from galvanite.functions import forms as M
from galvanite.functions import text as X
from galvanite.functions import units as U
from galvanite.functions.complexnum import Cx
from galvanite.functions.ieee import log10
from galvanite.functions.standard import raw_to_standard
from galvanite.operators import regress as R
from galvanite.operators import windows as W


def one(df):
    return df.first().asDict()


def test_forms_at_zero_frequency(spark):
    df = spark.createDataFrame([(0.0, 1.0, -2.0, 0.5, 1.0)], "f double, re double, im double, sdc double, inf double")
    s = M.Sample(F.col("f"), sigma_dc=F.col("sdc"), eps_inf=F.col("inf"))
    z = Cx(F.col("re"), F.col("im"))
    got = one(df.select(M.from_impedance(z, "chi", s).real.alias("chi"), M.from_impedance(z, "e_r_corr", s).imag.alias("corr")))
    assert got["chi"] == math.inf and math.isnan(got["corr"])


def test_decade_of_zero(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([2.0, 0.0, 0.0, 3.0, 4.0])], "k string, i int, v double")
    got = W.decade_labels(df, ["k"], ["i"], "v").orderBy("i").collect()
    assert [r["marked"] for r in got] == [True, True, False, True, False]


def test_detrend_over_log_of_zero(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 2.0), ("b", 1.0, 1.0), ("b", 10.0, 2.0)], "k string, f double, y double")
    got = R.detrend(df, ["k"], log10(F.col("f")), "y").orderBy("k", "f").collect()
    assert [r["detrended"] for r in got[:2]] == [None, None] and got[3]["detrended"] == pytest.approx(0.0)


def test_log_spacing_from_zero(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 1.0, 10.0)] + [("b", v) for v in (1.0, 10.0, 100.0)] + [("c", 0.0)], "k string, f double")
    assert {r["k"]: r["log_spaced"] for r in R.log_spacing(df, ["k"], "f").collect()} == {"a": False, "b": True, "c": True}


def test_number_text_of_ties(spark):
    df = spark.createDataFrame([(198500.0,), (65450.0,), (9725.0,), (1.005,), (None,)], "v double")
    got = [r["t"] for r in df.select(X.scientific(F.col("v")).alias("t")).collect()]
    assert got == ["1.98E+05", "6.54E+04", "9.72E+03", "1.00E+00", None]


def test_resistance_without_current(spark):
    df = spark.createDataFrame([(0.0, 0.0, None), (2.0, 0.0, None), (2.0, None, 0.0)], "raw_voltage double, raw_current double, raw_resistance double")
    got = raw_to_standard(df).select("current", "resistance").collect()
    assert math.isnan(got[0]["resistance"]) and got[1]["resistance"] == math.inf and got[2]["current"] == math.inf


def test_rc_pair_of_zero(spark):
    df = spark.createDataFrame([("a", 0, "R1", 5.0), ("a", 1, "C1", 0.0)], "k string, i int, name string, value double")
    assert one(C.rc_pairs(df, ["k"], ["i"], "name", "value"))["f_rc"] == math.inf


def test_form_expressions_at_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0)], "f double, re double, im double")
    got = one(M.with_forms(df, "f", "re", "im", {"lg": "log10(abs(Z.mag)) * 2", "y": "Y.real"}))
    assert got["lg"] == -math.inf and math.isnan(got["y"])


def test_decade_grid_counts(spark):
    df = spark.range(1, 300).select((F.col("id") + 1.0).alias("lo"), ((F.col("id") + 1.0) * 100).alias("hi"))
    counts = {r["lo"]: r["n"] for r in U.decade_grid(df, "lo", "hi", 4).groupBy("lo").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {x: int(1 + 4 * abs(math.log10(x) - math.log10(x * 100))) for x in (i + 1.0 for i in range(1, 300))}
