import numpy as np
import pytest
from pyspark.sql import functions as F

from galvanite.functions import circuits as CF
from galvanite.functions import forms as M
from galvanite.functions import text as X
from galvanite.functions import units as U
from galvanite.functions.complexnum import Cx
from galvanite.operators import windows as W
from galvanite.plans import circuit_fits as C
from galvanite.plans import decays as D
from galvanite.plans import fits as T
from galvanite.plans import kernels as K
from galvanite.plans import peaks as P
from galvanite.plans import spectra as S


def test_t_quantile_and_grubbs():
    assert K.t_quantile(0.975, 10) == pytest.approx(2.2281388519, abs=1e-8)
    assert K.t_quantile(0.025, 3) == pytest.approx(-3.1824463053, abs=1e-8)
    assert K.grubbs_critical(10) == pytest.approx(2.290, abs=1e-3)


def test_peak_properties():
    at, prom, width = K.peak_properties(np.array([0, 1, 0, 3, 1, 2, 0.0]))
    assert at.tolist() == [1, 3, 5] and prom.tolist() == [1, 3, 1]
    assert width.tolist() == [1, 1.25, 0.75]
    assert K.peak_properties(np.array([0, 2, 2, 2, 0.0]))[0].tolist() == [2]


def test_type_k_reference_points(spark):
    df = spark.createDataFrame([(100.0, 4.096), (1000.0, 41.276), (-100.0, -3.554), (0.0, 0.0)], "c double, mv double")
    for r in df.select("c", "mv", U.celsius_to_millivolt(F.col("c")).alias("e"), U.millivolt_to_celsius(F.col("mv")).alias("t")).collect():
        assert r["e"] == pytest.approx(r["mv"], abs=6e-4)
        assert r["t"] == pytest.approx(r["c"], abs=0.06)
    back = spark.range(1).select(U.millivolt_to_celsius(F.lit(1.0), 30.0)).first()[0]
    assert 50 < back < 56


@pytest.mark.parametrize("form", [f for f in M.FORM_NAMES if f != "impedance"])
def test_forms_round_trip(spark, form):
    df = spark.createDataFrame([(10.0, 1.0, -1.0), (100.0, 2.0, -2.0), (1e3, 3.0, -3.0), (1e4, 4.0, -4.0)], "f double, re double, im double")
    s = M.Sample(F.col("f"), 25.0, 0.05, sigma_dc=F.lit(1e-7), eps_inf=F.lit(3.0))
    back = M.to_impedance(M.from_impedance(Cx(F.col("re"), F.col("im")), form, s), form, s)
    for r in df.select("re", "im", back.re.alias("a"), back.im.alias("b")).collect():
        assert r["a"] == pytest.approx(r["re"], rel=1e-6) and r["b"] == pytest.approx(r["im"], rel=1e-6)


def test_circuit_columns_match_numpy(spark):
    model = "R0-p(R1,CPE1)-p(R2,C2-L1)-K3-ICPE4"
    vals = {"R0": 5.0, "R1": 100.0, "CPE1_0": 1e-5, "CPE1_1": 0.8, "R2": 40.0, "C2": 1e-6, "L1": 1e-3, "K3_0": 7.0, "K3_1": 1e-3, "ICPE4_0": 20.0, "ICPE4_1": 0.5}
    assert CF.model_parameters(model) == list(vals)
    freqs = np.logspace(-2, 5, 12)
    z = CF.model_impedance(model, vals, F.col("f"))
    got = spark.createDataFrame([(float(f),) for f in freqs], "f double").select("f", z.re.alias("re"), z.im.alias("im")).orderBy("f").toPandas()
    want = K.circuit_impedance(model, vals, freqs)
    assert np.allclose(got["re"], want.real) and np.allclose(got["im"], want.imag)


def test_model_checks(spark):
    texts = ["R0-p(R1,C1)", "R0-p(R1,C1", "R0--C1", "R0-R0", "R0-p(R1,C1)-p(K2,CPE3)", "R0-X1", "R1(C1)"]
    got = {r["model"]: r["valid"] for r in CF.model_checks(spark.createDataFrame([(t,) for t in texts], "model string")).collect()}
    assert [got[t] for t in texts] == [True, False, False, False, True, False, False]


def segments(spark):
    i = F.floor(F.col("id") / 4)
    df = spark.range(0, 4 * 120).select((F.col("id") % 4).alias("seg"), (i * 0.05).alias("t"))
    return df.withColumn("y", (1 + F.col("seg")) * F.exp(-F.col("t") / (0.5 + 0.2 * F.col("seg"))) + 0.3)


def test_exponential_fit_recovers_truth(spark):
    got = T.fit_curves(segments(spark), ["seg"], "t", "y", "exp", iterations=4).orderBy("seg").collect()
    for r in got:
        a, tau, b = r["p"]
        assert a == pytest.approx(1 + r["seg"], rel=1e-5) and tau == pytest.approx(0.5 + 0.2 * r["seg"], rel=1e-5) and b == pytest.approx(0.3, rel=1e-4)
        assert r["error"] < 1e-6


def test_double_exponential_grid(spark):
    df = segments(spark).withColumn("y", F.exp(-F.col("t") / 0.3) + 2 * F.exp(-F.col("t") / 3.0) + 0.5)
    for r in T.double_grid_fit(df, ["seg"], "t", "y", points=12, rounds=2).collect():
        assert r["rss"] < 1e-3 and r["tau0"] == pytest.approx(0.3, rel=0.3)


def test_custom_model(spark):
    df = spark.range(0, 50).select(F.lit(1).alias("k"), (F.col("id") / 10).alias("t")).withColumn("y", 2 * F.sin(F.col("t")) + 1)
    start = spark.createDataFrame([(1, [1.0, 0.0])], "k int, p array<double>")
    got = T.gauss_newton(df, ["k"], "t", "y", lambda t, p0, p1: p0 * F.sin(t) + p1, start, 4).first()
    assert got["p"] == pytest.approx([2.0, 1.0], abs=1e-6)


def test_bounds_and_constants(spark):
    guess = spark.createDataFrame([(1, 2.0, 0.5, -1.0)], "k int, a0 double, tau0 double, b0 double")
    rules = spark.createDataFrame([("a0", 1.0, None, 5.0)], "param string, lb double, p0 double, ub double")
    got = {r["param"]: r for r in T.prepare_bounds(guess, ["k"], ["a0", "tau0", "b0"], rules, constants=["b0"]).collect()}
    assert got["a0"]["lb"] == 1.0 and got["a0"]["ub"] == 5.0
    assert got["tau0"]["lb"] < 0.5 < got["tau0"]["ub"]
    assert got["b0"]["ub"] - got["b0"]["lb"] < 1e-9


def test_savgol_fraction_equals_fixed_window(spark, runs):
    full = runs.where("k = 'a'").withColumn("v", F.coalesce("v", F.lit(1.0)))
    a = W.savgol(full, ["k"], ["id"], "v", 7, 2).orderBy("id").toPandas()["smooth"]
    b = W.savgol_fraction(full, ["k"], ["id"], "v", 7.01 / 60, 2).orderBy("id").toPandas()["smooth"]
    assert np.allclose(a, b, atol=1e-8)


def sweep(spark):
    df = spark.range(0, 3 * 60).select((F.col("id") % 3).alias("ds"), F.floor(F.col("id") / 3).alias("j"))
    df = df.withColumn("f", F.pow(F.lit(10.0), -2 + F.col("j") * 7 / 59)).withColumn("w", F.col("f") * 2 * F.pi() * 1e3 * (1 + F.col("ds")) * 1e-5)
    return df.withColumn("re", 10 + 1000 / (1 + F.col("w") * F.col("w"))).withColumn("im", -1000 * F.col("w") / (1 + F.col("w") * F.col("w")))


@pytest.mark.parametrize("sequential", [False, True])
def test_circuit_fit(spark, sequential):
    df = sweep(spark)
    items = F.array(*[F.struct(F.lit(n).alias("param"), F.lit(v).alias("value"), F.lit(a).alias("lb"), F.lit(b).alias("ub"))
                      for n, v, a, b in (("R0", 10.0 if sequential else 5.0, 0.1, 1e4), ("R1", 900.0, 1.0, 1e6), ("C1", 1e-5, 1e-9, 1e-2))])
    start = df.select("ds").distinct().withColumn("start_no", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("x", F.explode(items))
    start = start.select("ds", "start_no", "x.*", F.lit(False).alias("locked"))
    got = C.fit_circuits(df, ["ds"], "f", "re", "im", "R0-p(R1,C1)", start, sequential=sequential, iterations=1).collect()
    vals = {(r["ds"], r["param"]): r["value"] for r in got}
    assert len(vals) == 9
    if not sequential:
        for ds in range(3):
            assert vals[ds, "R1"] == pytest.approx(1000, rel=1e-5) and vals[ds, "C1"] == pytest.approx(1e-5 * (1 + ds), rel=1e-5)


def test_linkk_explains_an_arc(spark):
    got = C.linkk_model(C.linkk(sweep(spark), ["ds"], "f", "re", "im", c=0.5, max_m=40)).collect()
    assert all(r["rms"] < 200 and r["model"].startswith("R0-L0-K0") for r in got)


def test_permittivity_of_a_decay(spark):
    df = segments(spark).withColumn("v", F.lit(2.0))
    prep = D.prepare_decay(D.decay_from_data(df, ["seg"], "t", "y", "v", method="pchip"), ["seg"], 0.075)
    perm = S.permittivity(prep, ["seg"], "log", 50, "pchip")
    lim = S.permittivity_limits(perm, ["seg"]).collect()
    assert len(lim) == 4 and all(r["dc_real"] > r["inf_real"] for r in lim)


def test_period_of_a_sine(spark):
    df = spark.range(0, 400).select(F.lit("r").alias("k"), "id").withColumn("v", F.signum(F.sin(2 * F.pi() * (F.col("id") + 0.5) / 80)))
    assert S.detect_period(df, ["k"], ["id"], "v").first()["period"] == 40


def test_wide_peaks(spark):
    j = F.col("id")
    df = spark.range(0, 300).select(F.lit(1).alias("k"), F.pow(F.lit(10.0), -2 + j * 6 / 299).alias("f"))
    lf = F.log10("f")
    df = df.withColumn("y", F.exp(-(lf - 1) * (lf - 1) * 4) + 0.5 * F.exp(-(lf - 3) * (lf - 3) * 8))
    got = [r["peak_freq"] for r in P.find_wide_peaks(df, ["k"], "f", "y").orderBy("peak_freq").collect()]
    assert any(abs(np.log10(p) - 1) < 0.05 for p in got) and any(abs(np.log10(p) - 3) < 0.05 for p in got)


def test_names(spark):
    df = spark.createDataFrame([("100pre85c_r1",), ("cln1dh60c_r2",), ("bad",)], "n string")
    got = [r[0] for r in df.select(X.segment_name_parts(F.col("n"))).collect()]
    assert tuple(got[0]) == ("100", "pre", 85.0, 100, "r1") and got[1]["sodium"] == 0 and got[2] is None
    runs = spark.createDataFrame([("a_r3",), ("b-run12",), ("c",), ("x_7",)], "n string").select(X.run_number(F.col("n"))).collect()
    assert [r[0] for r in runs] == [3, 12, 0, 7]


def test_general_number(spark):
    df = spark.createDataFrame([(1234.5,), (12.5,), (7.0,), (0.00012,)], "x double")
    assert [r[0] for r in df.select(X.general_number(F.col("x"))).collect()] == ["1.23e3", "12.5", "7", "1.2e-4"]


def test_decay_from_fit_spreads_its_points(spark):
    """Parameters in one part: the points of twelve long segments are made in several tasks."""
    rows = [(k, [1.0, 0.5 + k * 1200.0, 0.1], [0.0, 1.0, 2.0]) for k in range(12)]
    fits = spark.createDataFrame(rows, "k int, c array<double>, v array<double>").coalesce(1)
    out = D.decay_from_fit(fits, ["k"], "c", "v")
    got = {r["k"]: r for r in out.groupBy("k").agg(F.count("i").alias("n"), F.max("t").alias("end"), F.max("dt").alias("dt")).collect()}
    assert all(r["n"] == round(r["end"] / r["dt"]) + 1 for r in got.values()) and len(got) == 12
    assert out.rdd.getNumPartitions() > 1
    plan = spark.range(1).select(D.uniform_grid(F.col("id").cast("double"), F.col("id") + 1.0, F.lit(0.1)).alias("g"))
    assert plan.first()["g"] == [0.0 + i * (1.0 / 10) for i in range(11)]
    inner = plan._jdf.queryExecution().analyzed().toString()
    assert "round(" not in inner.split("lambdafunction(", 1)[1]  # not at every point again
