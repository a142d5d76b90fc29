"""Fits that end by themselves, losses and metrics as functions; two-branch circuits by their impedance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvanite.functions import circuits as C
from galvanite.plans import fits as T


def noisy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(4):
        t = np.sort(rng.uniform(0, 5, 60))
        y = (1 + k) * np.exp(-t / (0.4 + 0.3 * k)) + 0.2 + rng.normal(0, 0.02, 60)
        y[::17] += 1.5 * (k == 3)
        rows += [(k, float(a), float(b)) for a, b in zip(t, y)]
    return rows, spark.createDataFrame(rows, "k int, t double, y double")


def best_rss(rows, k):
    """Least residual sum over a very fine grid of time constants."""
    t, y = np.array([(a, b) for q, a, b in rows if q == k]).T
    out = np.inf
    for tau in np.logspace(-2, 2, 4001):
        e = np.vstack([np.exp(-t / tau), np.ones_like(t)]).T
        out = min(out, float(np.sum((y - e @ np.linalg.lstsq(e, y, rcond=None)[0]) ** 2)))
    return out


def test_rounds_end_by_themselves(spark):
    rows, df = noisy(spark)
    grid = {r["k"]: r for r in T.grid_fit(df, ["k"], "t", "y", "exp").collect()}
    for k, r in grid.items():
        assert r["converged"] and r["rounds"] > 2 and r["rss"] == pytest.approx(best_rss(rows, k), rel=1e-4) and r["rss"] <= best_rss(rows, k) * (1 + 1e-9)
    cut = {r["k"]: r["converged"] for r in T.grid_fit(df, ["k"], "t", "y", "exp", rounds=1).collect()}
    assert cut == dict.fromkeys(range(4), False)
    start = spark.createDataFrame([(k, [1.0, 1.0, 0.0]) for k in range(4)] + [(9, [1.0, 1.0, 0.0])], "k int, p array<double>")
    got = {r["k"]: r for r in T.gauss_newton(df, ["k"], "t", "y", "exp", start).collect()}
    assert set(got) == {0, 1, 2, 3, 9} and not got[9]["converged"]
    for k in range(4):
        assert got[k]["converged"] and got[k]["rss"] == pytest.approx(grid[k]["rss"], rel=1e-6)
    assert len({got[k]["rounds"] for k in range(4)}) > 1
    short = {r["k"]: r["converged"] for r in T.gauss_newton(df, ["k"], "t", "y", "exp", start, 1).collect()}
    assert not any(short.values())


def test_loss_and_metric_functions(spark):
    _, df = noisy(spark)
    one = df.where("k = 3")
    start = spark.createDataFrame([(3, [3.0, 1.0, 0.0])], "k int, p array<double>")
    flat = lambda z: (2 * (F.sqrt(1 + z) - 1), 1 / F.sqrt(1 + z))
    by_name = T.gauss_newton(one, ["k"], "t", "y", "exp", start, loss="soft_l1").first()
    by_function = T.gauss_newton(one, ["k"], "t", "y", "exp", start, loss=flat).first()
    assert by_name["p"] == pytest.approx(by_function["p"]) and by_name["converged"]
    params = spark.createDataFrame([(3, list(by_name["p"]))], "k int, p array<double>")
    worst = T.curve_error(one, ["k"], "t", "y", "exp", params, lambda y, fit, w: F.max(F.abs(y - fit))).first()["error"]
    assert 1.0 < worst < 2.0


def impedance(kind, a, b, c, d, s):
    if kind == "voigt":
        return a / (1 + s * a * b) + c / (1 + s * c * d)
    return 1 / (1 / a + s * b + 1 / (c + 1 / (s * d)))


def test_equivalent_circuits_have_one_impedance(spark):
    rng = np.random.default_rng(5)
    vals = [tuple(map(float, 10.0 ** rng.uniform(-3, 3, 4))) for _ in range(200)]
    df = spark.createDataFrame(vals, "a double, b double, c double, d double")
    cols = [F.col(x) for x in "abcd"]
    there = df.select(*cols, *[x.alias(f"m{i}") for i, x in enumerate(C.voigt_to_maxwell(*cols))])
    both = there.select("*", *[x.alias(f"v{i}") for i, x in enumerate(C.maxwell_to_voigt(*[F.col(f"m{i}") for i in range(4)]))])
    s = 2j * np.pi * np.logspace(-6, 6, 41)
    for r in both.collect():
        z = impedance("voigt", *r[:4], s)
        assert np.allclose(impedance("maxwell", *r[4:8], s), z, rtol=1e-6) and np.allclose(impedance("voigt", *r[8:12], s), z, rtol=1e-6)
        assert r[8] * r[9] >= r[10] * r[11]


def test_circuits_without_a_second_pole(spark):
    df = spark.createDataFrame([(2.0, 3.0, 6.0, 1.0)], "a double, b double, c double, d double")
    cols = [F.col(x) for x in "abcd"]
    assert df.select(*C.voigt_to_maxwell(*cols)).first()[:] == (8.0, 0.75, 0.0, 0.75)
    for rb, cb in ((0.0, 0.75), (5.0, 0.0)):
        assert df.select(*C.maxwell_to_voigt(F.lit(8.0), F.lit(0.75), F.lit(rb), F.lit(cb))).first()[:] == (4.0, 1.5, 4.0, 1.5)


def test_rounds_in_tasks_equal_rounds_as_jobs(spark, monkeypatch):
    """Small segments of a named model take one job for all rounds; a line fitted by an exponential needs hundreds."""
    from pyspark.sql import functions as F

    from galvanite.plans import fits as T
    from galvanite.session import GROUP_LIMIT_KEY

    rows = spark.range(400).select((F.col("id") % 3).alias("k"), (F.col("id") % 40 / 40.0).alias("t"), (2 * F.exp(-(F.col("id") % 40) / 15.0) + F.col("id") % 7 / 50.0).alias("y"))
    start = spark.createDataFrame([(k, [1.0, 0.3, 0.1]) for k in (0, 1, 2, 9)], "k long, p array<double>")
    fit = lambda: {r["k"]: r for r in T.gauss_newton(rows, ["k"], "t", "y", "exp", start, 12).collect()}
    spark.conf.set(GROUP_LIMIT_KEY, "16")
    try:
        want = fit()
    finally:
        spark.conf.unset(GROUP_LIMIT_KEY)

    def refused(*args):
        raise AssertionError("a job per round")

    monkeypatch.setattr(T, "_rounds_as_jobs", refused)
    monkeypatch.setattr(T, "CHUNK_POINTS", 50)
    got = fit()
    assert got.keys() == want.keys() == {0, 1, 2, 9}
    for k, r in got.items():
        assert (r["n"], r["rounds"], r["converged"]) == (want[k]["n"], want[k]["rounds"], want[k]["converged"])
        assert r["p"] == pytest.approx(want[k]["p"], rel=1e-8) and r["rss"] == pytest.approx(want[k]["rss"], rel=1e-9)


def test_equivalents_share_terms(spark):
    rows = [(8.0, 0.75, 3.0, 0.5), (100.0, 0.02, 40.0, 0.3), (5.0, 0.0, 2.0, 1.0), (5.0, 1.0, 0.0, 1.0), (None, 1.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "ra double, ca double, rb double, cb double")
    names = ["r1", "c1", "r2", "c2"]
    want = df.select("*", *[x.alias(n) for n, x in zip(names, C.maxwell_to_voigt(*[F.col(c) for c in df.columns]))])
    got = C.with_voigt(df, df.columns, names)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert plan(got) < plan(want) / 3


def test_circuit_fits_without_a_frame_each(spark):
    from galvanite.plans import circuit_fits
    from galvanite.plans.kernels import circuit_impedance

    model, true, f = "R0-p(R1,C1)", {"R0": 10.0, "R1": 1000.0, "C1": 1e-4}, 10.0 ** np.linspace(-2, 3, 25)
    z = circuit_impedance(model, true, f)
    sweeps = spark.createDataFrame([(k, float(a), float(b.real), float(b.imag)) for k in ("a", "b") for a, b in zip(f, z)], "k string, f double, re double, im double")
    starts = [(k, no, n, v, lo, hi, n == "R0" and k == "b") for k in ("a", "b") for no, by in ((0, 1.0), (1, 3.0))
              for n, v, lo, hi in (("R0", 10.0 if k == "b" else 4.0 * by, 0.1, 1e4), ("R1", 300.0 * by, 1.0, 1e6), ("C1", 1e-5 * by, 1e-9, 0.1))]
    start = spark.createDataFrame(starts, "k string, start_no int, param string, value double, lb double, ub double, locked boolean")
    out = circuit_fits.fit_circuits(sweeps, ["k"], "f", "re", "im", model, start)
    assert "CoGroup" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.k, r.param): r for r in out.collect()}
    assert len(got) == 6 and all(abs(r.value / true[n] - 1) < 1e-6 for (_, n), r in got.items())
    assert got["b", "R0"].std == 0 and got["b", "R0"].value == 10.0
