"""Steps whose cost per key or per task grew beyond the input."""

import numpy as np
from pyspark.sql import functions as F

from galvanite import keyed
from galvanite.operators import channels as C
from galvanite.operators import cleaning as CL
from galvanite.operators import regress as R
from galvanite.plans import interpolation as I
from galvanite.plans import kernels as N
from galvanite.plans import peaks as K
from galvanite.plans import spectra as S


def plan_of(df):
    return df._jdf.queryExecution().toString()


def many_keys(spark, n=40):
    """Keys of 3 to 12 rows, one of them null."""
    rows = [(k or None, float(i), float((i * 7 + k * 3) % 11)) for k in range(n) for i in range(3 + k % 10)]
    return spark.createDataFrame(rows, "k int, x double, y double").repartition(3)


def test_grubbs_critical_values_are_remembered(spark):
    N.grubbs_critical.cache_clear()
    for _ in range(5):
        CL.clip_sequence([(-50.0, 0), (1.0, 1)], [(60.0, 2), (2.0, 3)], (30, 1.5, 4.0), 0.05, 2)
    seen = N.grubbs_critical.cache_info()
    assert seen.hits >= 4 * seen.misses > 0


def test_grubbs_clip_of_many_short_keys(spark):
    rows = [(k or None, i, 1000.0 if i == 5 else float(i % 3)) for k in range(30) for i in range(20)]
    got = CL.grubbs_clip(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], ["i"], "v")
    assert sorted((r["k"] or 0, r["i"]) for r in got.where("outlier").collect()) == [(k, 5) for k in range(30)]


def test_splines_of_many_short_keys_share_a_call(spark):
    df = many_keys(spark)
    got = I.spline_slopes(df, ["k"], "x", "y")
    assert "FlatMapGroupsInPandas" not in plan_of(got)
    found = {(r["k"], r["x"]): r["_d"] for r in got.collect()}
    assert len(found) == df.count()
    for k in {r["k"] for r in df.select("k").distinct().collect()}:
        xs, ys = map(np.array, zip(*sorted((r["x"], r["y"]) for r in df.where(F.col("k").eqNullSafe(F.lit(k))).collect())))
        assert [found[k, x] for x in xs] == [float(d) for d in I.spline_derivatives(xs, ys)]


def test_peaks_and_spectra_of_many_short_keys_share_a_call(spark):
    df = many_keys(spark)
    peaks, spec = K.local_maxima(df, ["k"], "x", "y"), S.spectrum(df, ["k"], "x", "y")
    assert "FlatMapGroupsInPandas" not in plan_of(peaks) + plan_of(spec)
    rows = {}
    for r in df.collect():
        rows.setdefault(r["k"], []).append((r["x"], r["y"]))
    want_peaks, want_spec = set(), {}
    for k, points in rows.items():
        xs, ys = map(np.array, zip(*sorted(points)))
        at, prom, width = N.peak_properties(ys)
        want_peaks |= {(k, float(xs[p]), float(ys[p]), float(w), float(q)) for p, q, w in zip(at, prom, width)}
        want_spec |= {(k, b): complex(z) for b, z in enumerate(np.fft.fft(ys))}
    assert {tuple(r) for r in peaks.select("k", "peak_freq", "peak_value", "points", "prominence").collect()} == want_peaks
    assert {(r["k"], r["bin"]): complex(r["re"], r["im"]) for r in spec.collect()} == want_spec


def test_weights_of_few_large_keys_leave_the_rows_in_place(spark):
    df = spark.createDataFrame([(k or None, float(i), 2.0 * i + k, float(i % 5)) for k in range(3) for i in range(50)], "k int, x double, y double, e double")
    got = R.error_weights(df, ["k"], "e")
    assert "BroadcastHashJoin" in plan_of(got) and "SortMergeJoin" not in plan_of(got)
    got.collect()
    lines = R.group_trend(df, ["k"], "x", ["y"], "linear", error="e").collect()
    assert sorted((r["k"] or 0, r["n"], round(r["m"], 9), round(r["b"], 9)) for r in lines) == [(k, 50, 2.0, float(k)) for k in range(3)]


def test_traits_sort_the_rows_once_for_all_columns(spark):
    df = spark.createDataFrame([(k, i, 10.0 ** i, -float(i), None if i == 2 else 5.0) for k in "ab" for i in range(6)], "k string, i int, f double, b double, c double")
    got = C.column_traits(df, ["k"], ["i"], ["f", "b", "c"])
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Expand" not in plan and plan.count("Window [") == 1
    rows = {(r["k"], r["column"]): r for r in got.collect()}
    assert len(rows) == 6 and rows["a", "c"]["n"] == 5 and rows["a", "b"]["monotone"] == 1 and rows["b", "f"]["log_spread"] < 1e-9
    assert [rows["a", c]["position"] for c in "fbc"] == [1, 2, 3] and rows["a", "b"]["log_spread"] is None


def test_blocks_of_a_split_key_are_smaller_than_the_limit(spark, monkeypatch):
    monkeypatch.setattr(keyed, "BLOCK_ROWS", 10)
    df = spark.createDataFrame([("a", i, float(i % 7)) for i in range(95)], "k string, i int, v double")
    seq = keyed.Ordered(df, ["k"], ["i"], limit=40)
    assert seq._blocks().select("_kx_b").distinct().count() == 10
    got = seq.running({"s": ("sum", F.col("v"))}).collect()
    assert all(r["s"] == sum(float(j % 7) for j in range(r["i"] + 1)) for r in got)


def test_grids_of_a_small_table_are_made_in_several_tasks(spark, monkeypatch):
    seen = []
    real = S.spread_by_points
    monkeypatch.setattr(S, "spread_by_points", lambda rows, points: seen.append(rows.count()) or real(rows, points, per_task=10))
    rows = spark.createDataFrame([(k, i, 1.0, float(16 - i)) for k in range(3) for i in range(16)], "k int, i int, dt double, decay double")
    assert S.permittivity(rows, ["k"], "log", 0, "pchip").select("k", "freq").distinct().count() == 48
    assert seen == [3]
