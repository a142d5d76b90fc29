"""Keys above the group limit give the same rows as small ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvanite.keyed import Ordered, has_hot_group, quantiles, weighted_median
from galvanite.operators import aggregates
from galvanite.operators import cleaning as CL
from galvanite.operators import windows as W
from galvanite.plans.interpolation import interpolate_at
from galvanite.plans.spectra import spectrum
from galvanite.session import GROUP_LIMIT_KEY


def rows(df, digits=9):
    def plain(v):
        return round(v, digits) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def both(spark, make, digits=9):
    spark.conf.unset(GROUP_LIMIT_KEY)
    want = rows(make(), digits)
    spark.conf.set(GROUP_LIMIT_KEY, "16")
    try:
        got = rows(make(), digits)
    finally:
        spark.conf.unset(GROUP_LIMIT_KEY)
    assert got == want
    return want


def test_limit_is_seen(spark, runs, small_groups):
    assert has_hot_group(runs, ["k"])
    assert not has_hot_group(runs, ["k", "id"])


def test_positions(spark, runs):
    got = both(spark, lambda: Ordered(runs, ["k"], ["id"]).positions("i", "n"))
    assert len(got) == 69


def test_frames(spark, runs):
    both(spark, lambda: Ordered(runs, ["k"], ["id"]).frame(
        {"p": lambda w: F.lag("v", 3).over(w), "m": lambda w: F.avg("v").over(w.rowsBetween(-3, 3))}, halo=3))


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running(spark, runs, reverse, exclusive):
    both(spark, lambda: Ordered(runs, ["k"], ["id"]).running(
        {"s": ("sum", F.col("v")), "a": ("min", F.col("v")), "z": ("max", F.col("v")), "l": ("last", F.col("v"))}, reverse, exclusive))


def test_quantiles_and_median(spark, runs):
    both(spark, lambda: quantiles(runs, ["k"], "v", {"q1": 0.1, "q5": 0.5, "q9": 0.9}))
    both(spark, lambda: quantiles(runs, [], "v", {"q5": 0.5}))
    both(spark, lambda: weighted_median(runs, ["k"], "v", "id", "m"))


def test_sequence_operators(spark, runs):
    full = runs.withColumn("v", F.coalesce("v", F.lit(1.5)))
    both(spark, lambda: W.moving_average(full, ["k"], ["id"], "v", 5))
    both(spark, lambda: W.savgol(full, ["k"], ["id"], "v", 5, 2))
    both(spark, lambda: W.savgol_fraction(full, ["k"], ["id"], "v", 0.2, 2), 7)
    both(spark, lambda: W.decay_start(full, ["k"], ["id"], "v"))
    both(spark, lambda: W.linear_fill(runs, ["k"], ["id"], "v"))
    both(spark, lambda: W.rank_quantiles(runs, ["k"], "v"))


def test_interpolation(spark, runs):
    known = runs.where("v is not null").select("k", F.col("id").cast("double").alias("x"), "v")
    ask = runs.select("k", (F.col("id") + 0.25).alias("x"))
    for method in ("linear", "pchip", "cubic"):
        both(spark, lambda: interpolate_at(known, ask, ["k"], "x", "v", method), 8)


def test_long_spectrum_matches_numpy(spark, runs, small_groups):
    full = runs.withColumn("v", F.coalesce("v", F.lit(1.5)))
    got = spectrum(full, ["k"], "id", "v").where("k = 'a'").toPandas()
    y = np.array([r.v for r in full.where("k = 'a'").orderBy("id").collect()])
    want = np.fft.fft(y)
    got = got.sort_values("bin")
    assert np.allclose(got["re"], want.real, atol=1e-9) and np.allclose(got["im"], want.imag, atol=1e-9)


def brute_grubbs(arr, alpha, allowed):
    from galvanite.plans.kernels import grubbs_critical

    left = list(range(len(arr)))
    gone, trial, calm = [], [], 0
    while len(left) > 3:
        vals = np.array([arr[i] for i in left])
        dev = np.abs(vals - vals.mean())
        if vals.std(ddof=1) == 0:
            break
        k = int(dev.argmax())
        if dev[k] / vals.std(ddof=1) <= grubbs_critical(len(vals), alpha):
            calm += 1
            if calm >= allowed:
                gone = [g for g in gone if g not in trial]
                break
            trial.append(left[k])
        else:
            calm, trial = 0, []
        gone.append(left.pop(k))
    return sorted(gone)


@pytest.mark.parametrize("tail", [2, 64])
def test_grubbs_matches_brute_force(spark, tail):
    rng = np.random.default_rng(3)
    data = {k: np.concatenate([rng.normal(size=40), [9.0 + k, -12.0, 30.0, 31.5, 8.0]]) for k in range(3)}
    df = spark.createDataFrame([(k, i, float(v)) for k, a in data.items() for i, v in enumerate(a)], "k long, i long, v double")
    got = CL.grubbs_clip(df, ["k"], ["i"], "v", tail=tail).where("removed").collect()
    for k, a in data.items():
        assert sorted(r["i"] for r in got if r["k"] == k) == brute_grubbs(a, 0.05, 2)


@pytest.mark.parametrize("name", ["_w", "_n", "_cum", "_total"])
def test_value_columns_named_like_helpers(spark, runs, name):
    """Weights named `_w` failed above the limit: the counts had the same name."""
    df = runs.withColumnRenamed("v", name)
    both(spark, lambda: quantiles(df, ["k"], name, {"q": 0.3, "m": 0.5}))
    both(spark, lambda: weighted_median(df, ["k"], name, "id", "m"))


def test_trend_candidates_of_large_groups(spark):
    from galvanite.plans.peaks import trend_candidates

    df = spark.range(80).select(F.lit("a").alias("k"), (F.col("id") % 5).alias("temp"), (F.col("id") * 37 % 101 + 1.0).alias("f"), (F.col("id") % 9 / 9.0).alias("w"))
    assert len(both(spark, lambda: trend_candidates(df, ["k"], "temp", "f", "w", ["weight"]))) == 5


@pytest.mark.parametrize("of, reads", [
    (lambda df: quantiles(df, ["k"], "v", {"m": 0.5, "hi": 0.9}), 1),
    (lambda df: aggregates.trimmed_midpoint(df, ["k"], ["v"]), 1),
    (lambda df: aggregates.stats_summary(df, "f", "k", ["v"], "up"), 3),
])
def test_quantiles_of_large_groups_read_values_once(spark, runs, of, reads):
    """Values of groups above the limit are read once for all quantiles (moments of both levels read them too)."""
    seen = spark.sparkContext.accumulator(0)

    def noted(v):
        seen.add(1)
        return v

    df = runs.withColumn("v", F.udf(noted, "double").asNondeterministic()("v")).withColumn("f", F.lit("x")).withColumn("up", F.col("id") % 2 == 0)
    plain = rows(of(runs.withColumn("f", F.lit("x")).withColumn("up", F.col("id") % 2 == 0)))
    spark.conf.set(GROUP_LIMIT_KEY, "16")
    try:
        got = rows(of(df))
    finally:
        spark.conf.unset(GROUP_LIMIT_KEY)
    assert seen.value <= reads * runs.count()
    assert got == plain
