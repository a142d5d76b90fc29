"""Peaks of curves in blocks against the kernel on the whole curve."""

import random

import numpy as np
import pytest

from galvanite.plans import peaks as K
from galvanite.plans.kernels import peak_properties


def peaks_by_hand(y):
    """Prominence and width of every flat or single maximum by walking outwards."""
    n, out = len(y), []
    i = 1
    while i < n - 1:
        j = i
        while j < n - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < n - 1 and y[j + 1] < y[i]:
            p = (i + j) // 2
            lows = []
            for step in (-1, 1):
                k, low = p, y[p]
                while 0 <= k + step < n and y[k + step] <= y[p]:
                    k += step
                    low = min(low, y[k])
                lows.append(low)
            prom = y[p] - max(lows)
            level, ends = y[p] - prom / 2, []
            for step in (-1, 1):
                k = p
                while y[k] > level:
                    k += step
                part = (level - y[k]) / (y[k - step] - y[k]) if y[k] < level else 0.0
                ends.append(k - step * part)
            out.append((p, y[p], prom, ends[1] - ends[0]))
        i = j + 1
    return out


def curves(seed):
    rng = random.Random(seed)
    kinds = {
        "walk": np.cumsum([rng.choice([-2, -1, 0, 0, 1, 2]) for _ in range(150)]).astype(float),
        "wave": np.sin(np.arange(120) / 5) * np.exp(-np.arange(120) / 60) + np.array([rng.choice([0, 0.01]) for _ in range(120)]),
        "up": np.arange(60.0), "down": np.arange(60.0)[::-1], "flat": np.ones(50), "steps": np.repeat([0.0, 2, 1, 3, 1, 3, 0], 17), "three": np.array([0.0, 1, 0]), "one": np.array([5.0]),
    }
    return kinds


def rows_of(spark, kinds):
    return spark.createDataFrame([(k, float(i) + 1, float(v)) for k, y in kinds.items() for i, v in enumerate(y)], "k string, f double, y double")


@pytest.mark.parametrize("seed", range(3))
def test_kernel(seed):
    for y in curves(seed).values():
        at, prom, width = peak_properties(np.asarray(y))
        assert list(zip(at.tolist(), prom.tolist(), width.tolist())) == [(p, pytest.approx(m), pytest.approx(w)) for p, _, m, w in peaks_by_hand(list(y))]


@pytest.mark.parametrize("limit", ["16", "7"])
def test_curves_of_many_blocks(spark, limit):
    kinds = curves(11)
    spark.conf.set("spark.galvanite.groupLimit", limit)
    try:
        got = K.local_maxima(rows_of(spark, kinds), ["k"], "f", "y").collect()
    finally:
        spark.conf.unset("spark.galvanite.groupLimit")
    found = {(r["k"], int(r["peak_freq"]) - 1): (r["peak_value"], r["prominence"], r["points"]) for r in got}
    want = {(k, p): (v, m, w) for k, y in kinds.items() for p, v, m, w in peaks_by_hand(list(y))}
    assert found.keys() == want.keys() and len(want) > 20
    for at, w in want.items():
        assert found[at] == pytest.approx(w, abs=1e-9), at


def test_wide_peaks_of_large_curves(spark):
    df = rows_of(spark, {k: y for k, y in curves(5).items() if k in ("walk", "wave", "steps")})
    want = sorted(map(tuple, K.find_wide_peaks(df, ["k"], "f", "y").collect()))
    spark.conf.set("spark.galvanite.groupLimit", "16")
    try:
        got = sorted(map(tuple, K.find_wide_peaks(df, ["k"], "f", "y").collect()))
    finally:
        spark.conf.unset("spark.galvanite.groupLimit")
    assert len(got) == len(want) > 3
    for g, w in zip(got, want):
        assert g[:1] == w[:1] and g[1:] == pytest.approx(w[1:], rel=1e-6, abs=1e-9)
