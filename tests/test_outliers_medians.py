"""Grubbs sequence and suffix medians against plain re-implementations."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvanite.operators import cleaning as CL
from galvanite.operators import windows as W
from galvanite.plans.kernels import grubbs_critical


def grubbs_by_hand(values, alpha=0.05, allowed=2):
    """Removes the farthest value of the whole list again and again."""
    left, removed, provisional, calm = list(enumerate(values)), [], set(), 0
    while len(left) > 3:
        v = np.array([x for _, x in left])
        std = v.std(ddof=1)
        if std == 0:
            break
        far = np.abs(v - v.mean())
        k = max(range(len(left)), key=lambda j: (round(far[j], 9), -left[j][0]))
        if far[k] / std <= grubbs_critical(len(left), alpha):
            calm += 1
            if calm >= allowed:
                return [r for r in removed if r[0] not in provisional]
            provisional.add(left[k][0])
            removed.append((left[k][0], False))
        else:
            calm, provisional = 0, set()
            removed.append((left[k][0], True))
        left.pop(k)
    return removed


@pytest.mark.parametrize("seed", range(12))
def test_clip_sequence(seed):
    rng = random.Random(seed)
    n = rng.choice([3, 4, 7, 20, 120])
    values = [rng.gauss(0, 1) + rng.choice([0] * 12 + [8, -9, 40, -300]) for _ in range(n)]
    if seed % 3 == 0:
        values = [float(round(v)) for v in values]
    want = grubbs_by_hand(values, allowed=1 + seed % 3)
    pairs = [(v, i) for i, v in enumerate(values)]
    low, high = sorted(pairs), sorted(pairs, key=lambda e: (-e[0], e[1]))
    assert CL.clip_sequence(low, [], (0, 0.0, 0.0), 0.05, 1 + seed % 3) == (want, False)
    tail = n // 3
    core = [v for v, i in pairs if (v, i) not in low[:tail] and (v, i) not in high[:tail]]
    if tail and core:
        got, short = CL.clip_sequence(low[:tail], high[:tail], (len(core), statistics.fmean(core), sum((v - statistics.fmean(core)) ** 2 for v in core)), 0.05, 1 + seed % 3)
        assert got == (want[:len(got)] if short else want)


def test_hundred_thousand_outliers(spark):
    """Two far levels around 50,000 calm values, one key: the farthest level goes, its values one after the other."""
    n = 60_000
    df = spark.range(n).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 6 == 0, 1e6 + F.col("id")).otherwise(F.sin("id")).alias("v"))
    df = df.unionByName(spark.range(n, n + 20).select(F.lit(2).alias("k"), "id", F.col("id").cast("double").alias("v")))
    got = CL.grubbs_clip(df, ["k"], ["id"], "v").where("removed").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low")).collect()
    assert [tuple(r) for r in got if r["k"] == 2] == []
    pairs = [(float(r["v"]), r["id"]) for r in df.where("k = 1").collect()]
    removed, _ = CL.clip_sequence(sorted(pairs), [], (0, 0.0, 0.0), 0.05, 2)
    assert sum(r["n"] for r in got) == len(removed)


def test_many_removals_are_quick():
    """100,000 values far out on a calm core leave in linear time."""
    rng = np.random.default_rng(1)
    calm = rng.normal(0, 1, 2_000_000)
    far = 1e3 + np.sort(rng.exponential(1e6, 100_000))[::-1] ** 2
    high = [(float(v), i) for i, v in enumerate(far)]
    low = [(float(v), 10**6 + i) for i, v in enumerate(np.sort(calm)[:1000])]
    core = np.sort(calm)[1000:]
    removed, short = CL.clip_sequence(low, high, (len(core), float(core.mean()), float(((core - core.mean()) ** 2).sum())), 0.05, 2)
    assert len(removed) > 90_000 and all(out for _, out in removed[:90_000])


def series(spark):
    rng = random.Random(2)
    rows = []
    for k, n in (("a", 40), ("b", 1), ("c", 2), ("d", 3), ("e", 19)):
        v = 100.0
        for i in range(n):
            v += rng.choice([0, -1, -2, -0.5, 3]) if i < n - 9 else -0.1
            rows.append((k, i, None if rng.random() < 0.05 and n > 3 else round(v, 3)))
    return rows, spark.createDataFrame(rows, "k string, i long, v double")


def skew_by_hand(rows, threshold):
    out = {}
    for k in {r[0] for r in rows}:
        v = [x for _, _, x in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])]
        steps = [(i, abs(b - a)) for i, (a, b) in enumerate(zip(v, v[1:])) if a is not None and b is not None]
        hits = []
        for j, (i, _) in enumerate(steps):
            rest = [s for _, s in steps[j:]]
            median = statistics.median(rest)
            if median and statistics.fmean(rest) / median < threshold and i < len(v) - 2:
                hits.append(i)
        out[k] = min(hits) if hits else len(v) - 1 if steps else 0
    return out


@pytest.mark.parametrize("threshold", [1.05, 3.0])
def test_skew_limit_small_and_large(spark, small_groups, threshold):
    rows, df = series(spark)
    want = skew_by_hand(rows, threshold)
    large = {r["k"]: r["skew_limit"] for r in W.skew_limit(df, ["k"], ["i"], "v", threshold).collect()}
    assert large == want
    spark.conf.set("spark.galvanite.groupLimit", "1000")
    assert {r["k"]: r["skew_limit"] for r in W.skew_limit(df, ["k"], ["i"], "v", threshold).collect()} == want


def test_suffix_medians(spark, small_groups):
    rng = random.Random(7)
    rows = [(k, i, float(rng.choice([1, 1, 2, 3, 5, 8]) * rng.choice([1, -1]))) for k in "ab" for i in range(50 if k == "a" else 1)]
    got = {(r["k"], r["i"]): r["median"] for r in W.suffix_medians(spark.createDataFrame(rows, "k string, i long, v double"), ["k"], "i", "v").collect()}
    assert got == {(k, i): statistics.median([v for q, j, v in rows if q == k and j >= i]) for k, i, _ in rows}


@pytest.mark.parametrize("values, first", [
    ([60.94, 25.38, 74.74, 84.26, 5.7, 16.91, 39.59, 15.89, 21.31, 3.52, 39.72, 49.5, 67.57], True),
    ([125.05, 141.77, 15.94, 12.26, 103.57, 4.51, 0.1, 12.35, 27.16, 78.76, 127.7, 172.91, 0.69, 39.75, 10.11, 3.18], False),
])
def test_skew_limit_sums_ties_in_frame_order(spark, values, first):
    """Mean/median of all steps is 1.3 but for rounding; summed from the first step on it is below, or not, as in the SQL."""
    import duckdb

    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i long, v double")
    got = W.skew_limit(df, ["k"], ["i"], "v", 1.3).first()["skew_limit"]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(range(?)) AS i, unnest(?) AS v", [len(values), values])
    want = con.execute("""WITH d AS (SELECT i, abs(lead(v) OVER (ORDER BY i) - v) AS a FROM t),
r AS (SELECT i, avg(a) OVER w / quantile_cont(a, 0.5) OVER w AS r FROM d WHERE a IS NOT NULL WINDOW w AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT coalesce(min(CASE WHEN r < 1.3 AND i < ? - 2 THEN i END), ? - 1) FROM r""", [len(values), len(values)]).fetchone()[0]
    assert got == want
    assert (got == 0) == first
