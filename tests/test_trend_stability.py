"""Resistance trend and stability rule against plain re-implementations."""

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from galvanite.operators import channels as C
from galvanite.streaming import devices as X

COLUMNS = "id long, sample_name string, condition string, temp double, resistance double, voltage double, multiplier double"


def trend_by_hand(rows):
    """Rows (id, sample, condition, temp, R, V, factor) -> id: (factor exponent, R), group by group."""
    ok = lambda r: r is not None
    m = {r[0]: math.log10(r[6]) for r in rows if r[6] is not None}
    open_ = [r for r in rows if r[6] is not None and r[6] != 1]
    into = lambda e: -10 - min(e) if min(e) < -10 else -8 - max(e) if max(e) > -8 else 0.0
    start = dict(m)
    for s, c in sorted({(r[1], r[2]) for r in open_}):
        group = [r for r in open_ if r[1:3] == (s, c)]
        if not any(ok(r[4]) for r in group):
            continue
        for pol in (-1, 1):
            part = [r for r in group if math.copysign(1, r[5] or 0) * bool(r[5]) == pol]
            if not part:
                continue
            before = None
            for t in sorted({r[3] for r in part if r[3] is not None}):
                here = [r for r in part if r[3] == t]
                vals = {r[0]: r[4] for r in here if ok(r[4])}
                if before is None:
                    before = [10 * v for v in vals.values()]
                if vals and before and max(vals.values()) >= min(before):
                    mean = statistics.fmean(before)
                    for i, v in list(vals.items()):
                        if v >= mean:
                            m[i] += math.ceil(math.log10(v / (mean * 0.99)))
                            vals[i] = v / 10 ** (m[i] - start[i])
                before = list(vals.values())
            fix = into([m[r[0]] for r in group])
            for r in group:
                m[r[0]] += fix
    now = {r[0]: r[4] / 10 ** (m[r[0]] - start[r[0]]) if ok(r[4]) and r[6] is not None else r[4] for r in rows}
    for s in sorted({r[1] for r in rows}):
        need = 0
        for t in {r[3] for r in open_ if r[1] == s and r[2] == "dh" and r[3] is not None}:
            dh = [now[r[0]] for r in open_ if r[1:4] == (s, "dh", t) and ok(now[r[0]])]
            rest = [now[r[0]] for r in rows if r[1] == s and r[2] in ("pre", "dry") and r[3] == t and ok(now[r[0]])]
            if dh and rest and statistics.fmean(dh) >= statistics.fmean(rest):
                need = max(need, math.ceil(math.log10(statistics.fmean(dh) / (statistics.fmean(rest) * 0.99))))
        if need:
            for r in open_:
                m[r[0]] += need * (r[1:3] == (s, "dh"))
            fix = into([m[r[0]] for r in open_ if r[1] == s])
            for r in open_:
                m[r[0]] += fix * (r[1] == s)
    return {r[0]: (None if r[6] is None else round(m[r[0]]), None if r[4] is None else r[4] / 10 ** ((m[r[0]] - start[r[0]]) if r[6] is not None else 0)) for r in rows}


def check_trend(spark, rows):
    got = {r["id"]: (None if r["multiplier"] is None else round(math.log10(r["multiplier"])), r["resistance"]) for r in C.enforce_trend(spark.createDataFrame(rows, COLUMNS)).collect()}
    want = trend_by_hand(rows)
    assert got.keys() == want.keys()
    for i, (e, r) in want.items():
        assert got[i][0] == e and (got[i][1] == r if r is None else got[i][1] == pytest.approx(r, rel=1e-9)), (i, got[i], want[i])


def test_trend_of_groups_that_start_late(spark):
    """Every group is compared with its own first temperature."""
    rng = random.Random(4)
    rows = []
    for k, (s, c) in enumerate([(s, c) for s in "ab" for c in ("pre", "dry", "dh")]):
        for t in range(40 + 7 * k, 120, 5):
            for _ in range(rng.randint(1, 4)):
                r = 10 ** (9 - t / 20 + rng.choice([-1, 0, 0, 0, 1, 2, 3]) + rng.random())
                rows.append((len(rows), s, c, float(t), rng.choice([r, r, r, r, None]), rng.choice([2.0, -2.0, 3.0, 0.0, None]), rng.choice([1e-9, 1e-9, 1e-8, 1e-10, 1.0, None])))
    check_trend(spark, rows)


def test_trend_of_a_thousand_temperatures(spark):
    rng = random.Random(5)
    check_trend(spark, [(i, "s", "pre", i / 2, 1e9 * 0.98**i * rng.choice([1, 1, 1, 100]), 2.0, 1e-9) for i in range(1000)])


def test_trend_odd_tables(spark):
    gap = [(0, "s", "pre", 1.0, 5.0, 2.0, 1e-9), (1, "s", "pre", 2.0, None, 2.0, 1e-9), (2, "s", "pre", 3.0, 500.0, 2.0, 1e-9), (3, "n", "pre", None, 5.0, 2.0, 1e-9), (4, "e", "dh", 1.0, None, -2.0, 1e-6)]
    check_trend(spark, gap)
    check_trend(spark, gap[:2] + [(9, "s", "pre", 2.0, 50.0, 2.0, 1e-9)] * 1)
    assert C.enforce_trend(spark.createDataFrame([], COLUMNS)).count() == 0


# stability


def by_hand(readings, tol, hold, allowance, floor):
    """The rule on one list of (seconds, value): keeps the values of the wait."""
    out, temps, since, began, step = [], [], None, None, 0
    for now, value in readings:
        if since is None:
            temps, since, began = [value], now, now
        elif floor is None or value >= floor:
            temps.append(value)
        spread = max(temps) - min(temps)
        if spread > tol:
            if now - began > allowance:
                tol = min(spread, 2 * tol)
            temps, since = temps[-1:], now
        stable = now - since >= hold
        out.append((now - since, spread, tol, step, stable))
        if stable:
            temps, since, began, step = [value], now, now, step + 1
    return out


def walk(n, seed=1):
    rng = random.Random(seed)
    value, out = 20.0, []
    for i in range(n):
        value += rng.choice([0, 0, 0.1, -0.1, 0.3, 3, -2]) if i % 90 < 50 else 0.01 * rng.random()
        out.append((i * 10.0 + rng.random(), value))
    return out


@pytest.mark.parametrize("allowance,floor", [(math.inf, None), (120.0, None), (120.0, 21.0), (0.0, 1e9)])
def test_rule_by_hand(allowance, floor):
    readings = walk(600)
    rule = X.StabilityRule(0.5, 60.0, allowance, floor)
    state, got = rule.start(), []
    for now, value in readings:
        state, verdict = rule.add(state, now, value)
        got.append(verdict)
    want = by_hand(readings, 0.5, 60.0, allowance, floor)
    assert got == want and any(v[-1] for v in got)
    assert floor is not None or allowance == math.inf or max(v[2] for v in got) > 0.5


def test_tolerance_grows_only_when_the_range_exceeds_it():
    rule = X.StabilityRule(1.0, 1000.0, 20.0)
    state, tols = rule.start(), []
    for now, value in [(0, 0.0), (50, 0.5), (90, 0.9), (100, 2.2), (110, 2.3), (120, 99.0)]:
        state, verdict = rule.add(state, float(now), value)
        tols.append(verdict[2])
    assert tols == [1.0, 1.0, 1.0, 2.0, 2.0, 4.0]
    state, verdict = X.StabilityRule(1.0, 1000.0, 20.0).add((0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0, 0.0, 0), 30.0, 1.5)
    assert verdict[2] == 1.5  # not beyond the range
    assert X.StabilityRule(1.0, 1000.0, target=20.0).add((0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0, 0.0, 0), 1.0, 20.2)[1][-1]


def readings(spark, n=200):
    rows = [(d, datetime(2024, 1, 1) + timedelta(milliseconds=int(s * 1000)), float(v)) for k, d in enumerate("ab") for s, v in walk(n, k)]
    rows += [("a", None, 1.0), ("a", datetime(2024, 1, 1, 0, 0, 5), None), ("b", datetime(2024, 1, 1, 0, 0, 7), float("nan"))]
    return spark.createDataFrame(rows, "device string, ts timestamp, value double")


def test_batch_by_hand(spark):
    df = readings(spark)
    got = X.stability_batch(df, ["device"], ["ts"], "ts", "value", 0.5, 60.0, 120.0).collect()
    for k, d in enumerate("ab"):
        mine = sorted((r["ts"], r["elapsed"], r["spread"], r["tol"], r["step"], r["stable"]) for r in got if r["device"] == d)
        want = by_hand([(int(s * 1000) / 1000, v) for s, v in walk(200, k)], 0.5, 60.0, 120.0, None)
        assert len(mine) == 200
        for m, w in zip(mine, want):
            assert m[1:4] == pytest.approx(w[:3], abs=1e-6) and m[4:] == w[3:]


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_stream_equals_batch_up_to_the_watermark(spark, tmp_path, state_store):
    """Five files out of order: late readings take their place, those behind the watermark are counted."""
    df = readings(spark).where("value IS NOT NULL AND ts IS NOT NULL AND NOT isnan(value)")
    secs = F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    # Every 7th reading of a file arrives with the next one; one reading of hour 0 comes at the very end.
    part = F.floor(secs / 400) + F.when((F.floor(secs / 10) % 7 == 3), 1).otherwise(0)
    for k in range(7):
        some = df.where(part == k)
        if k == 6:
            some = some.union(df.orderBy("ts").limit(1))
        some.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    out = X.stability_stream(stream, "device", "ts", "value", 0.5, 60.0, 120.0, late="15 minutes")
    q = out.writeStream.format("memory").queryName("stable_rule").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = sorted(map(tuple, spark.table("stable_rule").select("device", "ts", "elapsed", "spread", "tol", "step", "stable").collect()))
    want = sorted(map(tuple, X.stability_batch(df, ["device"], ["ts"], "ts", "value", 0.5, 60.0, 120.0).select("device", "ts", "elapsed", "spread", "tol", "step", "stable").collect()))
    last = max(g[1] for g in got)
    want = [w for w in want if w[1] <= last]
    assert len(got) >= 150 and len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[2:5] == pytest.approx(w[2:5], abs=1e-5) and g[5:] == w[5:]
    counted = max((r["late"] for r in spark.table("stable_rule").collect()), default=0)
    assert X.late_rows(q) + counted >= 1
