"""Device readings as streams, with batch twins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from galvanite.keyed import Ordered, attach, fold_sorted


def within_limits(readings: DataFrame, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Leave out readings below or above the limits (and missing ones)."""
    cond = F.col(value).isNotNull()
    if low is not None:
        cond = cond & (F.col(value) >= low)
    if high is not None:
        cond = cond & (F.col(value) <= high)
    return readings.where(cond)


def rounds_within_limits(readings: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """Leave out whole polling rounds in which any reading is off limits."""
    bad = readings.where(~F.coalesce(F.col(value).between(low, high), F.lit(False))).select(*keys).distinct()
    return attach(readings, bad, list(keys), "left_anti")


def log_stream(stream: DataFrame, path: str, checkpoint: str, value: str = "value", low: float | None = None, high: float | None = None,
               trigger: dict | None = None):
    """Append accepted readings to files; restarts continue from the checkpoint."""
    out = within_limits(stream, value, low, high)
    return out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start(path)


def combine_signals(readings: DataFrame, keys: Sequence[str], ts: str, signal: str, value: str, inputs: Sequence[str], width: str = "1 minute",
                    how: str = "mean", late: str | None = None) -> DataFrame:
    """A derived signal per window from named ones (mean, min, max, sum).

    On a stream `late` sets the watermark; in batch the same plan runs over
    all rows.
    """
    rows = readings.where(F.col(signal).isin(*inputs))
    if late and readings.isStreaming:
        rows = rows.withWatermark(ts, late)
    fn = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[how]
    got = rows.groupBy(*keys, F.window(ts, width)).agg(
        fn(value).alias("value"), F.count(F.lit(1)).alias("readings"),
        *[F.avg(F.when(F.col(signal) == s, F.col(value))).alias(f"{s}_mean") for s in inputs],
    )
    return got.select(*keys, F.col("window.start").alias("start"), "value", "readings", *[f"{s}_mean" for s in inputs])


STABLE_SCHEMA = "device string, ts timestamp, value double, elapsed double, spread double, tol double, step long, stable boolean, late long"


class StabilityRule:
    """Waits, step after step, until a signal has kept within a tolerance for a time.

    Every reading is a check. The range counts from the reading at which the
    wait began (always in it) over those at or above `floor`. If the range
    exceeds the tolerance, the wait begins anew with the last counted reading;
    when the step has lasted longer than `allowance` seconds by then, the
    tolerance also grows, to twice its size but not beyond the range. After
    `hold` seconds of wait the reading is stable: the step is done and the
    next one begins with this reading, with the tolerance as it is. A reading
    within `near` of `target` is stable at once.
    """

    FIELDS = "since double, low double, high double, kept double, tol double, began double, step long, last double, late long"

    def __init__(self, tol: float, hold: float, allowance: float = float("inf"), floor: float | None = None, target: float | None = None, near: float = 0.5):
        self.tol, self.hold, self.allowance, self.floor, self.target, self.near = tol, hold, allowance, floor, target, near

    def start(self) -> tuple:
        return (None, None, None, None, self.tol, None, 0, None, 0)

    def add(self, state: tuple, now: float, value: float) -> tuple[tuple, tuple]:
        """New state, and (elapsed, spread, tol, step, stable) of the reading."""
        since, low, high, kept, tol, began, step, _, late = state
        if since is None:
            since, low, high, kept, began = now, value, value, value, now
        elif self.floor is None or value >= self.floor:
            low, high, kept = min(low, value), max(high, value), value
        spread = high - low
        if spread > tol:
            if now - began > self.allowance:
                tol = min(spread, 2 * tol)
            since, low, high = now, kept, kept
        elapsed, at = now - since, step
        stable = elapsed >= self.hold or (self.target is not None and abs(value - self.target) < self.near)
        if stable:
            since, low, high, kept, began, step = now, value, value, value, now, step + 1
        return (since, low, high, kept, tol, began, step, now, late), (elapsed, spread, tol, at, stable)


class StabilityProcessor(StatefulProcessor):
    """The stability rule per device in event time.

    Readings wait in the state until the watermark has passed them, so those
    that come late, but within the watermark's delay, take their place in
    time; readings of one time go by value. A timer wakes the device when its
    earliest waiting reading is due. Readings older than what was worked on
    are counted in `late`; those that the engine drops before are in the
    progress of the query (`late_rows`).
    """

    def __init__(self, rule: StabilityRule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rule", StabilityRule.FIELDS)
        self.waiting = handle.getListState("waiting", "micros long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else self.rule.start()
        done, late, first = state[7], 0, None
        for part in rows:
            micros = part["ts"].astype("datetime64[us]").astype("int64")
            for us, value in zip(micros.tolist(), part["value"].tolist()):
                if done is not None and us / 1e6 < done:
                    late += 1
                    continue
                self.waiting.appendValue((us, value))
                first = us if first is None else min(first, us)
        self.state.update((*state[:8], state[8] + late))
        if first is not None:
            self.wake(first)
        yield pd.DataFrame(columns=[c.split(" ")[0] for c in STABLE_SCHEMA.split(", ")])

    def wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] < mark]
        state = tuple(self.state.get()) if self.state.exists() else self.rule.start()
        out = []
        for us, value in due:
            state, verdict = self.rule.add(state, us / 1e6, value)
            out.append((str(key[0]), pd.Timestamp(us, unit="us"), value, *verdict, state[8]))
        if due:
            self.state.update(state)
            rest = rows[len(due):]
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
                self.wake(rest[0][0])
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in STABLE_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def stability_stream(stream: DataFrame, device: str, ts: str, value: str, tol: float, hold: float, allowance: float = float("inf"), floor: float | None = None,
                     target: float | None = None, near: float = 0.5, late: str = "1 minute") -> DataFrame:
    """Verdict of the stability rule per reading, keyed by device; readings may be late by `late`. Missing values and times are left out."""
    rows = stream.select(F.col(device).cast("string").alias("device"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    rows = rows.where(F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")).withWatermark("ts", late)
    return rows.groupBy("device").transformWithStateInPandas(
        statefulProcessor=StabilityProcessor(StabilityRule(tol, hold, allowance, floor, target, near)), outputStructType=STABLE_SCHEMA, outputMode="Append", timeMode="EventTime")


def late_rows(query) -> int:
    """Readings that the engine has dropped as older than the watermark, over the progress that the query keeps."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


class RuleWalker:
    """The stability rule over the rows (keys, order, seconds, value) of one key."""

    def __init__(self, rule: StabilityRule):
        self.rule, self.state = rule, rule.start()

    def add(self, row: tuple) -> list[tuple]:
        self.state, verdict = self.rule.add(self.state, row[-2], row[-1])
        return [(*row[:-2], row[-1], *verdict)]

    def end(self) -> list[tuple]:
        return []


def stability_batch(readings: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, value: str, tol: float, hold: float, allowance: float = float("inf"),
                    floor: float | None = None, target: float | None = None, near: float = 0.5) -> DataFrame:
    """Batch twin of `stability_stream`: keys, order, value, elapsed, spread, tol, step, stable per reading.

    The rule depends on every reading before, so each key is one ordered pass
    in constant memory.
    """
    keys, order = list(keys), list(order)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = readings.where(F.col(ts).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = rows.select(*keys, *order, seconds.alias("_s"), F.col(value).cast("double").alias("_v"))
    rule = StabilityRule(tol, hold, allowance, floor, target, near)
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name not in ("_s", "_v")]
    shape = ", ".join(f"`{n}` {k}" for n, k in kinds) + f", `{value}` double, elapsed double, spread double, tol double, step long, stable boolean"
    return fold_sorted(rows, keys, order, lambda key: RuleWalker(rule), shape)


def calm_stretches(readings: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, value: str, tol: float, hold: float) -> DataFrame:
    """Batch view: stretches whose steps stay within tol, and their verdict.

    A stretch ends where a reading leaves the one before by more than tol; it
    is stable when it lasts at least `hold` seconds and its range is within
    tol.
    """
    rows = Ordered(readings, keys, order)
    step = rows.frame({"_prev": lambda w: F.lag(value).over(w)})
    brk = F.coalesce(F.abs(F.col(value) - F.col("_prev")) > tol, F.lit(False)).cast("long")
    runs = Ordered(step.withColumn("_new", brk), keys, order, split=rows.split).running({"stretch": ("sum", F.col("_new"))})
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    out = runs.groupBy(*keys, "stretch").agg(
        F.count(F.lit(1)).alias("readings"), ((F.max(us) - F.min(us)) / 1e6).alias("seconds"), (F.max(value) - F.min(value)).alias("range"),
    )
    return out.withColumn("stable", (F.col("seconds") >= hold) & (F.col("range") <= tol))
