"""Outlier clipping and trimming of segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galvanite.keyed import Ordered, attach, checked_once, quantiles, with_group
from galvanite.operators.windows import (
    decay_start, gradient, savgol_fraction, settle_limit, signed_steps, skew_limit, trim_voltage,
)
from galvanite.plans.kernels import grubbs_critical
from galvanite.session import cut_lineage


class Moments:
    """Count, mean and sum of squares of the values from each place of a list to its end, built from the end."""

    def __init__(self, values: list[float]):
        self.all = [(0, 0.0, 0.0)]
        for v in reversed(values):
            n, mean, m2 = self.all[-1]
            gap = v - mean
            mean += gap / (n + 1)
            self.all.append((n + 1, mean, m2 + gap * (v - mean)))
        self.all.reverse()

    @staticmethod
    def joined(*parts: tuple[int, float, float]) -> tuple[int, float, float]:
        n, mean, m2 = parts[0]
        for k, other, more in parts[1:]:
            if k:
                gap = other - mean
                n, mean, m2 = n + k, mean + gap * k / (n + k), m2 + more + gap * gap * n * k / (n + k)
        return n, mean, m2


def clip_sequence(
    low: list[tuple[float, int]], high: list[tuple[float, int]], core: tuple[int, float, float], alpha: float, allowed: int
) -> tuple[list[tuple[int, bool]], bool]:
    """Sequential removal of the largest deviation.

    The value farthest from the mean is always the smallest or the largest
    one left, so the two tails and the moments (n, mean, M2) of the rest are
    enough; equal distances go by position. What is left of a tail has its
    moments from the inside, so a removal costs the same whatever came before.
    Returns [(position, was an outlier)] and whether a tail ran out.
    """
    removed: list[tuple[int, bool]] = []
    provisional: set[int] = set()
    calm, limit = 0, float("inf")  # critical values fall with n, so an earlier one is an upper bound
    while True:
        if not core[0]:
            # Nothing but tails: both halves of what is left, split anew whenever one of them is used up.
            left = sorted(low + high)
            low, high = left[: len(left) // 2], sorted(left[len(left) // 2:], key=lambda e: (-e[0], e[1]))
        below, above = Moments([v for v, _ in low]), Moments([v for v, _ in high])
        a = b = 0
        while True:
            n, mean, m2 = Moments.joined(core, below.all[a], above.all[b])
            if n <= 3 or m2 <= 0:
                return removed, False
            if a == len(low) or b == len(high):
                if core[0]:
                    return removed, True
                break
            ends = [(abs(v - mean), -i) for v, i in (low[a], high[b])]
            side = 0 if ends[0] > ends[1] else 1
            pos, score = -ends[side][1], ends[side][0] / np.sqrt(m2 / (n - 1))
            out = score > limit
            if not out:
                limit = grubbs_critical(n, alpha)
                out = score > limit
            if out:
                calm, provisional = 0, set()
            else:
                calm += 1
                if calm >= allowed:
                    return [r for r in removed if r[0] not in provisional], False
                provisional.add(pos)
            removed.append((pos, out))
            a, b = a + (side == 0), b + (side == 1)
        low, high = low[a:], high[b:]


def grubbs_clip(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.05, allowed: int = 2, tail: int = 32
) -> DataFrame:
    """Rows with `_i`, `removed` and `outlier` of the sequential Grubbs test.

    Only the `tail` smallest and largest values of a key leave their tasks
    (a ranked limit is pushed below the shuffle); the others enter as moments.
    Keys whose tails run out are tried again with tails four times as long.
    """
    keys = list(keys)
    pos = Ordered(df, keys, order).positions("_i", "_n")
    v = F.col(value).cast("double")
    base = pos.where(v.isNotNull() & ~F.isnan(v)).select(*keys, "_i", v.alias("_v"))
    types = dict(base.dtypes)
    lead = "".join(f"`{k}` {types[k]}, " for k in keys)

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per key with its tails and the moments of the rest; the keys' columns come first."""
        for batch in batches:
            key, at, outlier, short = [], [], [], []
            for row, (lows, highs, *core) in enumerate(zip(*[c.to_pylist() for c in batch.columns[len(keys):]])):
                lows = sorted((e["_v"], e["_i"]) for e in lows)
                seen = {i for _, i in lows}
                highs = sorted(((e["_v"], e["_i"]) for e in highs if e["_i"] not in seen), key=lambda e: (-e[0], e[1]))
                gone, out_of = clip_sequence(lows, highs, tuple(core), alpha, allowed)
                for i, out in gone or [(-1, False)]:
                    key.append(row)
                    at.append(i)
                    outlier.append(out)
                    short.append(out_of)
            lines = pa.array(key, pa.int64())
            made = [pa.array(at, pa.int64()), pa.array(outlier, pa.bool_()), pa.array(short, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[c.take(lines) for c in batch.columns[:len(keys)]], *made], names=[*keys, "_i", "outlier", "short"])

    todo, found = base, None
    while True:
        up = Window.partitionBy(*keys).orderBy(F.col("_v").asc(), F.col("_i").asc())
        down = Window.partitionBy(*keys).orderBy(F.col("_v").desc(), F.col("_i").asc())
        low = todo.withColumn("_r", F.row_number().over(up)).where(F.col("_r") <= tail)
        high = todo.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= tail)
        lo_end = low.groupBy(*keys).agg(F.max(F.struct("_v", "_i")).alias("_lo"))
        hi_end = high.groupBy(*keys).agg(F.min(F.struct("_v", (-F.col("_i")).alias("_j"))).alias("_hi"))
        cut = attach(attach(todo, lo_end, keys), hi_end, keys)
        in_low = F.struct("_v", "_i") <= F.col("_lo")
        in_high = F.struct("_v", (-F.col("_i")).alias("_j")) >= F.col("_hi")
        core_v = F.when(~in_low & ~in_high, F.col("_v"))
        core = cut.groupBy(*keys).agg(
            F.count(core_v).alias("_cn"), F.coalesce(F.avg(core_v), F.lit(0.0)).alias("_cm"),
            F.coalesce(F.var_pop(core_v) * F.count(core_v), F.lit(0.0)).alias("_cs"),
        )
        ends = low.select(*keys, "_v", "_i", F.lit(True).alias("_side")).unionByName(high.select(*keys, "_v", "_i", F.lit(False).alias("_side")))
        here = lambda side: F.collect_list(F.when(side, F.struct("_v", "_i")))
        ends = attach(ends.groupBy(*keys).agg(here(F.col("_side")).alias("_low"), here(~F.col("_side")).alias("_high")), core, keys)
        got = cut_lineage(ends.select(*keys, "_low", "_high", "_cn", "_cm", "_cs").mapInArrow(clip, lead + "_i long, outlier boolean, short boolean"))
        done = got.where(~F.col("short") & (F.col("_i") >= 0)).select(*keys, "_i", "outlier")
        found = done if found is None else found.unionByName(done)
        rest = got.where("short").select(*keys).distinct()
        if rest.isEmpty():
            break
        todo, tail = attach(todo, rest, keys, "left_semi"), tail * 4
    out = attach(pos, found.withColumn("removed", F.lit(True)), [*keys, "_i"])
    return out.withColumn("removed", F.coalesce("removed", F.lit(False))).withColumn("outlier", F.coalesce("outlier", F.lit(False)))


def gradient_residual(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, fraction: float = 0.05, name: str = "residual") -> DataFrame:
    """Gradient of the raw values minus the gradient of the smoothed ones."""
    rows = gradient(df, keys, order, value, "_g0")
    rows = savgol_fraction(rows, keys, order, value, fraction, 2, name="_s")
    rows = gradient(rows, keys, order, "_s", "_g1")
    return rows.withColumn(name, F.col("_g0") - F.col("_g1")).drop("_g0", "_g1", "_s")


def current_limits(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], current: str, start_region: int = 3, alpha: float = 0.05, allowed: int = 2,
    diff_threshold: float = 0.0, skew_threshold: float = 0.0, outlier_eval: bool = False, trim_to_decay: bool = True,
    use_gradient_residual: bool = False,
) -> DataFrame:
    """Start and stop position of the decaying part: (keys, n, start, stop)."""
    keys = list(keys)
    med = quantiles(df, keys, current, {"_med": 0.5})
    rows = attach(df, med, keys).withColumn("_x", F.try_divide(F.col(current), F.col("_med")))
    if use_gradient_residual:
        rows = gradient_residual(rows, keys, order, "_x", name="_m")
    else:
        rows = rows.withColumn("_m", F.signum("_x") * F.log(F.abs("_x") + 1e-24))
    marked = cut_lineage(grubbs_clip(cut_lineage(rows), keys, order, "_m", alpha, allowed))
    gone = F.col("removed") | (F.col("_i") == 0)
    blocks = Ordered(marked, keys, ["_i"]).frame({"_new": lambda w: (gone & ~F.coalesce(F.lag(gone).over(w), F.lit(False))).cast("long")})
    blocks = Ordered(blocks, keys, ["_i"]).running({"_blk": ("sum", F.col("_new"))}).where(gone)
    per = blocks.groupBy(*keys, "_blk").agg(F.min("_i").alias("_b0"), F.max("_i").alias("_b1"), F.max("_n").alias("_n"))
    last = F.col("_b1") == F.col("_n") - 1
    region = F.floor(F.col("_n") / start_region)
    lim = per.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.coalesce(F.max(F.when(last, F.col("_b0"))), F.max("_n")).alias("stop"),
        F.max(F.when(~last, F.least(F.col("_b1") + 1, region))).alias("_start"),
        (F.count_if(~last) == 1).alias("_single"), F.max(F.when(~last, F.col("_b1"))).alias("_last"),
    )
    bare = F.col("_single") & (F.col("_last") == 0)
    lim = lim.withColumn("_start", F.when(bare, 0).otherwise(F.coalesce("_start", F.lit(0)))).withColumn("_max", F.floor(F.col("n") / start_region))
    lim = cut_lineage(lim)
    dec = decay_start(marked, keys, ["_i"], "_x", within=lim.select(*keys, (F.col("_start") + F.col("_max")).alias("limit")))
    lim = attach(lim, dec, keys)
    if outlier_eval:
        # First position at or after the decay start that is no outlier.
        clean = attach(marked.where(~F.col("outlier")).select(*keys, "_i"), lim.select(*keys, "decay_start"), keys)
        moved = clean.groupBy(*keys).agg(F.min(F.when(F.col("_i") >= F.col("decay_start"), F.col("_i"))).alias("_moved"))
        lim = attach(lim, moved, keys).withColumn("decay_start", F.least(F.coalesce("_moved", "stop"), F.col("stop"))).drop("_moved")
    lim = lim.withColumn("decay_start", F.when(F.col("decay_start") > F.col("_max"), 0).otherwise(F.col("decay_start")))
    lim = lim.withColumn("_maxlim", F.lit(0)).withColumn("_skewlim", F.lit(0))
    if diff_threshold:
        inside = attach(marked, lim.select(*keys, "stop"), keys).where(F.col("_i") <= F.col("stop"))
        got = settle_limit(attach(inside.drop("stop"), med.withColumnRenamed("_med", "_md"), keys), keys, ["_i"], "_x", diff_threshold)
        lim = attach(lim.drop("_maxlim"), got.withColumnRenamed("settle_limit", "_maxlim"), keys)
    if skew_threshold:
        got = skew_limit(marked, keys, ["_i"], "_x", skew_threshold)
        lim = attach(lim.drop("_skewlim"), got.withColumnRenamed("skew_limit", "_skewlim"), keys)
    near = lambda c: F.when(F.col(c) > F.col("_max"), 0).otherwise(F.coalesce(c, F.lit(0)))
    low = F.greatest(F.least("_start", "decay_start"), near("_maxlim"), near("_skewlim"))
    lim = lim.withColumn("start", F.least(F.greatest("_start", "decay_start"), low, F.col("_max")))
    if trim_to_decay:
        steps, _ = signed_steps(marked, keys, ["_i"], "_x")
        steps = attach(steps, lim.select(*keys, "start", "stop"), keys)
        fall = steps.groupBy(*keys).agg(
            F.min(F.when((F.col("_d") < 0) & (F.col("_i") >= F.col("start")) & (F.col("_i") < F.col("stop")), F.col("_i"))).alias("_fall"))
        lim = attach(lim, fall, keys).withColumn("start", F.coalesce("_fall", "start"))
    return lim.select(*keys, "n", F.col("start").cast("long"), F.col("stop").cast("long"))


def trim_current(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], current: str, time: str | None = None, min_length: int = 3,
    with_grubbs: bool = False, threshold: float = 0.25, check_end: bool = True, reset_time: bool = True, **limits,
) -> DataFrame:
    """Keep the decaying part of each segment, at least `min_length` rows.

    Without the Grubbs test only trailing rows that rise by more than the
    threshold (relative to the median) leave.
    """
    keys = list(keys)
    min_length = max(abs(min_length), 1)
    rows = Ordered(df, keys, order).positions("_i", "_n")
    if with_grubbs:
        lim = current_limits(df, keys, order, current, **limits)
        end = F.greatest(F.col("stop"), F.col("start") + min_length) if check_end else F.col("n")
        lim = lim.withColumn("_end", end).withColumn("_begin", F.least("start", F.col("_end") - min_length))
        rows = attach(rows, lim.select(*keys, "_begin", "_end"), keys)
    else:
        med = quantiles(df, keys, current, {"_med": 0.5})
        step = Ordered(attach(rows, med, keys), keys, ["_i"]).frame({"_prev": lambda w: F.lag(current).over(w), "_next": lambda w: F.lead(current).over(w)})
        rise = F.try_divide(F.col(current) - F.col("_prev"), F.col("_med"))
        rise = F.when(F.col("_i") == 0, F.try_divide(F.col("_next") - F.col(current), F.col("_med"))).otherwise(rise)
        calm = F.when(~F.coalesce(rise > threshold, F.lit(False)), F.col("_i"))
        ends = step.groupBy(*keys).agg(F.greatest(F.coalesce(F.max(calm) + 1, F.lit(0)), F.lit(min_length)).alias("_end"))
        rows = attach(rows, ends, keys).withColumn("_begin", F.lit(0))
    whole = F.col("_n") < 2 + min_length
    kept = rows.where(whole | ((F.col("_i") >= F.col("_begin")) & (F.col("_i") < F.col("_end"))))
    if reset_time and time:
        kept = with_group(kept, keys, F.min_by(time, "_i").alias("_t0"))
        kept = kept.withColumn(time, F.when(whole, F.col(time)).otherwise(F.col(time) - F.col("_t0")))
    return kept.select(*df.columns)


def clean_segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], voltage: str, current: str, time: str, stable_voltage: bool = False,
    check_start: bool = False, check_end: bool = True, shift_start: int = 0, shift_end: int = 0, min_length: int = 3, threshold: float = 0.25,
    reset: str = "voltage", **limits,
) -> DataFrame:
    """Voltage trim, then current trim, by flags."""
    out = df
    with checked_once(df, keys):
        if stable_voltage or shift_start or shift_end:
            out = cut_lineage(trim_voltage(out, keys, order, voltage, time, min_length, shift_start, shift_end, threshold, reset_time=True))
        if check_start or check_end:
            out = trim_current(out, keys, order, current, time, min_length, check_start, threshold, check_end, reset_time="volt" not in reset, **limits)
    return out


def drop_unstable(df: DataFrame, keys: Sequence[str], rows: int = 4) -> DataFrame:
    """Segments with at least `rows` rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= rows)
    return attach(df, sizes.select(*keys), list(keys), "left_semi")
