"""Ordered-sequence operators; all rest on `Ordered`, so keys may be large."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galvanite.keyed import Ordered, attach, fold_sorted, has_hot_group, quantiles, with_group
from galvanite.session import cut_lineage


def gradient(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "gradient") -> DataFrame:
    """Central difference, one-sided at the edges (unit spacing)."""
    v = F.col(value)

    def grad(w):
        ahead, back = F.lead(v).over(w), F.lag(v).over(w)
        return F.when(back.isNull(), ahead - v).when(ahead.isNull(), v - back).otherwise((ahead - back) / 2)

    return Ordered(df, keys, order).frame({name: grad})


def gradient_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, x: str, name: str = "gradient"
) -> DataFrame:
    """Second-order gradient on uneven spacing, one-sided at the edges."""
    v, t = F.col(value), F.col(x)
    rows = Ordered(df, keys, order).frame(
        {
            "_va": lambda w: F.lead(v).over(w),
            "_vb": lambda w: F.lag(v).over(w),
            "_ta": lambda w: F.lead(t).over(w),
            "_tb": lambda w: F.lag(t).over(w),
        }
    )
    hs, hd = t - F.col("_tb"), F.col("_ta") - t
    inner = F.try_divide(
        hs * hs * F.col("_va") + (hd * hd - hs * hs) * v - hd * hd * F.col("_vb"), hs * hd * (hd + hs)
    )
    g = (
        F.when(F.col("_tb").isNull(), F.try_divide(F.col("_va") - v, hd))
        .when(F.col("_ta").isNull(), F.try_divide(v - F.col("_vb"), hs))
        .otherwise(inner)
    )
    return rows.withColumn(name, g).drop("_va", "_vb", "_ta", "_tb")


def moving_average(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int, logscale: bool = False,
    name: str = "moving_average",
) -> DataFrame:
    """Width-w mean with the length kept.

    With a = (w-1)//2 rows before and b = w//2 rows after, the first a rows
    average the first 2, 4, ... values and the last b rows the last ..., 3, 1.
    """
    v = F.col(value).cast("double")
    if logscale:
        v = F.log10(F.when(v > 0, v).otherwise(1e-30))
    front, back = (width - 1) // 2, width // 2
    rows = Ordered(df, keys, order)
    seq = Ordered(rows.positions("_i", "_n"), keys, ["_i"], split=rows.split)

    def mean(w):
        got = F.avg(v).over(w.rowsBetween(-front, back))
        for k in range(front):
            got = F.when(F.col("_i") == k, F.avg(v).over(w.rowsBetween(-k, k + 1))).otherwise(got)
        for k in range(back):
            got = F.when(F.col("_n") - 1 - F.col("_i") == k, F.avg(v).over(w.rowsBetween(-k, k))).otherwise(got)
        return F.pow(F.lit(10.0), got) if logscale else got

    return seq.frame({name: mean}, halo=width).drop("_i", "_n")


def savgol_coefficients(window: int, degree: int, deriv: int = 0, delta: float = 1.0, at: int | None = None) -> list[float]:
    """Weights of a least-squares polynomial over `window` points, read at one."""
    pos = window // 2 if at is None else at
    x = np.arange(window, dtype=float) - pos
    basis = np.vander(x, degree + 1, increasing=True)
    if deriv > degree:
        return [0.0] * window
    fact = float(np.prod(np.arange(1, deriv + 1))) if deriv else 1.0
    return list(np.linalg.pinv(basis)[deriv] * fact / delta**deriv)


def savgol(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int, degree: int = 2,
    deriv: int = 0, delta: float = 1.0, name: str = "smooth",
) -> DataFrame:
    """Savitzky-Golay filter of a fixed odd window with polynomial edges.

    Inner rows combine `window` neighbours by fixed weights; the first and
    last window/2 rows read the polynomial of the first/last full window.
    Keys with fewer rows than the window, or with a null, keep their values.
    """
    if window % 2 == 0:
        window += 1
    half = window // 2
    v = F.col(value).cast("double")
    rows = Ordered(df, keys, order)
    pos = rows.positions("_i", "_n")
    bad = with_group(pos, keys, F.count_if(v.isNull()).alias("_nulls"))
    seq = Ordered(bad, keys, ["_i"], split=rows.split)

    def dot(coef: list[float], shift: int):
        def make(w):
            parts = [
                F.lit(float(c)) * (F.lag(v, -(shift + k)).over(w) if shift + k < 0 else F.lead(v, shift + k).over(w))
                for k, c in enumerate(coef)
            ]
            return reduce(lambda a, b: a + b, parts)

        return make

    cols = {"_mid": dot(savgol_coefficients(window, degree, deriv, delta), -half)}
    for k in range(half):
        cols[f"_head{k}"] = dot(savgol_coefficients(window, degree, deriv, delta, k), -k)
        cols[f"_tail{k}"] = dot(savgol_coefficients(window, degree, deriv, delta, window - 1 - k), -(window - 1 - k))
    got = seq.frame(cols, halo=window)
    out = F.col("_mid")
    for k in range(half):
        out = F.when(F.col("_i") == k, F.col(f"_head{k}")).when(
            F.col("_i") == F.col("_n") - 1 - k, F.col(f"_tail{k}")
        ).otherwise(out)
    usable = (F.col("_n") > window) & (F.col("_nulls") == 0) & F.lit(window > degree)
    keep = v if deriv == 0 else F.lit(None).cast("double")
    return got.withColumn(name, F.when(usable, out).otherwise(keep)).select(*df.columns, name)


def savgol_window(n: Column, fraction: float, degree: int) -> Column:
    """Odd window for a segment of n rows when it is given as a fraction."""
    wl = F.greatest(F.floor(n * fraction), F.lit(degree + 1))
    wl = F.when(wl > n, F.lit(degree + 1)).otherwise(wl)
    return (wl + F.when(wl % 2 == 0, 1).otherwise(0)).cast("int")


def savgol_fraction(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, fraction: float = 0.05, degree: int = 2,
    deriv: int = 0, name: str = "smooth",
) -> DataFrame:
    """Savitzky-Golay whose window is a fraction of each segment's length.

    Centred least squares over the window is written with running power sums:
    the polynomial of every position follows from the sums of v, v*i, v*i^2
    over its window, so any window width costs the same. Degree at most 2.
    """
    if degree > 2:
        raise ValueError("running-sum smoothing covers degrees 0 to 2; use savgol for a fixed window")
    v = F.col(value).cast("double")
    rows = Ordered(df, keys, order)
    pos = rows.positions("_i", "_n").withColumn("_wl", savgol_window(F.col("_n"), fraction, degree))
    pos = with_group(pos, keys, F.count_if(v.isNull()).alias("_nulls"), F.avg(v).alias("_level"))
    half = F.floor(F.col("_wl") / 2)
    centre = F.least(F.greatest(F.col("_i"), half), F.col("_n") - 1 - half)
    dev = v - F.col("_level")
    i = F.col("_i").cast("double")
    cum = Ordered(pos, keys, ["_i"], split=rows.split).running(
        {"_s0": ("sum", dev), "_s1": ("sum", dev * i), "_s2": ("sum", dev * i * i)}
    )
    # Sums up to a window edge are read by an equi join on the position.
    edges = cum.select(*keys, F.col("_i").alias("_e"), "_s0", "_s1", "_s2")
    want = cum.select(*df.columns, "_i", "_n", "_wl", "_nulls", "_level", centre.alias("_c"), half.alias("_h"))
    hi = edges.select(*keys, "_e", *[F.col(f"_s{k}").alias(f"_u{k}") for k in range(3)])
    lo = edges.select(*keys, "_e", *[F.col(f"_s{k}").alias(f"_d{k}") for k in range(3)])
    got = attach(want.withColumn("_e", F.col("_c") + F.col("_h")), hi, [*keys, "_e"])
    got = attach(got.withColumn("_e", F.col("_c") - F.col("_h") - 1), lo, [*keys, "_e"])
    t = [F.col(f"_u{k}") - F.coalesce(f"_d{k}", F.lit(0.0)) for k in range(3)]
    c, h = F.col("_c").cast("double"), F.col("_h").cast("double")
    # Moments about the centre of the window.
    m0 = t[0]
    m1 = t[1] - c * t[0]
    m2 = t[2] - 2 * c * t[1] + c * c * t[0]
    n = 2 * h + 1
    x2 = h * (h + 1) * (2 * h + 1) / 3
    x4 = x2 * (3 * h * h + 3 * h - 1) / 5
    slope = F.try_divide(m1, x2) if degree >= 1 else F.lit(0.0)
    if degree == 2:
        det = n * x4 - x2 * x2
        a0, a2 = F.try_divide(x4 * m0 - x2 * m2, det), F.try_divide(n * m2 - x2 * m0, det)
    else:
        a0, a2 = m0 / n, F.lit(0.0)
    x = i - c
    res = {0: a0 + slope * x + a2 * x * x + F.col("_level"), 1: slope + 2 * a2 * x, 2: 2 * a2 + x * 0}[deriv]
    usable = (F.col("_nulls") == 0) & (F.col("_n") > F.col("_wl")) & (F.col("_wl") > degree)
    keep = v if deriv == 0 else F.lit(None).cast("double")
    return got.withColumn(name, F.when(usable, res).otherwise(keep)).select(*df.columns, name)


def signed_steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> tuple[DataFrame, bool]:
    """Step to the next row (`_d`) and position (`_i`), sign set by majority."""
    rows = Ordered(df, keys, order)
    pos = with_group(rows.positions("_i", "_n"), keys, F.avg((F.col(value) > 0).cast("int")).alias("_share"))
    seq = Ordered(pos, keys, ["_i"], split=rows.split)
    step = seq.frame({"_next": lambda w: F.lead(value).over(w)})
    sign = F.when(F.col("_share") > 0.5, 1.0).otherwise(-1.0)
    return step.withColumn("_d", (F.col("_next") - F.col(value)) * sign).drop("_next", "_share"), rows.split


def decay_start(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, strict: bool = True, within: DataFrame | None = None
) -> DataFrame:
    """Start of the longest run of falling values.

    One run or none gives 0. When the first run is the longest, the last run
    of the same length is taken. `within` (keys, limit) cuts the steps looked
    at to positions below the limit.
    """
    steps, split = signed_steps(df, keys, order, value)
    if within is not None:
        steps = attach(steps, within.select(*keys, F.col("limit").alias("_lim")), keys)
        steps = steps.withColumn("_d", F.when(F.col("_i") < F.col("_lim"), F.col("_d"))).drop("_lim")
    falls = F.coalesce(F.col("_d") < 0 if strict else F.col("_d") <= 0, F.lit(False))
    steps = steps.withColumn("_f", falls)
    seq = Ordered(steps, keys, ["_i"], split=split)
    run = seq.frame({"_new": lambda w: (F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))).cast("long")})
    run = Ordered(run, keys, ["_i"], split=split).running({"_run": ("sum", F.col("_new"))})
    runs = run.where("_f").groupBy(*keys, "_run").agg(F.min("_i").alias("_s"), F.count(F.lit(1)).alias("_len"))
    pick = with_group(
        runs, keys,
        F.max("_len").alias("_top"),
        F.count(F.lit(1)).alias("_runs"),
        F.min_by("_len", "_s").alias("_first_len"),
    )
    longest = F.col("_len") == F.col("_top")
    got = pick.groupBy(*keys).agg(
        F.when(F.max("_runs") <= 1, 0)
        .when(F.max("_first_len") == F.max("_top"), F.max(F.when(longest, F.col("_s"))))
        .otherwise(F.min(F.when(longest, F.col("_s"))))
        .alias("decay_start")
    )
    out = attach(df.select(*keys).distinct(), got, keys)
    return out.withColumn("decay_start", F.coalesce("decay_start", F.lit(0)).cast("long"))


def first_fall(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, absolute: bool = True) -> DataFrame:
    """First index with a falling (absolute) value, else 0."""
    v = F.abs(F.col(value)) if absolute else F.col(value)
    rows = Ordered(df, keys, order)
    seq = Ordered(rows.positions("_i"), keys, ["_i"], split=rows.split)
    got = seq.frame({"_fall": lambda w: F.lead(v).over(w) < v})
    return got.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_fall"), F.col("_i"))), F.lit(0)).cast("long").alias("first_fall"))


def settle_limit(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, threshold: float) -> DataFrame:
    """First index from which all |steps| stay below the threshold.

    That is the position after the last step that reaches it, so an
    aggregate does it; the number of steps when none qualifies.
    """
    steps, _ = signed_steps(df, keys, order, value)
    big = F.max(F.when(F.abs("_d") >= threshold, F.col("_i")))
    return steps.groupBy(*keys).agg(
        F.when(F.max("_n") < 3, 0).otherwise(F.coalesce(big + 1, F.lit(0))).cast("long").alias("settle_limit")
    )


def skew_limit(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, threshold: float) -> DataFrame:
    """First index where mean/median of the remaining |steps| is below the threshold.

    A key within the group limit is walked from its end with the halves of
    what has passed in two heaps. In larger ones the medians of all suffixes
    are found together, one bit of their rank at a time (`suffix_medians`).
    """
    keys = list(keys)
    steps, split = signed_steps(df, keys, order, value)
    steps = steps.where(F.col("_d").isNotNull()).select(*keys, "_i", "_n", F.abs("_d").alias("_a"))
    if not split:
        kinds = dict(steps.dtypes)
        shape = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "skew_limit long"
        back = steps.select(*keys, (-F.col("_i")).alias("_back"), "_n", F.col("_a").cast("double").alias("_a"))
        out = fold_sorted(back, keys, ["_back"], lambda key: SkewWalker(key, threshold), shape)
    else:
        means = Ordered(steps, keys, ["_i"], split=True).running({"_s": ("sum", F.col("_a")), "_c": ("sum", F.lit(1))}, reverse=True)
        got = attach(means, suffix_medians(steps, keys, "_i", "_a"), [*keys, "_i"])
        low = F.try_divide(F.col("_s") / F.col("_c"), F.col("median")) < threshold
        out = got.groupBy(*keys).agg(F.coalesce(F.min(F.when(low & (F.col("_i") < F.col("_n") - 2), F.col("_i"))), F.max("_n") - 1).cast("long").alias("skew_limit"))
    return attach(df.select(*keys).distinct(), out, keys).withColumn("skew_limit", F.coalesce("skew_limit", F.lit(0)).cast("long"))


class SkewWalker:
    """Steps of one key from the last to the first: the smaller half in a heap of negatives, the larger half in another.

    Where mean/median meets the threshold but for rounding, the steps are
    summed again from the first to the last, the order of a window frame.
    """

    def __init__(self, key: tuple, threshold: float):
        self.key, self.threshold, self.small, self.large, self.total, self.n, self.hit, self.last = key, threshold, [], [], 0.0, 0, None, 0
        self.steps = array("d")

    def add(self, row: tuple) -> list[tuple]:
        back, size, step = row[-3:]
        heapq.heappush(self.large, -heapq.heappushpop(self.small, -step))
        if len(self.large) > len(self.small):
            heapq.heappush(self.small, -heapq.heappop(self.large))
        self.total, self.n, self.last = self.total + step, self.n + 1, size
        self.steps.append(step)
        median = -self.small[0] if self.n % 2 else (self.large[0] - self.small[0]) / 2
        if median and -back < size - 2:
            total = self.total
            if abs(total / self.n / median - self.threshold) <= 1e-15 * self.n * abs(self.threshold):
                total = reduce(add, reversed(self.steps), 0.0)
            if total / self.n / median < self.threshold:
                self.hit = -back
        return []

    def end(self) -> list[tuple]:
        return [(*self.key, self.last - 1 if self.hit is None else self.hit)]


def suffix_medians(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Median of the values from each row to the end of its key: (keys, order, median).

    Values get ranks 0, 1, ... per key. All medians are searched together,
    from the highest bit of their rank to the lowest: among the values that
    share the bits found so far, a running count from the end says how many
    of a suffix continue with a zero; the search goes on there or behind
    them. Every bit is one ordered pass over blocks, so keys of any size
    work, in n log n steps.
    """
    keys = list(keys)
    ranked = Ordered(df.select(*keys, F.col(order).alias("_o"), F.col(value).alias("_v")), keys, ["_v", "_o"]).positions("_rank")
    rows = cut_lineage(ranked)
    most = rows.agg(F.max("_rank")).first()[0]
    bits = max(1, int(most or 0).bit_length())
    size = Ordered(rows, keys, ["_o"]).running({"_m": ("sum", F.lit(1).cast("long"))}, reverse=True)
    # One search for each of the two middle places of a suffix, as 0-based places among its values.
    asked = size.select(*keys, "_o", F.posexplode(F.array(F.floor((F.col("_m") - 1) / 2), F.floor(F.col("_m") / 2))).alias("_which", "_k")).withColumn("_node", F.lit(0).cast("long"))
    for bit in range(bits - 1, -1, -1):
        zero = F.when(F.shiftright("_rank", bit).bitwiseAND(F.lit(1)) == 0, 1).otherwise(0).cast("long")
        there = rows.select(*keys, F.shiftright("_rank", bit + 1).alias("_node"), "_o", F.lit(1).alias("_which"), F.lit(None).cast("long").alias("_k"), zero.alias("_z"), F.lit(2).alias("_kind"))
        both = there.unionByName(asked.select(*keys, "_node", "_o", "_which", "_k", F.lit(0).cast("long").alias("_z"), F.lit(1).alias("_kind")))
        # From the end, a value counts before the search that starts at its own row.
        seen = Ordered(both, [*keys, "_node"], ["_o", "_kind", "_which"]).running({"_zeros": ("sum", F.col("_z"))}, reverse=True).where("_kind = 1")
        inside = F.col("_k") < F.col("_zeros")
        asked = cut_lineage(seen.select(
            *keys, "_o", "_which", F.when(inside, F.col("_k")).otherwise(F.col("_k") - F.col("_zeros")).alias("_k"),
            (F.col("_node") * 2 + F.when(inside, 0).otherwise(1)).alias("_node")))
    found = attach(asked, rows.select(*keys, F.col("_rank").alias("_node"), "_v"), [*keys, "_node"])
    return found.groupBy(*keys, F.col("_o").alias(order)).agg(F.avg("_v").alias("median"))


def trim_voltage(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], voltage: str, time: str | None = None,
    min_length: int = 3, shift_start: int = 0, shift_end: int = 0, threshold: float = 0.25, reset_time: bool = True,
) -> DataFrame:
    """Drop leading and trailing rows that leave the median voltage.

    A row leaves when |v / median - 1| exceeds the threshold; both ends may be
    shifted inwards, and at least `min_length` rows stay.
    """
    min_length = max(abs(min_length), 1)
    rows = Ordered(df, keys, order).positions("_i", "_n")
    rows = attach(rows, quantiles(df, keys, voltage, {"_med": 0.5}), keys)
    out_of = F.coalesce(F.abs(F.try_divide(F.col(voltage), F.col("_med")) - 1) > threshold, F.lit(False))
    inside = F.when(~out_of, F.col("_i"))
    rows = with_group(rows, keys, F.min(inside).alias("_in0"), F.max(inside).alias("_in1"))
    n = F.col("_n")
    start = F.least(F.coalesce("_in0", n), n - min_length)
    start = F.least(start + abs(shift_start), n - min_length)
    end = F.greatest(F.coalesce(F.col("_in1") + 1, F.lit(0)), start + min_length)
    end = F.greatest(end - abs(shift_end), start + min_length)
    whole = n < 2 + min_length
    kept = rows.where(whole | ((F.col("_i") >= start) & (F.col("_i") < end)))
    if reset_time and time:
        kept = with_group(kept, keys, F.min_by(time, "_i").alias("_t0"))
        kept = kept.withColumn(time, F.when(whole, F.col(time)).otherwise(F.col(time) - F.col("_t0")))
    return kept.select(*df.columns)


def ensure_unique(
    df: DataFrame, label: str, order: Sequence[str], behavior: str = "increment", sep: str = "_", name: str = "unique_label"
) -> DataFrame:
    """Number repeated labels: from the second on (`increment`) or all (`all`)."""
    rows = Ordered(df, [label], order).positions("_i", "_n")
    text = F.col(label).cast("string")
    numbered = F.concat(text, F.lit(sep), F.col("_i").cast("string"))
    if behavior == "all":
        out = F.when(F.col("_n") > 1, numbered).otherwise(text)
    else:
        out = F.when(F.col("_i") > 0, numbered).otherwise(text)
    return rows.withColumn(name, out).drop("_i", "_n")


def rank_quantiles(df: DataFrame, keys: Sequence[str], value: str, name: str = "quantile") -> DataFrame:
    """Average rank divided by the count (ties share their mean rank).

    Ranks are made from counts per distinct value, so ties are combined
    before the shuffle.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    cum = Ordered(counted, keys, [value]).running({"_cum": ("sum", F.col("_k"))})
    cum = with_group(cum, keys, F.sum("_k").alias("_n"))
    rank = (F.col("_cum") - F.col("_k") + 1 + F.col("_cum")) / 2.0
    return attach(df, cum.select(*keys, value, (rank / F.col("_n")).alias(name)), [*keys, value])


def best_flags(df: DataFrame, keys: Sequence[str], tie: Sequence[str], lowest: Sequence[str] = (), highest: Sequence[str] = ()) -> DataFrame:
    """1.0 on the row with the lowest/highest value of its key, else 0.0."""
    aggs = [F.min_by(F.struct(*tie), F.struct(F.col(c), *tie)).alias(f"_b_{c}") for c in lowest]
    aggs += [
        F.min_by(F.struct(*tie), F.when(F.col(c).isNotNull(), F.struct(-F.col(c), *tie))).alias(f"_b_{c}") for c in highest
    ]
    rows = with_group(df, keys, *aggs)
    flags = [
        F.coalesce(F.struct(*tie) == F.col(f"_b_{c}"), F.lit(False)).cast("double").alias(f"best_{c}")
        for c in [*lowest, *highest]
    ]
    return rows.select(*df.columns, *flags)


def normalise_weights(
    df: DataFrame, weight: str, modes: Sequence[Sequence[str]], min_weight: float = 0.0, name: str = "norm_weight"
) -> DataFrame:
    """Min-max, clipped to [min_weight, 1], inside each grouping; then the mean.

    Weights that are not positive count as 1e-32; a grouping with one value
    gets `min_weight`.
    """
    parts = []
    x = F.when(F.col(weight) > 0, F.col(weight)).otherwise(1e-32)
    rows = df
    for k, keys in enumerate(modes):
        rows = with_group(rows, list(keys), F.min(x).alias(f"_lo{k}"), F.max(x).alias(f"_hi{k}"))
        span = F.col(f"_hi{k}") - F.col(f"_lo{k}")
        unit = F.least(F.greatest(F.try_divide(x - F.col(f"_lo{k}"), span), F.lit(float(min_weight))), F.lit(1.0))
        parts.append(F.when(span == 0, float(min_weight)).otherwise(unit))
    mean = reduce(lambda a, b: a + b, parts) / len(parts)
    return rows.select(*df.columns, mean.alias(name))


def bias_to_group(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], bias: float, method: str = "mean"
) -> DataFrame:
    """|x|^(1-b) * agg(|x|)^b * sign(x) within each group."""
    bias = min(max(bias, 0.0), 1.0)
    rows = df
    if method == "median":
        for c in columns:
            mags = df.select(*keys, F.abs(F.col(c)).alias("_m"))
            rows = attach(rows, quantiles(mags, keys, "_m", {f"_g_{c}": 0.5}), keys)
    else:
        fn = {"mean": F.avg, "min": F.min, "max": F.max}[method]
        rows = with_group(rows, keys, *[fn(F.abs(F.col(c))).alias(f"_g_{c}") for c in columns])
    for c in columns:
        pulled = F.pow(F.abs(F.col(c)), F.lit(1 - bias)) * F.pow(F.col(f"_g_{c}"), F.lit(bias)) * F.signum(F.col(c))
        rows = rows.withColumn(c, pulled)
    return rows.select(*df.columns)


def polarity(reference: str) -> Column:
    return F.signum(F.col(reference))


def order_by_frequency(
    df: DataFrame, keys: Sequence[str], freq: Sequence[str], values: Sequence[str], magnitude: Column, rtol: float = 1e-6
) -> DataFrame:
    """Positions by rising frequency with values reversed where they run backwards.

    A sweep runs backwards when its largest |Z| does not sit at the lowest
    frequency (beyond a tolerance); then value i takes the place n - 1 - i.
    """
    rows = Ordered(df.withColumn("_mag", magnitude), keys, freq).positions("pos", "_n")
    rows = with_group(
        rows, keys, F.max("_mag").alias("_top"), F.min_by("_mag", "pos").alias("_dc"), F.max_by("_mag", "pos").alias("_inf")
    )
    backwards = (F.abs(F.col("_top") - F.col("_dc")) > rtol * F.abs("_top")) & (F.col("_inf") > F.col("_dc"))
    axis = rows.select(*keys, "pos", *[F.col(c) for c in df.columns if c not in keys and c not in values])
    vals = rows.select(
        *keys,
        F.when(backwards, F.col("_n") - 1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"),
        *values,
        backwards.alias("reversed"),
    )
    return attach(axis, vals, [*keys, "pos"], "inner")


def standard_order(df: DataFrame, types: dict[str, str], orders: dict[str, Sequence[str]], rest: Sequence[str] = ()) -> DataFrame:
    """Cast key columns and sort; listed categories sort by their rank."""
    for c, t in types.items():
        df = df.withColumn(c, F.col(c).cast(t))
    sort = []
    for c in types:
        if c in orders:
            ranks = F.array(*[F.lit(x) for x in orders[c]])
            at = F.array_position(ranks, F.col(c))
            sort.append(F.when(at > 0, at).otherwise(len(orders[c]) + 1))
        sort.append(F.col(c))
    return df.orderBy(*sort, *rest)


def _pair_of(arr: Column):
    return lambda r: F.array(F.get(arr, 2 * r["i"]), F.get(arr, 2 * r["i"] + 1))


def sort_exponentials(params: Column, extra: Sequence[Column] = ()) -> Column:
    """Sort a flat [A0, tau0, A1, tau1, ..., B] array by tau, B stays last.

    Further flat arrays are carried along; the result is a struct of arrays.
    """
    arrays = [params, *extra]
    pairs = F.floor(F.size(params) / 2).cast("int")
    idx = F.when(pairs > 0, F.sequence(F.lit(0), pairs - 1)).otherwise(F.array().cast("array<int>"))
    ranked = F.array_sort(F.transform(idx, lambda i: F.struct(F.get(params, 2 * i + 1).alias("tau"), i.alias("i"))))
    out = []
    for k, arr in enumerate(arrays):
        core = F.flatten(F.transform(ranked, _pair_of(arr)))
        tail = F.slice(arr, 2 * pairs + 1, F.greatest(F.size(arr) - 2 * pairs, F.lit(0)))
        out.append(F.concat(core, tail).alias("params" if k == 0 else f"extra{k}"))
    return F.struct(*out)


def sort_groups(df: DataFrame, keys: Sequence[str], group: str, by: str, role: str) -> DataFrame:
    """Renumber element groups of each fit so that `by` rises with the number.

    Rows are (keys, group number, role, value); the role named `by` orders
    the groups, all roles of a group move together. Ranks are per fit, whose
    groups are the few elements of one circuit.
    """
    lead_rows = df.where(F.col(role) == by).select(*keys, group, F.col("value").alias("_r"))
    w_new = Window.partitionBy(*keys).orderBy("_r", group)
    w_old = Window.partitionBy(*keys).orderBy(group)
    new_rank = lead_rows.select(*keys, group, F.row_number().over(w_new).alias("_k"))
    names = lead_rows.select(*keys, F.col(group).alias("_new"), F.row_number().over(w_old).alias("_k"))
    moved = attach(new_rank, names, [*keys, "_k"], "inner").drop("_k")
    out = attach(df, moved, [*keys, group])
    return out.withColumn(group, F.coalesce("_new", F.col(group))).drop("_new")


def point_count(length: Column, dt: Column, max_points: int) -> Column:
    """Number of intervals: the limit, or a 1, 2, 2.5, 5 step below one unit."""
    limit = max_points - max_points % 2
    raw = length * dt / limit
    mult = F.pow(F.lit(10.0), F.ceil(-F.log10(raw)))
    steps = F.array(*[F.lit(s) for s in (1.0, 2.0, 2.5, 5.0)])
    ranked = F.transform(steps, lambda s: F.struct(F.abs(s - raw * mult).alias("d"), s.alias("s")))
    nice = F.array_min(ranked)["s"]
    return F.when(raw < 1, F.floor(length * dt / (nice / mult))).otherwise(limit).cast("long")


def downsample(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_points: int, dt: Column | None = None
) -> DataFrame:
    """Rows at evenly spaced positions 0..n-1; short keys stay whole."""
    rows = Ordered(df, keys, order).positions("_i", "_n")
    length = F.col("_n") - 1
    m = point_count(length, dt if dt is not None else F.lit(1.0), max_points)
    # Row i is kept when floor(k * length / m) == i for some k.
    k = F.ceil(F.try_divide(F.col("_i") * m, length.cast("double")))
    hit = F.floor(F.try_divide(k * length, m.cast("double"))) == F.col("_i")
    return rows.where((length <= max_points) | hit).select(*df.columns)


def series_offset(parts: DataFrame, keys: Sequence[str], order: Sequence[str], extent: str, name: str = "offset") -> DataFrame:
    """Running sum of the extents of the parts before each part."""
    rows = Ordered(parts, keys, order).running({name: ("sum", F.col(extent))}, exclusive=True)
    return rows.withColumn(name, F.coalesce(name, F.lit(0.0)))


def seconds_axis(df: DataFrame, keys: Sequence[str], ts: str, name: str = "t") -> DataFrame:
    """Seconds since the first stamp of the key."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = with_group(df.withColumn("_us", micros), keys, F.min("_us").alias("_us0"))
    return rows.withColumn(name, (F.col("_us") - F.col("_us0")) / 1e6).drop("_us", "_us0")


def time_axis(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, name: str = "t", min_corr: float = 0.9
) -> DataFrame:
    """Regular time axis of a run.

    Where time is linear in the row number (r >= 0.9) it becomes slope * i;
    otherwise repeated stamps are spread linearly between their neighbours.
    """
    timed = seconds_axis(df, keys, ts, "_t")
    rows = Ordered(timed, keys, order)
    pos = rows.positions("_i")
    i = F.col("_i").cast("double")
    pos = with_group(pos, keys, F.regr_slope(F.col("_t"), i).alias("_m"), F.corr(F.col("_t"), i).alias("_r"))
    seq = Ordered(pos, keys, ["_i"], split=rows.split)
    fresh = seq.frame({"_prev": lambda w: F.lag("_t").over(w)})
    known = F.when(F.coalesce(F.col("_t") != F.col("_prev"), F.lit(True)), F.col("_t"))
    filled = linear_fill(fresh.withColumn("_k", known), keys, ["_i"], "_k", split=rows.split)
    out = F.when(F.col("_r") >= min_corr, F.col("_m") * F.col("_i")).otherwise(F.col("_k"))
    return filled.withColumn(name, out).select(*df.columns, name)


def linear_fill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, split: bool | None = None
) -> DataFrame:
    """Fill nulls between neighbours by position; edges repeat the nearest value."""
    rows = Ordered(df, keys, order, split=split)
    pos = rows.positions("_pi")
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("_pi").alias("i"), F.col(value).cast("double").alias("v")))
    back = Ordered(pos.withColumn("_here", here), keys, ["_pi"], split=rows.split).running({"_bk": ("last", F.col("_here"))})
    both = Ordered(back, keys, ["_pi"], split=rows.split).running({"_fw": ("last", F.col("_here"))}, reverse=True)
    span = F.col("_fw.i") - F.col("_bk.i")
    between = F.col("_bk.v") + (F.col("_fw.v") - F.col("_bk.v")) * F.try_divide(F.col("_pi") - F.col("_bk.i"), span)
    out = F.coalesce(F.col(value), between, F.col("_bk.v"), F.col("_fw.v"))
    return both.withColumn(value, out).select(*df.columns)


def device_time(ticks: Column, timebase: Column, system_micros: Column) -> Column:
    """Device ticks times their base plus the system time as a timestamp."""
    return F.timestamp_micros((system_micros + F.round(ticks * timebase * 1e6)).cast("long"))


def segment_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], is_break: Column, time: str | None = None, name: str = "segment"
) -> DataFrame:
    """Number the rows between breaks and restart their time."""
    rows = Ordered(df.withColumn("_brk", F.coalesce(is_break, F.lit(False)).cast("long")), keys, order)
    out = rows.running({name: ("sum", F.col("_brk"))}).drop("_brk")
    if time:
        out = with_group(out, [*keys, name], F.min(time).alias("_t0"))
        out = out.withColumn(time, F.col(time) - F.col("_t0")).drop("_t0")
    return out


def segments_from_breakpoints(df: DataFrame, breaks: DataFrame, keys: Sequence[str], order: Sequence[str], time: str | None = None) -> DataFrame:
    """Segment numbers from a table (keys, breakpoint position)."""
    pos = Ordered(df, keys, order).positions("_i")
    marks = breaks.select(*keys, F.col("breakpoint").cast("long").alias("_i"), F.lit(True).alias("_is"))
    rows = attach(pos, marks.where(F.col("_i") > 0).distinct(), [*keys, "_i"])
    return segment_rows(rows, keys, ["_i"], F.col("_is"), time).drop("_i", "_is")


def crossing(x: Column, y: Column, x_prev: Column, y_prev: Column, level: Column) -> Column:
    """Linear position where y passes the level between two rows."""
    hit = F.signum(y_prev - level) * F.signum(y - level) < 0
    return F.when(hit, x_prev + (x - x_prev) * F.try_divide(level - y_prev, y - y_prev))


def arc_points(df: DataFrame, keys: Sequence[str], freq: str, re: str, im: str) -> DataFrame:
    """Peak of |Im Z| with R, C, tau and the half-height width in log10 f.

    The peak must not lie at an edge; otherwise the peak of the admittance
    counts, else the first point. R = 2 (max Re - Re at the peak).
    """
    y_im = F.abs(F.try_divide(F.col(im), F.col(re) * F.col(re) + F.col(im) * F.col(im)))
    rows = Ordered(df, keys, [freq])
    pos = rows.positions("_i", "_n").withColumn("_z", F.abs(F.col(im))).withColumn("_y", y_im)
    pos = with_group(
        pos, keys, F.max_by("_i", F.struct("_z", -F.col("_i"))).alias("_pz"), F.max_by("_i", F.struct("_y", -F.col("_i"))).alias("_py")
    )
    inner = lambda c: (F.col(c) > 0) & (F.col(c) < F.col("_n") - 1)
    pos = pos.withColumn("_p", F.when(inner("_pz"), F.col("_pz")).when(inner("_py"), F.col("_py")).otherwise(0))
    pos = with_group(
        pos, keys,
        F.max(F.when(F.col("_i") == F.col("_p"), F.col("_z"))).alias("_top"),
    )
    lf = F.log10(F.col(freq))
    half = F.col("_top") / 2
    seq = Ordered(pos.withColumn("_lf", lf), keys, ["_i"], split=rows.split)
    got = seq.frame(
        {"_lf0": lambda w: F.lag("_lf").over(w), "_z0": lambda w: F.lag("_z").over(w)}
    ).withColumn("_x", crossing(F.col("_lf"), F.col("_z"), F.col("_lf0"), F.col("_z0"), half))
    at = F.col("_i") == F.col("_p")
    out = got.groupBy(*keys).agg(
        F.max(F.when(at, F.col(freq))).alias("f_peak"),
        (2 * (F.max(re) - F.max(F.when(at, F.col(re))))).alias("R"),
        F.min(F.when(F.col("_i") <= F.col("_p"), F.col("_x"))).alias("_left"),
        F.min(F.when(F.col("_i") > F.col("_p"), F.col("_x"))).alias("_right"),
    )
    omega = 2 * F.pi() * F.col("f_peak")
    out = out.withColumn("tau", F.try_divide(F.lit(1.0), omega)).withColumn("C", F.try_divide(F.lit(1.0), omega * F.col("R")))
    out = out.withColumn("fwhm", F.col("_right") - F.col("_left"))
    width_f = F.pow(F.lit(10.0), F.col("_right")) - F.pow(F.lit(10.0), F.col("_left"))
    width_tau = F.try_divide(F.lit(1.0), 2 * F.pi() * F.pow(F.lit(10.0), F.col("_left"))) - F.try_divide(
        F.lit(1.0), 2 * F.pi() * F.pow(F.lit(10.0), F.col("_right"))
    )
    return out.withColumn("Q_f", F.try_divide(F.col("f_peak"), width_f)).withColumn(
        "Q_tau", F.try_divide(F.col("tau"), width_tau)
    ).drop("_left", "_right")


def arc_minima(df: DataFrame, keys: Sequence[str], order: Sequence[str], re: str, im: str) -> DataFrame:
    """Real part at the minima of -Im left and right of its maximum."""
    pos = Ordered(df, keys, order).positions("_i").withColumn("_m", -F.col(im))
    pos = with_group(pos, keys, F.max_by("_i", F.struct("_m", -F.col("_i"))).alias("_p"))
    left = F.when(F.col("_i") < F.col("_p"), F.struct("_m", "_i"))
    right = F.when(F.col("_i") >= F.col("_p"), F.struct("_m", "_i"))
    got = pos.groupBy(*keys).agg(F.min_by(re, left).alias("_a"), F.min_by(re, right).alias("_b"))
    return got.select(*keys, F.least("_a", "_b").alias("low_real"), F.greatest("_a", "_b").alias("high_real"))


def decade_labels(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, listed: Sequence[float] = (), name: str = "marked") -> DataFrame:
    """Mark rows where the decade changes or the value is listed; zero is a decade of its own."""
    lg = F.log10(F.abs(F.nullif(F.col(value).cast("double"), F.lit(0.0))))
    dec = F.when(F.col(value) == 0, float("-inf")).otherwise(F.floor(lg).cast("double"))
    rows = Ordered(df, keys, order).frame({"_d0": lambda w: F.lag(dec).over(w)})
    mark = F.coalesce(dec != F.col("_d0"), F.col("_d0").isNull() & dec.isNotNull())
    if listed:
        mark = mark | F.col(value).isin(list(listed))
    return rows.withColumn(name, mark).drop("_d0")
