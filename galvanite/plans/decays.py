"""Decay curves on uniform time grids, ready for the frequency domain."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.functions.units import multi_exponential_curve, significant
from galvanite.keyed import Ordered, attach, quantiles, with_group
from galvanite.operators.windows import gradient_by, savgol
from galvanite.plans.interpolation import interpolate_at
from galvanite.session import cut_lineage

# Fixed value: vacuum permittivity of the decay transform, F/cm.
EPS0_DECAY = 8.854187817e-14
DEFAULT_DIMS = (25.0, 0.045)


def uniform_grid(start: Column, stop: Column, dt: Column) -> Column:
    """Array of round((stop - start) / dt) + 1 evenly spaced times."""
    n = F.round((stop - start) / dt).cast("int")
    # Read by the inner function, so that they are worked out once a grid: rounding at every point would be most of the work.
    facts = F.struct(start.alias("a"), n.alias("n"), F.coalesce(F.try_divide(stop - start, n.cast("double")), F.lit(0.0)).alias("step"))
    grid = F.transform(F.array(facts), lambda g: F.transform(F.sequence(F.lit(0), F.greatest(g["n"], F.lit(0))), lambda i: g["a"] + i * g["step"]))
    return grid[0]


def spread_by_points(rows: DataFrame, points: Column, per_task: int = 500_000) -> DataFrame:
    """Rows dealt to as many tasks as their grids need: a small table in one task would make all points there."""
    total = rows.agg(F.sum(points)).first()[0] or 0
    parts = math.ceil(total / per_task)
    return rows.repartition(parts) if parts > 1 else rows


def _derived(df: DataFrame) -> DataFrame:
    out = df.withColumn("conductivity", F.try_divide(F.col("flux"), F.col("field")))
    return out.withColumn("decay", F.col("conductivity") / EPS0_DECAY)


def _dims(dims: tuple[float, float]) -> tuple[float, float]:
    area, thickness = dims
    return area, thickness * 1e-4 if thickness >= 50 else thickness


def decay_from_data(
    df: DataFrame, keys: Sequence[str], time: str, current: str, voltage: str, dims: tuple[float, float] = DEFAULT_DIMS,
    max_f_max: float = 100.0, min_f_min: float = 1e-5, method: str = "cubic", dt: Column | None = None,
) -> DataFrame:
    """Current and voltage on a uniform grid with field, flux and decay.

    dt is the median step (or a given aggregate column), not below
    1/(2 max_f_max); the end is the last time, at most 1/min_f_min later.
    """
    area, thickness = _dims(dims)
    rows = df.select(*keys, F.col(time).cast("double").alias("t"), F.col(current).cast("double").alias("_i"), F.col(voltage).cast("double").alias("_v"))
    steps = Ordered(rows, keys, ["t"]).frame({"_step": lambda w: F.col("t") - F.lag("t").over(w)})
    med = quantiles(steps, keys, "_step", {"_dt": 0.5}) if dt is None else steps.groupBy(*keys).agg(dt.alias("_dt"))
    ends = attach(rows.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1")), med, keys)
    least = significant(F.lit(1.0 / (2.0 * max_f_max)), 3)
    ends = ends.withColumn("dt", significant(F.greatest(F.col("_dt"), least), 3))
    stop = F.rint(F.least(F.col("_t1"), F.col("_t0") + 1.0 / min_f_min))
    ends = spread_by_points(cut_lineage(ends), F.try_divide(stop - F.col("_t0"), F.col("dt")))
    grid = ends.withColumn("_grid", uniform_grid(F.col("_t0"), stop, F.col("dt")))
    grid = cut_lineage(grid.select(*keys, "dt", F.posexplode("_grid").alias("i", "t")))
    out = attach(grid, interpolate_at(rows, grid, keys, "t", ["_i", "_v"], method), [*keys, "t"])
    out = out.withColumn("flux", F.col("_i") / area).withColumn("field", F.col("_v") / thickness).drop("_i", "_v")
    return cut_lineage(_derived(out))


def decay_from_fit(
    fits: DataFrame, keys: Sequence[str], current: str, voltage: str, dims: tuple[float, float] = DEFAULT_DIMS,
    min_f_max: float = 1.0, max_f_max: float = 10.0, max_f_min: float = 1e-2, min_f_min: float = 1e-5,
) -> DataFrame:
    """The same from multi-exponential parameters (flat arrays per segment).

    dt = least tau / 10 and end = 7 (or 5 for several taus) times the largest
    tau, both within the limits that the frequency range gives.
    """
    area, thickness = _dims(dims)
    p = F.col(current)
    idx = F.sequence(F.lit(1), F.greatest(F.size(p) - 2, F.lit(1)), F.lit(2))
    taus = F.filter(F.transform(idx, lambda i: F.get(p, i)), lambda t: t > 0)
    rows = fits.withColumn("_taus", taus)
    raw_dt = F.coalesce(F.array_min("_taus") / 10, F.lit(float("inf")))
    dt_max, dt_min = significant(F.lit(1 / (2 * min_f_max)), 3), significant(F.lit(1 / (2 * max_f_max)), 3)
    rows = rows.withColumn("dt", significant(F.greatest(F.least(raw_dt, dt_max), dt_min), 3))
    raw_end = F.coalesce(F.when(F.size("_taus") == 1, 7).otherwise(5) * F.array_max("_taus"), F.lit(0.0))
    rows = rows.withColumn("_end", F.least(F.greatest(F.rint(raw_end), F.lit(1 / max_f_min)), F.lit(1 / min_f_min)))
    rows = spread_by_points(rows, F.col("_end") / F.col("dt"))
    grid = rows.withColumn("_grid", uniform_grid(F.lit(0.0), F.col("_end"), F.col("dt")))
    out = grid.select(*keys, "dt", current, voltage, F.posexplode("_grid").alias("i", "t"))
    out = out.withColumn("flux", multi_exponential_curve(F.col("t"), F.col(current)) / area).withColumn(
        "field", multi_exponential_curve(F.col("t"), F.col(voltage)) / thickness
    )
    return _derived(out.drop(current, voltage))


def window_weight(kind: str | tuple, i: Column, n: Column) -> Column:
    """Periodic window value at row i of n: hann, hamming, blackman, cosine, tukey."""
    name, *args = kind if isinstance(kind, tuple) else (kind,)
    x = 2 * F.pi() * i / n
    if name in ("hann", "hanning"):
        return 0.5 - 0.5 * F.cos(x)
    if name == "hamming":
        return 0.54 - 0.46 * F.cos(x)
    if name == "blackman":
        return 0.42 - 0.5 * F.cos(x) + 0.08 * F.cos(2 * x)
    if name == "cosine":
        return F.sin(F.pi() / (n + 1) * (i + 0.5))
    if name == "tukey":
        a = float(args[0]) if args else 0.5
        width = F.floor(a * n / 2.0)
        rise = 0.5 * (1 + F.cos(F.pi() * (-1 + 2.0 * i / a / n)))
        fall = 0.5 * (1 + F.cos(F.pi() * (-2.0 / a + 1 + 2.0 * i / a / n)))
        return F.when(i < width + 1, rise).when(i < n - width, 1.0).otherwise(fall)
    if name in ("boxcar", "rectangular"):
        return F.lit(1.0)
    raise ValueError(f"unknown window {kind!r}")


def prepare_decay(
    decay: DataFrame, keys: Sequence[str], remove_mean: float | int | str | Callable | None = 0.075,
    window: str | tuple | None = None, modify: str | None = None, pad: bool = True, offsets: DataFrame | None = None,
    extension: DataFrame | None = None, align_points: int = 3,
) -> DataFrame:
    """Subtract the final mean, apply a window, pad to a power of two.

    Input rows are (keys, i, t, dt, decay). `remove_mean`: a share of the last
    rows, a negative row count, `b0` (table `offsets` with column ss_decay),
    or an aggregate column made by a function. With `extension` (keys, i, t,
    decay of a longer fitted curve) the tail of the fit replaces the zeros.
    """
    rows = with_group(decay, keys, F.count(F.lit(1)).alias("n"), F.max("i").alias("_last"))
    if modify == "gradient":
        rows = gradient_by(rows, keys, ["i"], "decay", "t", "_m").withColumn("decay", F.col("_m")).drop("_m")
    elif modify == "smooth":
        rows = savgol(rows, keys, ["i"], "decay", 3, 2, name="_m").withColumn("decay", F.col("_m")).drop("_m")
    if remove_mean == "b0":
        rows = attach(rows, offsets.select(*keys, "ss_decay"), keys)
    elif remove_mean is None:
        rows = rows.withColumn("ss_decay", F.lit(0.0))
    elif callable(remove_mean):
        rows = with_group(rows, keys, remove_mean(F.col("decay")).alias("ss_decay"))
    else:
        if isinstance(remove_mean, int) and remove_mean < 0:
            take = F.lit(-remove_mean)
        else:
            share = remove_mean if 0 < remove_mean < 1 else abs(remove_mean) / 100.0
            take = F.greatest(F.lit(1), F.floor(F.col("n") * share))
        tail = F.avg(F.when(F.col("i") > F.col("_last") - take, F.col("decay")))
        rows = with_group(rows, keys, tail.alias("ss_decay"))
    val = F.col("decay") - F.col("ss_decay")
    if window is not None:
        val = val * window_weight(window, F.col("i"), F.col("n"))
    rows = rows.withColumn("decay", val)
    rows = rows.withColumn("dc_conductivity", F.col("ss_decay") * EPS0_DECAY)
    base = rows.select(*keys, "i", "t", "dt", "decay", "ss_decay", "dc_conductivity", "n")
    if not pad:
        return base
    one = base.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("dt").alias("dt"), F.max("t").alias("_t"), F.first("ss_decay").alias("ss_decay"),
        F.first("dc_conductivity").alias("dc_conductivity"),
        F.avg(F.when(F.col("i") >= F.col("n") - align_points, F.col("decay"))).alias("_tail"),
    )
    if extension is not None:
        more = attach(extension.select(*keys, "i", "t", F.col("decay").alias("_e")), one, keys, "inner")
        more = with_group(more, keys, F.max(F.when(F.col("i") == F.col("n"), F.col("_e"))).alias("_e0"))
        more = more.where(F.col("i") >= F.col("n")).select(
            *keys, "i", "t", "dt", (F.col("_e") + F.col("_tail") - F.col("_e0")).alias("decay"), "ss_decay", "dc_conductivity", "n"
        )
    else:
        full = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n")))).cast("int")
        zeros = one.withColumn("_full", full).where((F.col("_full") > F.col("n")) & (F.col("ss_decay") != 0))
        more = zeros.withColumn("i", F.explode(F.sequence(F.col("n").cast("int"), F.col("_full") - 1))).select(
            *keys, "i", (F.col("_t") + (F.col("i") - F.col("n") + 1) * F.col("dt")).alias("t"), "dt", F.lit(0.0).alias("decay"),
            "ss_decay", "dc_conductivity", "n",
        )
    out = base.unionByName(more)
    return with_group(out.drop("n"), keys, F.count(F.lit(1)).alias("n"))
