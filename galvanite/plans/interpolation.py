"""Interpolation on new grids: linear, PCHIP and cubic splines.

Knots carry their cubic piece; a wanted position finds its piece by a union
with the knots and a running last value, so no position is compared with all
knots and a key may have any number of either.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.keyed import Ordered, attach, map_keys, quantiles, with_group

# The influence of a knot on a cubic spline falls by at least one half per
# knot, so 64 rows of context leave an error below the last double digit.
SPLINE_HALO = 64


def pchip_slopes(df: DataFrame, keys: Sequence[str], x: str, y: str, split: bool | None = None, name: str = "_d") -> DataFrame:
    """Add the monotone slope at every knot (weighted harmonic mean)."""
    seq = Ordered(df, keys, [x], split=split)
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    near = seq.frame(
        {
            "_x1": lambda w: F.lag(xs).over(w), "_y1": lambda w: F.lag(ys).over(w),
            "_x2": lambda w: F.lag(xs, 2).over(w), "_y2": lambda w: F.lag(ys, 2).over(w),
            "_x3": lambda w: F.lead(xs).over(w), "_y3": lambda w: F.lead(ys).over(w),
            "_x4": lambda w: F.lead(xs, 2).over(w), "_y4": lambda w: F.lead(ys, 2).over(w),
        },
        halo=2,
    )
    h0, h1 = xs - F.col("_x1"), F.col("_x3") - xs
    s0, s1 = F.try_divide(ys - F.col("_y1"), h0), F.try_divide(F.col("_y3") - ys, h1)
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    inner = F.when(
        F.signum(s0) * F.signum(s1) <= 0, 0.0
    ).otherwise(F.try_divide(w1 + w2, F.try_divide(w1, s0) + F.try_divide(w2, s1)))

    def edge(ha: Column, hb: Column, sa: Column, sb: Column) -> Column:
        d = F.try_divide((2 * ha + hb) * sa - ha * sb, ha + hb)
        flat = F.signum(d) != F.signum(sa)
        steep = (F.signum(sa) != F.signum(sb)) & (F.abs(d) > 3 * F.abs(sa))
        return F.when(flat, 0.0).when(steep, 3 * sa).otherwise(d)

    hb1 = F.col("_x4") - F.col("_x3")
    sb1 = F.try_divide(F.col("_y4") - F.col("_y3"), hb1)
    hb0 = F.col("_x1") - F.col("_x2")
    sb0 = F.try_divide(F.col("_y1") - F.col("_y2"), hb0)
    first, last = F.col("_x1").isNull(), F.col("_x3").isNull()
    d = (
        F.when(first & last, 0.0)
        .when(first & F.col("_x4").isNull(), s1)
        .when(last & F.col("_x2").isNull(), s0)
        .when(first, edge(h1, hb1, s1, sb1))
        .when(last, edge(h0, hb0, s0, sb0))
        .otherwise(inner)
    )
    return near.select(*df.columns, d.alias(name))


def spline_slopes(
    df: DataFrame, keys: Sequence[str], x: str, y: str, natural: bool = True, split: bool | None = None, name: str = "_d"
) -> DataFrame:
    """Add the cubic-spline slope at every knot.

    Each block of a key is solved with its neighbours' rows as context.
    """
    seq = Ordered(df, keys, [x], split=split)
    if not seq.split:
        return map_keys(df, keys, [x], [x, y], lambda xs, ys: (None, [spline_derivatives(xs, ys, natural)]), f"`{name}` double")
    types = dict(df.dtypes)
    spread = seq.spread_blocks(SPLINE_HALO)
    rest = [c for c in df.columns if c not in keys]
    schema = "".join(f"`{c}` {types[c]}, " for c in [*keys, *rest]) + f"`{name}` double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_kx_i")
        pdf[name] = spline_derivatives(pdf[x].to_numpy(float), pdf[y].to_numpy(float), natural)
        return pdf.loc[pdf["_kx_home"], [*keys, *rest, name]]

    return spread.groupBy(*keys, "_kx_t").applyInPandas(solve, schema)


def spline_derivatives(x: np.ndarray, y: np.ndarray, natural: bool = True) -> np.ndarray:
    """First derivatives of a cubic spline at its knots (tridiagonal solve)."""
    n = len(x)
    if n < 2:
        return np.zeros(n)
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    if n == 2:
        return np.array([s[0], s[0]])
    lower, diag, upper, rhs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    diag[1:-1] = 2 * (h[:-1] + h[1:])
    lower[1:-1], upper[1:-1] = h[1:], h[:-1]
    rhs[1:-1] = 3 * (h[1:] * s[:-1] + h[:-1] * s[1:])
    if natural or n == 3:
        diag[0], upper[0], rhs[0] = 2.0, 1.0, 3 * s[0]
        diag[-1], lower[-1], rhs[-1] = 2.0, 1.0, 3 * s[-1]
    else:
        a = h[0] + h[1]
        diag[0], upper[0] = h[1], a
        rhs[0] = ((h[0] + 2 * a) * h[1] * s[0] + h[0] ** 2 * s[1]) / a
        b = h[-1] + h[-2]
        diag[-1], lower[-1] = h[-2], b
        rhs[-1] = (h[-1] ** 2 * s[-2] + (2 * b + h[-1]) * h[-2] * s[-1]) / b
    for i in range(1, n):
        f = lower[i] / diag[i - 1]
        diag[i] -= f * upper[i - 1]
        rhs[i] -= f * rhs[i - 1]
    out = np.empty(n)
    out[-1] = rhs[-1] / diag[-1]
    for i in range(n - 2, -1, -1):
        out[i] = (rhs[i] - upper[i] * out[i + 1]) / diag[i]
    return out


def hermite(x: Column, x0: Column, y0: Column, d0: Column, x1: Column, y1: Column, d1: Column) -> Column:
    h = x1 - x0
    t = F.try_divide(x - x0, h)
    return (
        (1 + 2 * t) * (1 - t) * (1 - t) * y0
        + t * (1 - t) * (1 - t) * h * d0
        + t * t * (3 - 2 * t) * y1
        + t * t * (t - 1) * h * d1
    )


def interpolate_at(
    known: DataFrame, wanted: DataFrame, keys: Sequence[str], x: str, y: str | Sequence[str], method: str = "pchip",
    extrapolate: bool = True,
) -> DataFrame:
    """Values of the `y` columns at the wanted positions: (keys, x, *y).

    Positions outside the knots use the outermost piece, or give null. All
    columns share one pass; rows with a null in any of them are no knots.
    """
    keys = list(keys)
    cols = [y] if isinstance(y, str) else list(y)
    base = known.dropna(subset=[x, *cols]).select(*keys, F.col(x).cast("double").alias(x), *[F.col(c).cast("double").alias(c) for c in cols])
    seq = Ordered(base, keys, [x])
    knots = seq.frame({"_xp": lambda w: F.lag(x).over(w), "_xn": lambda w: F.lead(x).over(w)})
    if method != "linear":
        for c in cols:
            if method == "pchip":
                knots = pchip_slopes(knots, keys, x, c, seq.split, f"_d_{c}")
            elif method in ("cubic", "natural", "not-a-knot"):
                knots = spline_slopes(knots, keys, x, c, method != "not-a-knot", seq.split, f"_d_{c}")
            else:
                raise ValueError(f"unknown method {method!r}")
    else:
        for c in cols:
            knots = knots.withColumn(f"_d_{c}", F.lit(0.0))
    near = {}
    for c in cols:
        near[f"_yp_{c}"] = lambda w, c=c: F.lag(c).over(w)
        near[f"_yn_{c}"] = lambda w, c=c: F.lead(c).over(w)
        near[f"_dp_{c}"] = lambda w, c=c: F.lag(f"_d_{c}").over(w)
        near[f"_dn_{c}"] = lambda w, c=c: F.lead(f"_d_{c}").over(w)
    knots = Ordered(knots, keys, [x], split=seq.split).frame(near)
    parts = [F.col(x).alias("x"), F.col("_xp").alias("xp"), F.col("_xn").alias("xn")]
    for j, c in enumerate(cols):
        parts += [F.col(c).alias(f"y{j}"), F.col(f"_yp_{c}").alias(f"yp{j}"), F.col(f"_yn_{c}").alias(f"yn{j}"),
                  F.col(f"_d_{c}").alias(f"d{j}"), F.col(f"_dp_{c}").alias(f"dp{j}"), F.col(f"_dn_{c}").alias(f"dn{j}")]
    marks = knots.select(*keys, F.col(x).alias("_at"), F.lit(0).alias("_side"), F.struct(*parts).alias("_k"))
    asks = wanted.select(*keys, F.col(x).cast("double").alias("_at")).distinct().withColumn("_side", F.lit(1))
    both = marks.unionByName(asks, allowMissingColumns=True)
    line = Ordered(both, keys, ["_at", "_side"])
    got = line.running({"_a": ("last", F.col("_k"))})
    if extrapolate:
        got = Ordered(got, keys, ["_at", "_side"], split=line.split).running({"_z": ("last", F.col("_k"))}, reverse=True)
    at = F.col("_at")

    def piece(k: str, first: str, second: str, j: int) -> Column:
        x0, x1 = F.col(f"{k}.x{first}"), F.col(f"{k}.x{second}")
        y0, y1 = F.col(f"{k}.y{first}{j}"), F.col(f"{k}.y{second}{j}")
        if method == "linear":
            return y0 + (y1 - y0) * F.try_divide(at - x0, x1 - x0)
        return hermite(at, x0, y0, F.col(f"{k}.d{first}{j}"), x1, y1, F.col(f"{k}.d{second}{j}"))

    out = []
    for j, c in enumerate(cols):
        val = F.when(F.col("_a.x") == at, F.col(f"_a.y{j}")).when(F.col("_a.xn").isNotNull(), piece("_a", "", "n", j))
        if extrapolate:
            val = val.when(F.col("_a").isNotNull() & F.col("_a.xp").isNotNull(), piece("_a", "p", "", j)).when(
                F.col("_a").isNull() & F.col("_z.xn").isNotNull(), piece("_z", "", "n", j))
        out.append(val.alias(c))
    return got.where(F.col("_side") == 1).select(*keys, at.alias(x), *out)


def regrid_log(
    df: DataFrame, keys: Sequence[str], freq: str, value: str, per_decade: int, method: str = "pchip"
) -> DataFrame:
    """Interpolate on a log grid between the ends of every dataset."""
    from galvanite.functions.units import log_grid

    logged = df.withColumn("_lf", F.log10(F.col(freq)))
    ends = logged.groupBy(*keys).agg(F.min("_lf").alias("_lo"), F.max("_lf").alias("_hi"))
    count = F.floor(1 + per_decade * (F.col("_hi") - F.col("_lo"))).cast("int")
    grid = ends.withColumn("_f", F.explode(log_grid(F.col("_lo"), F.col("_hi"), F.greatest(count, F.lit(2)))))
    grid = grid.select(*keys, F.log10("_f").alias("_lf"))
    out = interpolate_at(logged, grid, keys, "_lf", value, method)
    return out.select(*keys, F.pow(F.lit(10.0), F.col("_lf")).alias(freq), value)


def x_intercepts(df: DataFrame, keys: Sequence[str], order: Sequence[str], re: str, im: str, tolerance: float = 0.1) -> DataFrame:
    """Real value where -Im crosses zero nearest to its last minimum.

    The root counts when it is within 10 % of that minimum, else the minimum
    itself is taken.
    """
    from galvanite.operators.windows import arc_minima, crossing

    low = arc_minima(df, keys, order, re, im)
    rows = Ordered(df, keys, order).frame({"_r0": lambda w: F.lag(re).over(w), "_m0": lambda w: F.lag(-F.col(im)).over(w)})
    root = crossing(F.col(re), -F.col(im), F.col("_r0"), F.col("_m0"), F.lit(0.0))
    rows = attach(rows.withColumn("_root", root), low, keys)
    near = F.min_by("_root", F.when(F.col("_root").isNotNull(), F.abs(F.col("_root") - F.col("high_real"))))
    got = rows.groupBy(*keys).agg(near.alias("_near"), F.max("high_real").alias("_min"))
    ok = F.abs(F.col("_near") - F.col("_min")) <= tolerance * F.abs("_min")
    return got.select(*keys, F.when(ok, F.col("_near")).otherwise(F.col("_min")).alias("x_intercept"))
