"""Decay-curve fits of many segments at once.

The nonlinear parameters become candidate rows: for a fixed time constant the
model is a line in its amplitude and offset, so its residual sum is an
aggregate. A few rounds of refined grids find the minimum; Gauss-Newton rounds
with aggregated normal equations then polish it and give deviations. No step
needs all rows of a segment in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.functions import units
from galvanite.functions.standard import ordered_bounds
from galvanite.keyed import Ordered, attach, has_hot_group, quantiles, with_group
from galvanite.operators.metrics import error_metrics
from galvanite.operators.select import target_rows
from galvanite.operators.windows import bias_to_group
from galvanite.plans.kernels import t_quantile
from galvanite.session import cut_lineage, cut_to_files

# Model name -> (column function, parameter names).
MODELS: dict[str, tuple[Callable, list[str]]] = {
    "linear": (units.linear_curve, ["a0", "b0"]),
    "power": (units.power_curve, ["a0", "tau0", "b0"]),
    "exp": (units.exponential_curve, ["a0", "tau0", "b0"]),
    "double_exp": (units.double_exponential_curve, ["a0", "tau0", "a1", "tau1", "b0"]),
    "stretch_exp": (units.stretched_curve, ["a0", "tau0", "beta0", "b0"]),
}
MIN_TAU = 1e-8


def multi_exp(n: int) -> tuple[Callable, list[str]]:
    """Sum of n exponentials with offset."""
    names = [p for k in range(n) for p in (f"a{k}", f"tau{k}")] + ["b0"]
    return (lambda t, *p: units.multi_exponential_curve(t, F.array(*p))), names


def model_of(model) -> tuple[Callable, list[str]]:
    """A named model, (function, names), or any function f(t, p0, p1, ...)."""
    if isinstance(model, str):
        return MODELS[model]
    if isinstance(model, tuple):
        return model
    count = model.__code__.co_argcount - 1
    return model, [f"p{k}" for k in range(count)]


# --- first guesses -------------------------------------------------------------

def _anchored(df: DataFrame, keys, t: str, y: str, b0: str | None) -> DataFrame:
    """Positions, size and the baseline of every segment."""
    rows = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y"),
        (F.col(b0).cast("double") if b0 else F.lit(None).cast("double")).alias("_given"),
    )
    pos = Ordered(rows, keys, ["_t"]).positions("_i", "_n")
    mag = F.abs("_y")
    item = F.struct(F.col("_i").alias("i"), F.col("_y").alias("y"))
    lo, hi = F.min_by(item, F.struct(mag, F.col("_i"))), F.max_by(item, F.struct(mag, -F.col("_i")))
    late = F.greatest(lo, hi)
    last = F.max_by("_y", "_i")
    edge = F.when(late["i"] < F.max("_n") * 0.75, last).otherwise(late["y"])
    return with_group(pos, keys, F.coalesce(F.max("_given"), edge).alias("_b0"))


def guess_linear(df: DataFrame, keys: Sequence[str], t: str, y: str) -> DataFrame:
    x = F.col(t).cast("double")
    return df.groupBy(*keys).agg(F.regr_slope(F.col(y), x).alias("a0"), F.regr_intercept(F.col(y), x).alias("b0"))


def guess_power(df: DataFrame, keys: Sequence[str], t: str, y: str, b0: str | None = None) -> DataFrame:
    """Log-log slope; the amplitude takes the sign of the baseline."""
    rows = _anchored(df, keys, t, y, b0)
    ok = (F.col("_t") != 0) & (F.col("_y") != 0)
    lt, ly = F.log(F.abs(F.when(ok, F.col("_t")))), F.log(F.abs(F.when(ok, F.col("_y"))))
    got = rows.groupBy(*keys).agg(F.regr_slope(ly, lt).alias("_m"), F.regr_intercept(ly, lt).alias("_c"), F.max("_b0").alias("b0"))
    return got.select(*keys, (F.signum("b0") * F.exp("_c")).alias("a0"), F.abs("_m").alias("tau0"), "b0")


def guess_exponential(df: DataFrame, keys: Sequence[str], t: str, y: str, b0: str | None = None) -> DataFrame:
    """Tail slope of ln|y - b0| over the last 12 N rows, N = max(2, int(.05 n)).

    The amplitude is the mean of |y - b0| exp(t / tau) (or its largest value
    when that would overflow), signed by the direction of the change.
    """
    rows = _anchored(df, keys, t, y, b0)
    adj = F.abs(F.col("_y") - F.col("_b0"))
    rows = rows.withColumn("_adj", F.when(adj == 0, 1e-32).otherwise(adj)).withColumn("_part", F.greatest(F.lit(2), F.floor(F.col("_n") * 0.05)))
    tail = F.col("_i") >= F.col("_n") - 12 * F.col("_part")
    lead = F.avg(F.when(F.col("_i") < 2 * F.col("_part"), F.col("_y")))
    rest = F.avg(F.when(F.col("_i") >= F.col("_n") - 2 * F.col("_part"), F.col("_y")))
    slope = F.regr_slope(F.when(tail, F.log("_adj")), F.when(tail, F.col("_t")))
    rows = with_group(rows, keys, slope.alias("_m"), F.signum(lead - rest).alias("_sign"), F.max("_t").alias("_end"))
    rows = rows.withColumn("_tau", F.greatest(F.coalesce(F.try_divide(F.lit(-1.0), F.col("_m")), F.lit(MIN_TAU)), F.lit(MIN_TAU)))
    steep = F.col("_end") / F.col("_tau") > 500
    scaled = F.when(~steep, F.col("_adj") * F.exp(F.least(F.col("_t") / F.col("_tau"), F.lit(700.0))))
    got = rows.groupBy(*keys).agg(
        (F.coalesce(F.avg(scaled), F.max("_adj")) * F.max("_sign")).alias("a0"), F.max("_tau").alias("tau0"), F.max("_b0").alias("b0")
    )
    return got


def guess_double_exponential(df: DataFrame, keys: Sequence[str], t: str, y: str, b0: str | None = None) -> DataFrame:
    """Tail and early time constants; amplitudes by 2x2 normal equations.

    Amplitudes that come out not positive are replaced by a small positive
    one (two decades below the range).
    """
    one = guess_exponential(df, keys, t, y, b0).select(*keys, F.col("tau0").alias("_ta"), F.col("b0").alias("_base"), F.signum("a0").alias("_sign"))
    rows = attach(_anchored(df, keys, t, y, b0), one, keys)
    adj = F.abs(F.col("_y") - F.col("_base"))
    rows = rows.withColumn("_adj", F.when(adj == 0, 1e-32).otherwise(adj))
    early = F.col("_i") < 2 * F.greatest(F.lit(2), F.floor(F.col("_n") * 0.05))
    rows = with_group(
        rows, keys, F.regr_slope(F.when(early, F.col("_adj")), F.when(early, F.col("_t"))).alias("_m"), F.min_by("_adj", "_i").alias("_first"),
        (F.max("_adj") - F.min("_adj")).alias("_range"),
    )
    quick = F.greatest(F.coalesce(F.abs(F.try_divide(F.col("_first"), F.col("_m"))), F.col("_ta") / 10), F.lit(1e-16))
    quick = F.when(quick == F.col("_ta"), quick / 10).otherwise(quick)
    rows = rows.withColumn("_t1", F.least(quick, F.col("_ta"))).withColumn("_t2", F.greatest(quick, F.col("_ta")))
    e1, e2 = F.exp(-F.col("_t") / F.col("_t1")), F.exp(-F.col("_t") / F.col("_t2"))
    got = rows.groupBy(*keys).agg(
        F.sum(e1 * e1).alias("s11"), F.sum(e1 * e2).alias("s12"), F.sum(e2 * e2).alias("s22"), F.sum(e1 * F.col("_adj")).alias("y1"),
        F.sum(e2 * F.col("_adj")).alias("y2"), *[F.max(c).alias(c) for c in ("_t1", "_t2", "_base", "_sign", "_range")],
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    a1 = F.try_divide(F.col("y1") * F.col("s22") - F.col("y2") * F.col("s12"), det)
    a2 = F.try_divide(F.col("y2") * F.col("s11") - F.col("y1") * F.col("s12"), det)
    small = F.pow(F.lit(10.0), F.floor(F.log10(F.when(F.col("_range") > 0, F.col("_range")).otherwise(1e-30))) - 2)
    bad1, bad2 = F.coalesce(a1 <= 0, F.lit(True)), F.coalesce(a2 <= 0, F.lit(True))
    fix = lambda bad, own, other, other_bad: (
        F.when(bad, small).when(other_bad, own + other - small).otherwise(own)
    )
    return got.select(
        *keys, (fix(bad1, a1, a2, bad2) * F.col("_sign")).alias("a0"), F.col("_t1").alias("tau0"),
        (fix(bad2, a2, a1, bad1) * F.col("_sign")).alias("a1"), F.col("_t2").alias("tau1"), F.col("_base").alias("b0"),
    )


def guess_stretched(df: DataFrame, keys: Sequence[str], t: str, y: str, b0: str | None = None, beta_min: float = 0.3) -> DataFrame:
    two = guess_double_exponential(df, keys, t, y, b0)
    spread = F.log(F.greatest(F.col("tau1") / F.col("tau0"), F.col("tau0") / F.col("tau1")))
    beta = F.least(F.lit(1.0), F.greatest(F.lit(beta_min), F.coalesce(F.try_divide(F.log(F.lit(2.0)), spread), F.lit(1.0))))
    return two.select(
        *keys, ((F.abs("a0") + F.abs("a1")) * F.signum("b0")).alias("a0"), F.sqrt(F.col("tau0") * F.col("tau1")).alias("tau0"),
        beta.alias("beta0"), "b0",
    )


GUESSES = {
    "linear": guess_linear, "power": guess_power, "exp": guess_exponential, "double_exp": guess_double_exponential,
    "stretch_exp": guess_stretched,
}


# --- grids ---------------------------------------------------------------------

def _basis(model: str, t: Column, shape: Column, beta: Column) -> Column:
    if model == "exp":
        return F.exp(-t / shape)
    if model == "power":
        return F.pow(F.when(t == 0, 1e-32).otherwise(t), -shape)
    return F.exp(-F.pow(t / shape, beta))


def grid_round(df: DataFrame, keys: Sequence[str], t: str, y: str, candidates: DataFrame, model: str = "exp") -> DataFrame:
    """Best candidate per key: amplitude, offset and residual sum.

    `candidates` has (keys, cands array<struct<tau, beta>>). Every row meets
    each candidate once inside the scan; the sums are combined before the
    shuffle.
    """
    rows = df.select(*keys, F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y")).where(
        F.col("_t").isNotNull() & F.col("_y").isNotNull()
    )
    spread = attach(rows, candidates, keys, "inner").select(*keys, "_t", "_y", F.explode("cands").alias("_c")).select(*keys, "_t", "_y", "_c.tau", "_c.beta")
    e = _basis(model, F.col("_t"), F.col("tau"), F.col("beta"))
    agg = spread.groupBy(*keys, "tau", "beta").agg(
        F.regr_slope(F.col("_y"), e).alias("a0"), F.regr_intercept(F.col("_y"), e).alias("b0"),
        F.regr_syy(F.col("_y"), e).alias("_syy"), F.regr_sxy(F.col("_y"), e).alias("_sxy"), F.count(F.lit(1)).alias("n"),
    )
    rss = F.coalesce(F.col("_syy") - F.col("a0") * F.col("_sxy"), F.lit(float("inf")))
    item = F.struct("tau", "beta", "a0", "b0", rss.alias("rss"), "n")
    best = agg.groupBy(*keys).agg(F.min_by(item, F.struct(rss, F.col("tau"), F.col("beta"))).alias("_b"))
    return best.select(*keys, F.col("_b.tau").alias("tau0"), F.col("_b.beta").alias("beta0"), F.col("_b.a0").alias("a0"),
                       F.col("_b.b0").alias("b0"), F.greatest(F.col("_b.rss"), F.lit(0.0)).alias("rss"), F.col("_b.n").alias("n"))


def _log_steps(lo: Column, hi: Column, count: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.pow(F.lit(10.0), lo + (hi - lo) * i / float(count - 1))
    )


def grid_fit(
    df: DataFrame, keys: Sequence[str], t: str, y: str, model: str = "exp", points: int = 31, rounds: int | None = None, fine: int = 13,
    betas: Sequence[float] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0), low: float | None = None, high: float | None = None, tolerance: float = 1e-4,
) -> DataFrame:
    """One-term fit (exp, power, stretch_exp) by refined candidate grids.

    The first grid spans the mean step / 10 to ten times the duration; each
    round zooms in between the neighbours of the best candidate of every key
    whose grid is still wider than `tolerance` decades. `rounds` ends it
    early; `converged` says whether the tolerance was reached.
    """
    keys = list(keys)
    x = F.col(t).cast("double")
    span = df.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    span = span.where((F.col("_hi") > F.col("_lo")) & (F.col("_n") >= 3))
    width = F.col("_hi") - F.col("_lo")
    if model == "power":
        a, b = F.lit(np.log10(low or 1e-3)), F.lit(np.log10(high or 10.0))
    else:
        a = F.lit(np.log10(low)) if low else F.log10(width / F.col("_n") / 10)
        b = F.lit(np.log10(high)) if high else F.log10(width * 10)
    use_beta = list(betas) if model == "stretch_exp" else [1.0]
    pair = lambda taus, bs: F.flatten(
        F.transform(taus, lambda tau: F.transform(bs, lambda be: F.struct(tau.alias("tau"), be.alias("beta"))))
    )
    span = span.withColumn("_a", a).withColumn("_step", (b - a) / (points - 1))
    cands = span.select(*keys, pair(_log_steps(F.col("_a"), F.col("_a") + F.col("_step") * (points - 1), points),
                                    F.array(*[F.lit(float(v)) for v in use_beta])).alias("cands"))
    bstep = (use_beta[1] - use_beta[0]) if len(use_beta) > 1 else 0.0

    def zoomed(open_: DataFrame, shrink: float) -> DataFrame:
        c, s = F.log10("tau0"), F.col("_step")
        bs = F.array(F.lit(1.0))
        if len(use_beta) > 1:
            bs = F.transform(F.array(*[F.lit(v) for v in (-1.0, -0.5, 0.0, 0.5, 1.0)]), lambda k: F.least(F.greatest(F.col("beta0") + k * bstep * shrink, F.lit(0.01)), F.lit(1.0)))
        got = grid_round(df, keys, t, y, open_.select(*keys, pair(_log_steps(c - s, c + s, fine), F.array_distinct(bs)).alias("cands")), model)
        return attach(got, open_.select(*keys, (s * 2.0 / (fine - 1)).alias("_step")), keys)

    first = attach(grid_round(df, keys, t, y, cands, model), span.select(*keys, "_step"), keys)
    return _refine(first, lambda open_, r: zoomed(open_, (2.0 / (fine - 1)) ** r), tolerance, rounds)


def _refine(state: DataFrame, zoom: Callable[[DataFrame, int], DataFrame], tolerance: float, rounds: int | None) -> DataFrame:
    """Rounds of `zoom` on the keys whose `_step` is above the tolerance; adds rounds and converged."""
    open_ = cut_lineage(state.withColumn("rounds", F.lit(0)))
    done, r = [], 0
    wide = F.col("_step") > tolerance
    while (rounds is None or r < rounds) and not open_.where(wide).isEmpty():
        done.append(open_.where(~wide))
        open_ = cut_lineage(zoom(open_.where(wide), r).withColumn("rounds", F.lit(r + 1)))
        r += 1
    out = reduce(DataFrame.unionByName, [*done, open_])
    return out.withColumn("converged", ~wide).drop("_step")


def double_grid_fit(df: DataFrame, keys: Sequence[str], t: str, y: str, points: int = 12, rounds: int | None = None, tolerance: float = 1e-3) -> DataFrame:
    """Two exponentials with offset: pairs of time constants as candidates.

    For each pair the 3x3 normal equations follow from centred sums. Rounds
    as in `grid_fit`.
    """
    keys = list(keys)
    x = F.col(t).cast("double")
    span = df.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    span = span.where((F.col("_hi") > F.col("_lo")) & (F.col("_n") >= 5))
    width = F.col("_hi") - F.col("_lo")
    span = span.withColumn("_a", F.log10(width / F.col("_n"))).withColumn("_z", F.log10(width * 5))
    span = span.withColumn("_step", (F.col("_z") - F.col("_a")) / (points - 1))

    def pairs(first: Column, second: Column) -> Column:
        both = F.flatten(F.transform(first, lambda p: F.transform(second, lambda q: F.struct(p.alias("t1"), q.alias("t2")))))
        return F.filter(both, lambda s: s["t1"] < s["t2"] * 0.999)

    rows = df.select(*keys, x.alias("_t"), F.col(y).cast("double").alias("_y")).where(F.col("_t").isNotNull() & F.col("_y").isNotNull())
    grid = _log_steps(F.col("_a"), F.col("_z"), points)

    def best_of(cands: DataFrame) -> DataFrame:
        sp = attach(rows, cands, keys, "inner").select(*keys, "_t", "_y", F.explode("cands").alias("_c")).select(*keys, "_t", "_y", "_c.t1", "_c.t2")
        e1, e2, v = F.exp(-F.col("_t") / F.col("t1")), F.exp(-F.col("_t") / F.col("t2")), F.col("_y")
        agg = sp.groupBy(*keys, "t1", "t2").agg(
            F.count(F.lit(1)).alias("n"), F.avg(e1).alias("m1"), F.avg(e2).alias("m2"), F.avg(v).alias("my"),
            F.regr_sxx(e1, e1).alias("s11"), F.regr_sxx(e2, e2).alias("s22"), F.regr_sxy(e1, e2).alias("s12"),
            F.regr_sxy(v, e1).alias("y1"), F.regr_sxy(v, e2).alias("y2"), F.regr_syy(v, v).alias("yy"),
        )
        det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
        det = F.when(det > 1e-12 * F.col("s11") * F.col("s22"), det)
        a1 = F.try_divide(F.col("y1") * F.col("s22") - F.col("y2") * F.col("s12"), det)
        a2 = F.try_divide(F.col("y2") * F.col("s11") - F.col("y1") * F.col("s12"), det)
        rss = F.coalesce(F.greatest(F.col("yy") - a1 * F.col("y1") - a2 * F.col("y2"), F.lit(0.0)), F.lit(float("inf")))
        item = F.struct(a1.alias("a0"), F.col("t1").alias("tau0"), a2.alias("a1"), F.col("t2").alias("tau1"),
                        (F.col("my") - a1 * F.col("m1") - a2 * F.col("m2")).alias("b0"), rss.alias("rss"), "n")
        return agg.groupBy(*keys).agg(F.min_by(item, F.struct(rss, "t1", "t2")).alias("_b")).select(*keys, "_b.*")

    def zoomed(open_: DataFrame, r: int) -> DataFrame:
        s = F.col("_step")
        cands = open_.select(*keys, pairs(_log_steps(F.log10("tau0") - s, F.log10("tau0") + s, 7), _log_steps(F.log10("tau1") - s, F.log10("tau1") + s, 7)).alias("cands"))
        return attach(best_of(cands), open_.select(*keys, (s / 3.0).alias("_step")), keys)

    first = attach(best_of(span.select(*keys, pairs(grid, grid).alias("cands"))), span.select(*keys, "_step"), keys)
    return _refine(first.where(F.col("a0").isNotNull()), zoomed, tolerance, rounds).where(F.col("a0").isNotNull())


# --- polish --------------------------------------------------------------------

def time_weights(df: DataFrame, keys: Sequence[str], t: str, inflect: float, name: str = "weight") -> DataFrame:
    """Weight profile over the normalised time of each segment."""
    rows = with_group(df, keys, F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.count(F.lit(1)).alias("_n"))
    x = F.try_divide(F.col(t) - F.col("_t0"), F.col("_t1") - F.col("_t0"))
    tiny = F.try_divide(F.lit(1e-8), F.col("_n") - 1)
    if abs(inflect) == 1.0:
        w = 1 - x
    elif inflect != 0.0:
        v = 2 * x - abs(inflect)
        v = F.when(v == 0, tiny).otherwise(v)
        w = F.when(v < 0, v / F.lit(-abs(inflect))).otherwise(v / F.lit(2 - abs(inflect)))
    else:
        w = x
    if inflect >= 0:
        w = 1 - w
    return rows.withColumn(name, F.when(w == 0, tiny).otherwise(w)).drop("_t0", "_t1", "_n")


def _derivatives(f: Callable, t: Column, params: Sequence[Column]) -> list[Column]:
    out = []
    for k, p in enumerate(params):
        h = F.greatest(F.abs(p) * 1e-6, F.lit(1e-14))
        up = [p + h if j == k else q for j, q in enumerate(params)]
        down = [p - h if j == k else q for j, q in enumerate(params)]
        out.append((f(t, *up) - f(t, *down)) / (2 * h))
    return out


# Loss of a squared residual z and its derivative, which weights the row.
LOSSES: dict[str, Callable[[Column], tuple[Column, Column]]] = {
    "linear": lambda z: (z, F.lit(1.0)),
    "cauchy": lambda z: (F.log1p(z), 1 / (1 + z)),
    "soft_l1": lambda z: (2 * (F.sqrt(1 + z) - 1), 1 / F.sqrt(1 + z)),
    "huber": lambda z: (F.when(z <= 1, z).otherwise(2 * F.sqrt(z) - 1), F.when(z <= 1, 1.0).otherwise(1 / F.sqrt(z))),
    "arctan": lambda z: (F.atan(z), 1 / (1 + z * z)),
}


def normal_equations(df: DataFrame, keys: Sequence[str], t: str, y: str, model, params: DataFrame, weight: str | None = None, loss="linear") -> DataFrame:
    """Aggregated JtWJ (upper triangle), JtWr, cost and rows per key.

    `params` has (keys, p array<double>). `loss` is a name of LOSSES or a
    function of the same kind.
    """
    f, names = model_of(model)
    rows = attach(df.select(*keys, F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y"),
                            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")), params.select(*keys, "p"), keys, "inner")
    ps = [F.get("p", F.lit(k)) for k in range(len(names))]
    jac = _derivatives(f, F.col("_t"), ps)
    cols = rows.where(F.col("_y").isNotNull() & F.col("_t").isNotNull()).select(
        *keys, "_w", (F.col("_y") - f(F.col("_t"), *ps)).alias("_r"), *[j.alias(f"_j{k}") for k, j in enumerate(jac)]
    )
    r = F.col("_r") * F.col("_w")
    cost, robust = (LOSSES[loss] if isinstance(loss, str) else loss)(r * r)
    w = F.col("_w") * F.col("_w") * robust
    k = len(names)
    aggs = [F.sum(w * F.col(f"_j{a}") * F.col(f"_j{b}")) for a in range(k) for b in range(a, k)]
    grads = [F.sum(w * F.col(f"_j{a}") * F.col("_r")) for a in range(k)]
    return cols.groupBy(*keys).agg(
        F.array(*aggs).alias("jtj"), F.array(*grads).alias("jtr"), F.sum(cost).alias("cost"),
        F.sum(F.col("_r") * F.col("_r")).alias("rss"), F.count(F.lit(1)).alias("n"),
    )


def _square(flat: np.ndarray, k: int) -> np.ndarray:
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = flat
    return a + np.triu(a, 1).T


def _rounds_as_jobs(df: DataFrame, keys: list[str], t: str, y: str, model, state: DataFrame, weight: str | None, loss, update: Callable, schema: str, most: int) -> DataFrame:
    """The rounds of `gauss_newton`, each one aggregation over all rows of the open segments."""
    closed: list[DataFrame] = []
    for _ in range(most):
        eq = normal_equations(df, keys, t, y, model, state, weight, loss)
        # Plans grow by one scan per round; materialise the small state table.
        moved = cut_to_files(attach(state, eq, keys).mapInPandas(update, schema))
        left = moved.agg(F.count(F.when(F.col("open"), 1)), F.count(F.when(~F.col("open"), 1))).first()
        state = moved.where("open")
        if left[1]:
            closed.append(moved.where("NOT open"))
            if len(closed) > 16:
                closed = [cut_lineage(reduce(DataFrame.unionByName, closed))]
        if not left[0]:
            break
    return reduce(DataFrame.unionByName, [*closed, state])


# The named models for arrays.
def _decayed(t: np.ndarray, tau: np.ndarray) -> np.ndarray:
    return np.exp(-t / np.where(tau == 0, units.TAU_GUARD, tau))


CURVES: dict[str, Callable] = {
    "linear": lambda t, a, b: a * t + b,
    "power": lambda t, a, tau, b: a * np.power(np.where(t == 0, units.TAU_GUARD, t), -tau) + b,
    "exp": lambda t, a, tau, b: a * _decayed(t, tau) + b,
    "double_exp": lambda t, a, tau, c, late, b: a * _decayed(t, tau) + c * _decayed(t, late) + b,
    "stretch_exp": lambda t, a, tau, beta, b: a * np.exp(-np.power(t / np.where(tau == 0, units.TAU_GUARD, tau), beta)) + b,
}
CHUNK_POINTS = 100_000


def combined_points(df: DataFrame, keys: Sequence[str], t: str, y: str, weight: str | None) -> DataFrame:
    """Rows of equal time and weight as one point: their number, mean and sum of squares about it.

    A sum of squared residuals of the rows follows from these exactly.
    """
    rows = df.select(*keys, F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    rows = rows.where(F.col("_y").isNotNull() & F.col("_t").isNotNull() & F.col("_w").isNotNull())
    return rows.groupBy(*keys, "_t", "_w").agg(
        F.count(F.lit(1)).alias("_m"), F.avg("_y").alias("_y"), (F.var_pop("_y") * F.count(F.lit(1))).alias("_sq"))


def rounds_in_tasks(points: DataFrame, state: DataFrame, keys: list[str], fields: Sequence[str], schema: str, curve: Callable, k: int, most: int, ftol: float, xtol: float) -> DataFrame:
    """The rounds of `gauss_newton` for segments whose points fit into a task.

    The points of a segment come sorted behind its line of the state table.
    A task reads them in chunks of whole segments and moves all open segments
    of a chunk by one round at a time.
    """
    data = ["_t", "_w", "_m", "_y", "_sq"]
    lines = state.select(*keys, "p", "lb", "ub", F.lit(0).alias("_kind"))
    both = lines.unionByName(points.select(*keys, *data, F.lit(1).alias("_kind")), allowMissingColumns=True)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def starts_of(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        for c in keys:
            now, last = pdf[c], pdf[c].shift()
            new |= ((now != last) & ~(now.isna() & last.isna())).to_numpy(bool)
        new[:1] = True
        return np.flatnonzero(new)

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        at = starts_of(pdf)
        known = pdf["_kind"].to_numpy()[at] == 0
        sizes = np.diff(np.append(at, len(pdf)))
        pdf, heads, sizes = pdf[np.repeat(known, sizes)], pdf.iloc[at[known]], sizes[known] - 1
        t, w, m, y, sq = (pdf.loc[pdf["_kind"] == 1, c].to_numpy(float) for c in data)
        m0, m1 = w * w * m, w * w * sq
        n = len(heads)
        p, lb, ub = (np.array([np.asarray(v, float) for v in heads[c]]).reshape(n, k) for c in ("p", "lb", "ub"))
        best, damp, rounds = p.copy(), np.full(n, 1e-3), np.zeros(n, int)
        best_cost, best_rss, count = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n, int)
        a, g = np.full((n, k, k), np.nan), np.full((n, k), np.nan)
        open_, converged = np.ones(n, bool), np.zeros(n, bool)
        for _ in range(most):
            now = np.flatnonzero(open_)
            if not len(now):
                break
            rounds[now] += 1
            full = now[sizes[now] > 0]
            cost, rss, jtj, jtr = np.full(n, np.nan), np.full(n, np.nan), np.full((n, k, k), np.nan), np.full((n, k), np.nan)
            if len(full):
                use = np.repeat(np.isin(np.arange(n), full), sizes)
                first = np.append(0, np.cumsum(sizes[full])[:-1])
                total = lambda v: np.add.reduceat(v, first)
                x, ps = t[use], [np.repeat(p[full, j], sizes[full]) for j in range(k)]
                r = y[use] - curve(x, *ps)
                jac = []
                for j in range(k):
                    h = np.maximum(np.abs(ps[j]) * 1e-6, 1e-14)
                    up, down = [*ps], [*ps]
                    up[j], down[j] = ps[j] + h, ps[j] - h
                    jac.append((curve(x, *up) - curve(x, *down)) / (2 * h))
                mw = m0[use]
                cost[full], rss[full] = total(mw * r * r + m1[use]), total(m[use] * r * r + sq[use])
                for i, j in pairs:
                    jtj[full, i, j] = jtj[full, j, i] = total(mw * jac[i] * jac[j])
                for j in range(k):
                    jtr[full, j] = total(mw * jac[j] * r)
                rows = total(m[use])
            gain = np.isfinite(cost) & (cost < best_cost) & open_
            done = gain & ((np.isfinite(best_cost) & (best_cost - cost <= ftol * np.maximum(cost, 1e-300))) | (cost == 0))
            best[gain], best_cost[gain], best_rss[gain], a[gain], g[gain] = p[gain], cost[gain], rss[gain], jtj[gain], jtr[gain]
            if len(full):
                count[full] = np.where(gain[full], rows, count[full])
            damp = np.where(gain, np.maximum(damp / 6, 1e-12), np.where(open_, damp * 8, damp))
            done |= open_ & ~gain & (damp > 1e10)
            solid = np.isfinite(a).all((1, 2)) & np.isfinite(g).all(1)
            go = np.flatnonzero(open_ & solid & ~done)
            if len(go):
                d = np.einsum("nii->ni", a[go])
                lifted = a[go] + (damp[go, None] * np.where(d > 0, d, 1.0))[:, :, None] * np.eye(k)
                step = (np.linalg.pinv(lifted, rcond=np.finfo(float).eps * k) @ g[go][:, :, None])[:, :, 0]
                p[go] = np.clip(best[go] + step, lb[go], ub[go])
                done[go] = (np.abs(p[go] - best[go]) <= xtol * np.abs(best[go])).all(1)
            converged |= open_ & solid & done
            open_ &= solid & ~done
        out = heads[keys].reset_index(drop=True)
        upper = [[] if np.isinf(c) else [m_[i, j] for i, j in pairs] for c, m_ in zip(best_cost, a)]
        return out.assign(
            p=list(p), lb=list(lb), ub=list(ub), best=list(best), best_cost=best_cost, damp=damp, a=upper, g=[[] if np.isinf(c) else v for c, v in zip(best_cost, g)],
            best_rss=best_rss, rows=count, rounds=rounds, open=open_, converged=converged)[[*keys, *fields]]

    def run(batches):
        held = None
        with np.errstate(all="ignore"):
            for pdf in batches:
                held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                if len(held) >= CHUNK_POINTS:
                    cut = starts_of(held)[-1]
                    if cut:
                        yield solved(held.iloc[:cut])
                        held = held.iloc[cut:].reset_index(drop=True)
            if held is not None and len(held):
                yield solved(held)

    return cut_lineage(both.repartition(*keys).sortWithinPartitions(*keys, "_kind").mapInPandas(run, schema))


MOST_ROUNDS = 500


def gauss_newton(
    df: DataFrame, keys: Sequence[str], t: str, y: str, model, start: DataFrame, iterations: int | None = None, weight: str | None = None,
    loss="linear", lower: str | None = None, upper: str | None = None, ftol: float = 1e-8, xtol: float = 1e-8,
) -> DataFrame:
    """Damped Gauss-Newton for all segments together.

    `start` has (keys, p array<double>) and optional bound arrays. Segments of
    a named model with the linear loss, whose distinct times are within the
    group limit, go through all rounds in one job (`rounds_in_tasks`). Else each
    round is one aggregation over the rows of the segments that are still open
    and a small solve per key on the state table. A segment is done when a round
    gains less than `ftol` of its cost, when its step is below `xtol` of the
    parameters, or when no step lowers the cost any more. Result: (keys, p,
    std, cost, rss, n, rounds, converged); segments that stay open for
    `iterations` rounds (at most MOST_ROUNDS) or have no finite cost are not
    converged.
    """
    keys = list(keys)
    _, names = model_of(model)
    k = len(names)
    types = dict(start.dtypes)
    inf = float("inf")
    state = start.select(
        *keys, F.col("p").cast("array<double>"),
        (F.col(lower) if lower else F.array(*[F.lit(-inf)] * k)).cast("array<double>").alias("lb"),
        (F.col(upper) if upper else F.array(*[F.lit(inf)] * k)).cast("array<double>").alias("ub"),
        F.col("p").cast("array<double>").alias("best"), F.lit(inf).alias("best_cost"), F.lit(1e-3).alias("damp"),
        F.array().cast("array<double>").alias("a"), F.array().cast("array<double>").alias("g"),
        F.lit(inf).alias("best_rss"), F.lit(0).cast("long").alias("rows"), F.lit(0).alias("rounds"), F.lit(True).alias("open"), F.lit(False).alias("converged"),
    )
    fields = ["p", "lb", "ub", "best", "best_cost", "damp", "a", "g", "best_rss", "rows", "rounds", "open", "converged"]
    schema = "".join(f"`{c}` {types[c]}, " for c in keys) + (
        "p array<double>, lb array<double>, ub array<double>, best array<double>, best_cost double, damp double, "
        "a array<double>, g array<double>, best_rss double, rows long, rounds int, open boolean, converged boolean"
    )

    def advance(row: dict) -> None:
        cost, before = row["cost"], row["best_cost"]
        row["rounds"] += 1
        done = False
        if cost is not None and np.isfinite(cost) and cost < before:
            done = np.isfinite(before) and before - cost <= ftol * max(cost, 1e-300) or cost == 0
            row.update(best=row["p"], best_cost=cost, a=row["jtj"], g=row["jtr"], best_rss=row["rss"], rows=row["n"], damp=max(row["damp"] / 6, 1e-12))
        else:
            row["damp"] *= 8
            done = row["damp"] > 1e10
        best = np.asarray(row["best"], float)
        solid = len(row["a"]) and np.all(np.isfinite(row["a"])) and np.all(np.isfinite(row["g"]))
        if solid and not done:
            a = _square(np.asarray(row["a"], float), k)
            d = np.where(np.diag(a) > 0, np.diag(a), 1.0)
            step = np.linalg.lstsq(a + row["damp"] * np.diag(d), np.asarray(row["g"], float), rcond=None)[0]
            row["p"] = np.clip(best + step, row["lb"], row["ub"])
            done = bool(np.all(np.abs(row["p"] - best) <= xtol * np.abs(best)))
        row["open"] = bool(solid and not done)
        row["converged"] = bool(solid and done)

    def update(batches):
        for pdf in batches:
            new = []
            for row in pdf.to_dict("records"):
                advance(row)
                new.append({c: row[c] for c in [*keys, *fields]})
            yield pd.DataFrame(new, columns=[*keys, *fields])

    most = MOST_ROUNDS if iterations is None else iterations
    points = combined_points(df, keys, t, y, weight) if isinstance(model, str) and model in CURVES and loss == "linear" else None
    if points is not None and not has_hot_group(points, keys):
        state = rounds_in_tasks(points, state, keys, fields, schema, CURVES[model], k, most, ftol, xtol)
    else:
        state = _rounds_as_jobs(df, keys, t, y, model, state, weight, loss, update, schema, most)

    def finish(batches):
        for pdf in batches:
            stds = []
            for row in pdf.to_dict("records"):
                if not len(row["a"]):
                    stds.append([float("nan")] * k)
                    continue
                inv = np.linalg.pinv(_square(np.asarray(row["a"], float), k))
                s2 = row["best_rss"] / max(row["rows"], 1)
                stds.append(np.sqrt(np.maximum(np.diag(inv) * s2, 0)).tolist())
            out = pdf[[*keys]].copy()
            out["p"], out["std"] = pdf["best"], stds
            out["cost"], out["rss"], out["n"] = pdf["best_cost"], pdf["best_rss"], pdf["rows"]
            out["rounds"], out["converged"] = pdf["rounds"], pdf["converged"]
            yield out

    tail = "".join(f"`{c}` {types[c]}, " for c in keys) + "p array<double>, std array<double>, cost double, rss double, n long, rounds int, converged boolean"
    return state.mapInPandas(finish, tail)


def fitted(df: DataFrame, keys: Sequence[str], t: str, model, params: DataFrame, name: str = "fit") -> DataFrame:
    """Rows with the model value of their segment."""
    f, names = model_of(model)
    rows = attach(df, params.select(*keys, F.col("p").alias("_p")), keys)
    return rows.withColumn(name, f(F.col(t).cast("double"), *[F.get("_p", F.lit(k)) for k in range(len(names))])).drop("_p")


def curve_error(df: DataFrame, keys: Sequence[str], t: str, y: str, model, params: DataFrame, metric="mean_abs_perc_err", weight: str | None = None) -> DataFrame:
    """Error of every segment by a named metric, or by a function of (measured, fitted, weight) that gives an aggregate."""
    rows = fitted(df, keys, t, model, params, "_fit").where(F.col("_fit").isNotNull())
    if callable(metric):
        return rows.groupBy(*keys).agg(metric(F.col(y), F.col("_fit"), F.col(weight) if weight else F.lit(1.0)).alias("error"))
    return error_metrics(rows, keys, y, "_fit", weight, [metric]).withColumnRenamed(metric, "error")


def fit_curves(
    df: DataFrame, keys: Sequence[str], t: str, y: str, model: str = "exp", prior: DataFrame | None = None, start: DataFrame | None = None,
    iterations: int | None = None, loss="linear", metric="mean_abs_perc_err", weight: str | None = None, retain_best: bool = True, weight_inflect: float | None = None,
) -> DataFrame:
    """Fit every segment and keep the better of start, result and prior.

    Output (keys, p, std, error, rounds, converged, change, updated):
    `change` is the percent gain over the prior error, within +-100; rounds
    and converged are those of `gauss_newton`. Loss and metric may be names or
    functions. `weight_inflect` gives the weights of `time_weights`.
    """
    if weight_inflect is not None:
        df, weight = time_weights(df, keys, t, max(-1.0, min(1.0, weight_inflect)), "_tw"), "_tw"
    keys = list(keys)
    _, names = model_of(model)
    if start is None:
        if model in ("exp", "power", "stretch_exp"):
            grid = grid_fit(df, keys, t, y, model, tolerance=1e-2)
        elif model == "double_exp":
            grid = double_grid_fit(df, keys, t, y, tolerance=1e-2)
        else:
            grid = GUESSES[model](df, keys, t, y)
        start = grid.select(*keys, F.array(*[F.col(n) for n in names]).alias("p"))
    start = cut_lineage(start)
    result = gauss_newton(df, keys, t, y, model, start, iterations, weight, loss)
    if model == "double_exp":
        swap = F.get("p", F.lit(1)) > F.get("p", F.lit(3))
        for c in ("p", "std"):
            g = [F.get(c, F.lit(k)) for k in range(5)]
            result = result.withColumn(f"_{c}", F.when(swap, F.array(g[2], g[3], g[0], g[1], g[4])).otherwise(F.col(c)))
        result = result.withColumn("p", F.col("_p")).withColumn("std", F.col("_std")).drop("_p", "_std")
    after = curve_error(df, keys, t, y, model, result, metric, weight).withColumnRenamed("error", "_after")
    before = curve_error(df, keys, t, y, model, start, metric, weight).withColumnRenamed("error", "_before")
    out = attach(attach(result, after, keys), before, keys)
    out = attach(out, start.select(*keys, F.col("p").alias("_p0")), keys)
    worse = F.coalesce(F.col("_before") < F.col("_after"), F.lit(False))
    out = out.select(
        *keys, F.when(worse, F.col("_p0")).otherwise(F.col("p")).alias("p"),
        F.when(worse, F.transform("std", lambda s: F.lit(1.0))).otherwise(F.col("std")).alias("std"),
        F.least("_after", "_before").alias("error"), "rounds", "converged",
    )
    if prior is None:
        return out.withColumn("change", F.lit(0.0)).withColumn("updated", F.lit(True))
    old = prior.select(*keys, F.col("p").alias("_op"), F.col("std").alias("_os"), F.col("error").alias("_oe"))
    both = attach(out, old, keys)
    gain = F.when(F.coalesce(F.col("_oe"), F.lit(0.0)) == 0, 0.0).otherwise(F.try_divide(F.col("_oe") - F.col("error"), F.col("_oe")) * 100)
    change = F.least(F.greatest(gain, F.lit(-100.0)), F.lit(100.0))
    take = F.lit(not retain_best) | (change >= 0) | F.col("_op").isNull()
    return both.select(
        *keys, F.when(take, F.col("p")).otherwise(F.col("_op")).alias("p"), F.when(take, F.col("std")).otherwise(F.col("_os")).alias("std"),
        F.when(take, F.col("error")).otherwise(F.col("_oe")).alias("error"), "rounds", "converged", change.alias("change"), take.alias("updated"),
    )


def params_to_long(fits: DataFrame, keys: Sequence[str], names: Sequence[str], fit_no: int = 0, channel: str = "") -> DataFrame:
    """Fit arrays as rows (keys, fit_no, channel, param, value, std, error)."""
    items = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("param"), F.col("p").alias("value"), F.col("std").alias("std"))
    return fits.select(*keys, F.lit(fit_no).alias("fit_no"), F.lit(channel).alias("channel"), F.explode(items).alias("_x"), "error").select(
        *keys, "fit_no", "channel", F.col("_x.param").alias("param"), F.col("_x.value").alias("value"), F.col("_x.std").alias("std"), "error"
    )


# --- preparation and jobs --------------------------------------------------------

def prepare_bounds(
    guesses: DataFrame, keys: Sequence[str], names: Sequence[str], rules: DataFrame | None = None, prior: DataFrame | None = None,
    scale: str = "linear", factor: float = 10.0, constants: Sequence[str] = (),
) -> DataFrame:
    """Bounds and start of every parameter: rules, then prior fits, then guesses.

    `rules` has (param, lb, p0, ub) with `*` for all parameters; `prior` has
    (keys, param, value). Missing bounds are value / factor and value *
    factor, tau is unbounded downwards over its decades, beta lies in (0, 1].
    Constants are pinned to a few spacings.
    """
    keys = list(keys)
    items = F.array(*[F.struct(F.lit(n).alias("param"), F.col(n).cast("double").alias("guess")) for n in names])
    long = guesses.select(*keys, F.explode(items).alias("_x")).select(*keys, "_x.*")
    if rules is not None:
        # The rule table has one line per parameter name at most.
        star = rules.where(F.col("param") == "*").select(*[F.col(c).alias(f"_s_{c}") for c in ("lb", "p0", "ub")]).groupBy().agg(
            *[F.first(f"_s_{c}").alias(f"_s_{c}") for c in ("lb", "p0", "ub")])
        long = attach(attach(long, rules.select("param", *[F.col(c).alias(f"_r_{c}") for c in ("lb", "p0", "ub")]), ["param"]), star, [])
        for c in ("lb", "p0", "ub"):
            long = long.withColumn(f"_r_{c}", F.coalesce(f"_s_{c}", f"_r_{c}").cast("double")).drop(f"_s_{c}")
    else:
        for c in ("lb", "p0", "ub"):
            long = long.withColumn(f"_r_{c}", F.lit(None).cast("double"))
    if prior is not None:
        long = attach(long, prior.select(*keys, "param", F.col("value").alias("_prior")), [*keys, "param"])
    else:
        long = long.withColumn("_prior", F.lit(None).cast("double"))
    p0 = F.coalesce("_r_p0", "_prior", "guess")
    sign = F.signum(p0)
    lb, ub = F.col("_r_lb"), F.col("_r_ub")
    wrong = F.coalesce(F.signum(lb) != sign, F.lit(False)) | F.coalesce(F.signum(ub) != sign, F.lit(False))
    low, high = F.when(wrong, F.abs(ub) * sign).otherwise(lb), F.when(wrong, F.abs(lb) * sign).otherwise(ub)
    is_tau, is_beta = F.col("param").startswith("tau"), F.col("param").startswith("beta")
    low = F.coalesce(low, F.when(is_beta, 1e-32).when(is_tau, F.greatest(p0 * 1e-6, F.lit(1e-32))).otherwise(F.least(p0 / factor, p0 * factor)))
    high = F.coalesce(high, F.when(is_beta, 1.0).when(is_tau, p0 * F.lit(factor)).otherwise(F.greatest(p0 / factor, p0 * factor)))
    lo, val, hi = ordered_bounds(low, p0, high, multiply=False)
    out = long.select(*keys, "param", lo.alias("lb"), val.alias("p0"), hi.alias("ub"), F.lit(scale).alias("scale"))
    if constants:
        pin = F.col("param").isin(*constants)
        tight = F.greatest(F.abs("p0") * 1e-13, F.lit(5e-324))
        out = out.withColumn("lb", F.when(pin, F.col("p0") - tight).otherwise(F.col("lb"))).withColumn(
            "ub", F.when(pin, F.col("p0") + tight).otherwise(F.col("ub")))
    return out


def bounds_to_start(bounds: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    pick = lambda c: F.array(*[F.max(F.when(F.col("param") == n, F.col(c))) for n in names])
    return bounds.groupBy(*keys).agg(pick("p0").alias("p"), pick("lb").alias("lb"), pick("ub").alias("ub"))


def run_fit_jobs(
    segments: DataFrame, keys: Sequence[str], t: str, y: str, jobs: Sequence[dict], group: Sequence[str] = (), factor: float = 0.5,
) -> DataFrame:
    """A sequence of fits, each on the targets left by the one before.

    A job is {model, targets (expression on error/p0.. columns), bias,
    iterations, loss, metric}. The prior result is pulled towards its group before
    the refit, only target segments are fitted again, and the better result
    stays. Output rows carry the number of the job that set them.
    """
    keys = list(keys)
    current: DataFrame | None = None
    for no, job in enumerate(jobs):
        model = job.get("model", "exp")
        _, names = model_of(model)
        same = current is not None and current.schema["p"].dataType is not None and job.get("refine", True)
        if current is None or not same:
            got = fit_curves(segments, keys, t, y, model, iterations=job.get("iterations"), loss=job.get("loss", "linear"), metric=job.get("metric", "mean_abs_perc_err"))
            current = cut_lineage(got.withColumn("fit_no", F.lit(no)))
            continue
        wide = current.select(*keys, "error", *[F.get("p", F.lit(k)).alias(n) for k, n in enumerate(names)])
        targets = target_rows(wide, job.get("targets", "=="))
        start = targets
        if group and job.get("bias", 0.0):
            start = bias_to_group(targets, group, names, job["bias"], job.get("method", "mean"))
        start = start.select(*keys, F.array(*[F.col(n) for n in names]).alias("p"))
        todo = attach(segments, targets.select(*keys), keys, "left_semi")
        got = fit_curves(todo, keys, t, y, model, prior=current, start=start, iterations=job.get("iterations"), loss=job.get("loss", "linear"), metric=job.get("metric", "mean_abs_perc_err"))
        got = got.withColumn("fit_no", F.when(F.col("updated"), no).otherwise(no - 1))
        kept = attach(current, targets.select(*keys), keys, "left_anti")
        current = cut_lineage(kept.unionByName(got, allowMissingColumns=True))
    return current


# --- confidence ------------------------------------------------------------------

def confidence_band(df: DataFrame, keys: Sequence[str], t: str, y: str, model, params: DataFrame, level: float = 0.95) -> DataFrame:
    """Delta-method band of fitted curves with a t-quantile.

    The normal matrix is an aggregate; its inverse is taken on the parameter
    table; rows then need only their own derivatives.
    """
    keys = list(keys)
    f, names = model_of(model)
    k = len(names)
    eq = attach(normal_equations(df, keys, t, y, model, params), params.select(*keys, "p"), keys)
    types = dict(eq.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in keys) + "p array<double>, cov array<double>, s double, q double"

    def invert(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                a = _square(np.asarray(row["jtj"], float), k)
                cond = np.linalg.cond(a) if np.all(np.isfinite(a)) else np.inf
                if np.isfinite(cond) and cond >= 1e12:
                    a = a + np.eye(k) * cond / 10 ** int(np.floor(np.log10(cond)))
                cov = np.linalg.pinv(a) if np.all(np.isfinite(a)) else np.full((k, k), np.nan)
                dof = max(row["n"] - k, 1)
                out.append({**{c: row[c] for c in keys}, "p": row["p"], "cov": cov.ravel().tolist(),
                            "s": float(np.sqrt(row["rss"] / dof)), "q": t_quantile(1 - (1 - level) / 2, dof)})
            yield pd.DataFrame(out, columns=[*keys, "p", "cov", "s", "q"])

    rows = attach(df, eq.mapInPandas(invert, schema), keys)
    ps = [F.get("p", F.lit(j)) for j in range(k)]
    x = F.col(t).cast("double")
    rows = rows.select("*", f(x, *ps).alias("fit"), *[d.alias(f"_j{j}") for j, d in enumerate(_derivatives(f, x, ps))])
    var = reduce(lambda a, b: a + b, [
        F.col(f"_j{a}") * F.get("cov", F.lit(a * k + b)) * F.col(f"_j{b}") for a in range(k) for b in range(k)
    ])
    half = F.col("q") * F.col("s") * F.sqrt(F.greatest(var, F.lit(0.0)))
    return rows.select(*df.columns, "fit", (F.col("fit") - half).alias("low"), (F.col("fit") + half).alias("high"))


def bootstrap_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], replicates: int, seed: int = 7) -> DataFrame:
    """Resamples with replacement, same size per key and replicate.

    Draw j of replicate b takes position hash(seed, b, j) mod n: positions are
    joined by equality, so no group is gathered in one place.
    """
    rows = Ordered(df, keys, order).positions("_i", "_n")
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    draws = rows.select(*keys, F.col("_i").alias("draw"), "_n", reps.alias("replicate"))
    draws = draws.withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), "replicate", "draw"), F.col("_n"))).drop("_n")
    return attach(draws, rows.drop("_n"), [*keys, "_i"], "inner").drop("_i")
