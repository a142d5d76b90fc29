"""Closed-form regressions as aggregates: line, exponential, Arrhenius."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.functions.ieee import finite, log10
from galvanite.keyed import Ordered, attach, with_few, with_group
from galvanite.operators.metrics import aicc

# Boltzmann constant in eV/K, zero of the Celsius scale in K,
# largest exponent, stand-in for a zero reading, the default fixed
# activation energy (eV) of the current offset.
BOLTZMANN_EV = 8.617333262145e-5
ZERO_CELSIUS = 273.15
MAX_EXPONENT = 700.0
MIN_READING = 1e-32
FIXED_EA = 0.5914


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _line(
    x: Column, y: Column, w: Column | None, slope: Column | float | None, intercept: Column | float | None
) -> tuple[Column, Column]:
    """Aggregate columns (slope, intercept); weights multiply residuals."""
    if slope is not None:
        m = slope if isinstance(slope, Column) else F.lit(float(slope))
        return F.max(m), F.avg(y - m * x)
    if intercept is not None:
        b = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
        return F.avg(F.try_divide(y - b, x)), F.max(b)
    if w is None:
        return F.regr_slope(y, x), F.regr_intercept(y, x)
    q = w * w
    s, sx, sy = F.sum(q), F.sum(q * x), F.sum(q * y)
    m = F.try_divide(s * F.sum(q * x * y) - sx * sy, s * F.sum(q * x * x) - sx * sx)
    return m, F.try_divide(sy - m * sx, s)


def linear_fit(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    weight: str | None = None,
    slope: float | Column | None = None,
    intercept: float | Column | None = None,
) -> DataFrame:
    """y = m x + b per key, with R2, residual sum and AICc; one pass.

    The residual sum follows from the centred second moments, so no second
    scan is needed whatever m and b are.
    """
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    ok = _finite(xs) & _finite(ys)
    xs, ys = F.when(ok, xs), F.when(ok, ys)
    w = F.when(ok, F.col(weight).cast("double")) if weight else None
    m, b = _line(xs, ys, w, slope, intercept)
    agg = df.groupBy(*keys).agg(
        F.count(xs).alias("n"),
        m.alias("m"),
        b.alias("b"),
        F.regr_sxx(ys, xs).alias("_sxx"),
        F.regr_sxy(ys, xs).alias("_sxy"),
        F.regr_syy(ys, xs).alias("_syy"),
        F.avg(xs).alias("_mx"),
        F.avg(ys).alias("_my"),
    )
    m, b = F.col("m"), F.col("b")
    off = F.col("_my") - m * F.col("_mx") - b
    raw = F.col("_syy") - 2 * m * F.col("_sxy") + m * m * F.col("_sxx") + F.col("n") * off * off
    agg = agg.withColumn("rss", F.greatest(raw, F.lit(0.0)))
    enough = F.col("n") >= 2
    return agg.select(
        *keys,
        "n",
        F.when(enough, m).alias("m"),
        F.when(enough, b).alias("b"),
        F.when(enough, 1 - F.try_divide(F.col("rss"), F.col("_syy"))).alias("r2"),
        F.when(enough, F.col("rss")).alias("rss"),
        F.when(enough, aicc(F.col("rss"), F.col("n"), 2)).alias("aicc"),
    )


def exponential_fit(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    weight: str | None = None,
    beta: float | Column | None = None,
    alpha: float | Column | None = None,
    sign: int = 1,
) -> DataFrame:
    """y = alpha exp(beta x) by a line through ln|y|; R2 on the original scale."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    ok = _finite(xs) & _finite(ys)
    # Unusable rows become nulls, so keys without any point stay in the result.
    rows = df.select(
        *keys,
        F.when(ok, xs).alias("_x"),
        F.when(ok, ys).alias("_y"),
        F.when(ok, F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
        (beta if isinstance(beta, Column) else F.lit(beta).cast("double")).alias("_beta"),
        F.log(F.abs(alpha if isinstance(alpha, Column) else F.lit(alpha).cast("double"))).alias("_lna"),
    )
    logged = F.log(F.when(F.col("_y") == 0, MIN_READING).otherwise(F.abs("_y")))
    free = _line(F.col("_x"), logged, F.col("_w") if weight else None, None, None)
    fixed_m = _line(F.col("_x"), logged, None, F.col("_beta"), None)
    fixed_b = _line(F.col("_x"), logged, None, None, F.col("_lna"))
    has_m, has_b = F.max("_beta").isNotNull(), F.max("_lna").isNotNull()
    fit = rows.groupBy(*keys).agg(
        F.count("_y").alias("n"),
        # The sign of the middle sign; an even split falls back to `sign`.
        F.when(F.sum((F.col("_y") < 0).cast("long")) * 2 > F.count("_y"), -1)
        .when(F.sum((F.col("_y") > 0).cast("long")) * 2 > F.count("_y"), 1)
        .otherwise(sign)
        .alias("_sign"),
        F.when(has_m, fixed_m[0]).when(has_b, fixed_b[0]).otherwise(free[0]).alias("beta"),
        F.when(has_m, fixed_m[1]).when(has_b, fixed_b[1]).otherwise(free[1]).alias("_ln"),
    )
    enough = F.col("n") >= 2
    alpha = F.col("_sign") * F.exp(F.when(F.col("_ln") > MAX_EXPONENT, MAX_EXPONENT).otherwise(F.col("_ln")))
    fit = fit.withColumn("alpha", F.when(enough, alpha)).withColumn("beta", F.when(enough, F.col("beta")))
    joined = attach(rows, fit, keys, "inner")
    value = F.when(F.col("_y") == 0, MIN_READING * F.col("_sign")).otherwise(F.col("_y"))
    err = value - exponential_value(F.col("_x"), F.col("alpha"), F.col("beta"))
    out = joined.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("alpha").alias("alpha"),
        F.max("beta").alias("beta"),
        F.sum(err * err).alias("rss"),
        F.regr_syy(value, value).alias("_syy"),
    )
    return out.select(
        *keys,
        "n",
        "alpha",
        "beta",
        (1 - F.try_divide(F.col("rss"), F.col("_syy"))).alias("r2"),
        "rss",
        aicc(F.col("rss"), F.col("n"), 2).alias("aicc"),
    )


def exponential_value(x: Column, alpha: Column, beta: Column) -> Column:
    power = beta * x
    return alpha * F.exp(F.when(power > MAX_EXPONENT, MAX_EXPONENT).otherwise(power))


def inverse_kelvin(temp: str, celsius: bool = True) -> Column:
    t = F.col(temp).cast("double")
    return F.try_divide(F.lit(1.0), t + ZERO_CELSIUS if celsius else t)


def arrhenius_fit(
    df: DataFrame,
    keys: Sequence[str],
    temp: str,
    y: str,
    weight: str | None = None,
    celsius: bool = True,
    ea: float | Column | None = None,
    a: float | Column | None = None,
    sign: int = 1,
) -> DataFrame:
    """y = A exp(-Ea / (kB T)): columns n, A, Ea (eV), r2, rss, aicc."""
    if ea is not None:
        ea = -(ea if isinstance(ea, Column) else F.lit(float(ea))) / BOLTZMANN_EV
    rows = df.withColumn("_inv", inverse_kelvin(temp, celsius))
    fit = exponential_fit(rows, keys, "_inv", y, weight, beta=ea, alpha=None if ea is not None else a, sign=sign)
    return fit.select(
        *keys, "n", F.col("alpha").alias("A"), (-F.col("beta") * BOLTZMANN_EV).alias("Ea"), "r2", "rss", "aicc"
    )


def general_fit(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    weight: str | None = None,
    arrhenius: bool = False,
) -> DataFrame:
    """Line or exponential by the lower AICc; ties go to the line.

    Columns: model, p0 (b or alpha or A), p1 (m or beta or Ea), r2.
    """
    lin = linear_fit(df, keys, x, y, weight)
    exp = (arrhenius_fit if arrhenius else exponential_fit)(df, keys, x, y, weight)
    scale, rate = ("A", "Ea") if arrhenius else ("alpha", "beta")
    exp = exp.select(
        *keys,
        F.col(scale).alias("_p0"),
        F.col(rate).alias("_p1"),
        F.col("r2").alias("_r2"),
        F.coalesce("aicc", F.lit(float("inf"))).alias("_aicc"),
    )
    both = attach(lin, exp, keys)
    better = F.col("_aicc") < F.coalesce("aicc", F.lit(float("inf")))
    return both.select(
        *keys,
        "n",
        F.when(better, "arrhenius" if arrhenius else "exponential").otherwise("linear").alias("model"),
        F.when(better, F.col("_p0")).otherwise(F.col("b")).alias("p0"),
        F.when(better, F.col("_p1")).otherwise(F.col("m")).alias("p1"),
        F.when(better, F.col("_r2")).otherwise(F.col("r2")).alias("r2"),
    )


def error_weights(df: DataFrame, keys: Sequence[str], error: str, name: str = "weight") -> DataFrame:
    """clip((max E - E) / max(max E - E), 1e-32, 1) within each key."""
    rows = with_few(df, keys, F.max(error).alias("_hi"), F.min(error).alias("_lo"))
    share = F.try_divide(F.col("_hi") - F.col(error), F.col("_hi") - F.col("_lo"))
    w = F.least(F.greatest(share, F.lit(MIN_READING)), F.lit(1.0))
    return rows.withColumn(name, F.coalesce(w, F.lit(1.0))).drop("_hi", "_lo")


def first_varied_column(df: DataFrame, names: Sequence[str], min_unique: int = 2) -> str:
    """First listed numeric column with at least `min_unique` distinct values."""
    numeric = [n for n in names if n in df.columns and dict(df.dtypes)[n] in
               ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if not numeric:
        raise KeyError(f"none of {list(names)} is a numeric column")
    seen = df.agg(*[F.approx_count_distinct(n).alias(n) if min_unique > 2
                    else (F.when(F.min(n) < F.max(n), 2).otherwise(1)).alias(n) for n in numeric]).first()
    return next((n for n in numeric if seen[n] >= min_unique), numeric[0])


def group_trend(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    columns: Sequence[str],
    kind: str = "general",
    error: str | None = None,
    sign_default: int = 0,
    fixed_ea: dict[str, float] | None = None,
) -> DataFrame:
    """Trend of every listed column per key: long result with `column`.

    All columns are fitted in the same job after an unpivot. Mixed signs turn
    into |value| * sign_default; `fixed_ea` gives an activation energy per
    column for the Arrhenius form.
    """
    weight = None
    if error:  # errors do not differ by column
        df, weight = error_weights(df, keys, error, "_weight"), "_weight"
    ids = [*keys, x, *([weight] if weight else [])]
    long = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ids, list(columns), "column", "value"
    )
    gk = [*keys, "column"]
    if sign_default:
        long = with_few(long, gk, F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        mixed = (F.col("_lo") < 0) & (F.col("_hi") > 0)
        long = long.withColumn(
            "value", F.when(mixed, F.abs("value") * sign_default).otherwise(F.col("value"))
        ).drop("_lo", "_hi")
    if kind == "linear":
        return linear_fit(long, gk, x, "value", weight)
    if kind == "exponential":
        return exponential_fit(long, gk, x, "value", weight)
    if kind == "arrhenius":
        ea = None
        for name, val in (fixed_ea or {}).items():
            hit = F.col("column") == name
            ea = F.when(hit, float(val)) if ea is None else ea.when(hit, float(val))
        return arrhenius_fit(long, gk, x, "value", weight, ea=ea)
    return general_fit(long, gk, x, "value", weight, arrhenius="temp" in x.lower())


def trend_values(df: DataFrame, keys: Sequence[str], x: str, y: str, kind: str = "linear") -> DataFrame:
    """Rows with the fitted value and the residual."""
    if kind == "linear":
        rows = attach(df, linear_fit(df, keys, x, y).select(*keys, "m", "b"), keys)
        return rows.withColumn("fit", F.col("m") * F.col(x) + F.col("b")).withColumn(
            "fit_resid", F.col(y) - F.col("fit")
        ).drop("m", "b")
    if kind == "arrhenius":
        fit = arrhenius_fit(df, keys, x, y).select(*keys, F.col("A").alias("_a"), (-F.col("Ea") / BOLTZMANN_EV).alias("_b"))
        xs = inverse_kelvin(x)
    else:
        fit = exponential_fit(df, keys, x, y).select(*keys, F.col("alpha").alias("_a"), F.col("beta").alias("_b"))
        xs = F.col(x)
    rows = attach(df, fit, keys)
    return rows.withColumn("fit", exponential_value(xs, F.col("_a"), F.col("_b"))).withColumn(
        "fit_resid", F.col(y) - F.col("fit")
    ).drop("_a", "_b")


def arrhenius_points(
    points: DataFrame,
    keys: Sequence[str],
    temp: str = "temp",
    columns: Sequence[str] = ("pos Current", "neg Current", "pos Resistance", "neg Resistance"),
    error: str | None = None,
    current_offset: str = "Current_b0",
) -> DataFrame:
    """Arrhenius trend of the usual point columns; the current offset has a fixed Ea."""
    have = [c for c in columns if c in points.columns]
    return group_trend(points, keys, temp, have, "arrhenius", error, fixed_ea={current_offset: FIXED_EA})


def temperature_moments(points: DataFrame, keys: Sequence[str], temp: str, columns: Sequence[str]) -> DataFrame:
    """Moments of every column per key and temperature: (keys, column, x, n, neg, pos, logs, mean, m2), x in 1/K."""
    long = points.select(*keys, temp, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([*keys, temp], list(columns), "column", "_y")
    x, y = inverse_kelvin(temp), F.col("_y")
    y = F.when(_finite(x) & _finite(y), y)
    rows = long.select(*keys, "column", x.alias("x"), y.alias("_y"))
    y = F.col("_y")
    return rows.groupBy(*keys, "column", "x").agg(
        F.count(y).alias("n"), F.count_if(y < 0).alias("neg"), F.count_if(y > 0).alias("pos"), F.sum(F.log(F.when(y == 0, MIN_READING).otherwise(F.abs(y)))).alias("logs"),
        F.avg(y).alias("mean"), (F.var_pop(y) * F.count(y)).alias("m2"))


def arrhenius_rollup(moments: DataFrame, keys: Sequence[str], sign: int = 1, fixed_ea: dict[str, float] | None = None) -> DataFrame:
    """Arrhenius trend per key from moments per temperature, as `arrhenius_fit` gives it from the rows.

    At one temperature the fitted value is one number, so slopes, residual
    sums and deviations follow from count, mean and spread there.
    """
    keys = list(keys)
    n, x = F.col("n"), F.col("x")
    fixed = F.lit(None).cast("double")
    for name, ea in (fixed_ea if fixed_ea is not None else {"Current_b0": FIXED_EA}).items():
        fixed = F.when(F.col("column") == name, -ea / BOLTZMANN_EV).otherwise(fixed)
    total = F.sum("n")
    rows = with_group(
        moments, keys, total.alias("_n"), F.try_divide(F.sum(n * x), total).alias("_x"), F.try_divide(F.sum("logs"), total).alias("_z"), F.try_divide(F.sum(n * F.col("mean")), total).alias("_y"),
        F.when(F.sum("neg") * 2 > total, -1).when(F.sum("pos") * 2 > total, 1).otherwise(sign).alias("_sign"))
    apart = x - F.col("_x")
    slope = F.try_divide(F.sum(apart * F.col("logs")), F.sum(n * apart * apart))
    fit = rows.groupBy(*keys).agg(F.coalesce(F.max(fixed), slope).alias("_beta"))
    rows = attach(rows, fit, keys)
    level = F.col("_z") - F.col("_beta") * F.col("_x")
    enough = F.col("_n") >= 2
    alpha = F.when(enough, F.col("_sign") * F.exp(F.when(level > MAX_EXPONENT, MAX_EXPONENT).otherwise(level)))
    gap, spread = F.col("mean") - exponential_value(x, alpha, F.col("_beta")), F.col("mean") - F.col("_y")
    out = rows.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.max(alpha).alias("A"), F.max(F.when(enough, -F.col("_beta") * BOLTZMANN_EV)).alias("Ea"),
        F.sum(F.col("m2") + n * gap * gap).alias("rss"), F.sum(F.col("m2") + n * spread * spread).alias("_syy"))
    return out.select(*keys, "n", "A", "Ea", (1 - F.try_divide(F.col("rss"), F.col("_syy"))).alias("r2"), "rss", aicc(F.col("rss"), F.col("n"), 2).alias("aicc"))


def log_spacing(df: DataFrame, keys: Sequence[str], freq: str, rtol: float = 1e-2) -> DataFrame:
    """True per key when all steps of log10(freq) agree with the first one; a step from zero is infinite and agrees with none."""
    logf = log10(F.col(freq))
    rows = Ordered(df.select(*keys, freq), keys, [freq]).frame(
        {"_d": lambda w: logf - F.lag(logf).over(w)}, halo=1
    )
    first = F.min_by("_d", F.when(F.col("_d").isNotNull(), F.col(freq)))
    rows = with_group(rows, keys, first.alias("_first"), F.min(freq).alias("_lowest"))
    ok = F.abs(F.col("_d") - F.col("_first")) <= 1e-8 + rtol * F.abs("_first")
    return rows.groupBy(*keys).agg(
        (F.coalesce(F.bool_and(ok), F.lit(True)) & (F.min("_lowest") >= 0)).alias("log_spaced")
    )


def detrend(df: DataFrame, keys: Sequence[str], x: Column, y: str, name: str = "detrended") -> DataFrame:
    """Value minus the least-squares line over `x` of its key; null where infinite values of x leave no line."""
    rows = df.withColumn("_x", x)
    rows = with_group(rows, keys, finite(F.regr_slope(F.col(y), F.col("_x"))).alias("_m"), finite(F.regr_intercept(F.col(y), F.col("_x"))).alias("_b"))
    return rows.withColumn(name, F.col(y) - (F.col("_m") * F.col("_x") + F.col("_b"))).drop("_x", "_m", "_b")
