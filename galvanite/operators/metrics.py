"""Error metrics over (true, predicted, weight) rows of each key.

All asked metrics of a key come from one aggregation. The log metrics and
`r2_score` first need facts of the whole key (sign majority, smallest
magnitude, weighted mean); these are joined to the rows beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.keyed import attach, quantiles, weighted_median, with_group

# 10**floor(log10(double eps)) and the 0.75 normal quantile.
EPS_EXPONENT = -16
TINY = 1e-16
NORMAL_75 = 0.6744897501960817

PLAIN_METRICS = (
    "r2_score mean_abs_err total_abs_err mean_squared_err total_squared_err "
    "root_mean_squared_err root_mean_abs_err mean_abs_perc_err total_abs_perc_err"
).split()
LOG_METRICS = (
    "mean_log_error total_log_error mean_squared_log_error total_squared_log_error "
    "mean_log10_error total_log10_error mean_squared_log10_error total_squared_log10_error"
).split()
DEVIANCE_METRICS = "mean_poisson_dev mean_gamma_dev".split()
ROW_METRICS = (
    "residuals squared_err abs_err max_err abs_perc_err log_error squared_log_error "
    "log10_error squared_log10_error z_scores abs_z_scores"
).split()


def _inputs(df: DataFrame, true: str, pred: str | None, weight: str | None) -> DataFrame:
    return df.select(
        "*",
        F.col(true).cast("double").alias("_t"),
        (F.col(pred).cast("double") if pred else F.lit(0.0)).alias("_p"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
    )


def _mean_one_weights(df: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Replace weights that sum to zero by ones; keep sum and count."""
    df = with_group(df, keys, F.sum("_w").alias("_w_raw"), F.count(F.lit(1)).alias("_n"), *more)
    df = df.withColumn("_w", F.when(F.col("_w_raw") == 0, 1.0).otherwise(F.col("_w")))
    scale = F.when(F.col("_w_raw") == 0, 1.0).otherwise(F.col("_n") / F.nullif("_w_raw", F.lit(0.0)))
    return df.withColumn("_wn", F.col("_w") * scale)


def _log_stats(floor: float, has_pred: bool, tag: str) -> list[Column]:
    below = F.sum((F.col("_t") < floor).cast("long"))
    smallest = F.min(F.when(F.col("_t") != 0, F.abs("_t")))
    size = F.count(F.lit(1))
    if has_pred:
        below = below + F.sum((F.col("_p") < floor).cast("long"))
        smallest = F.least(smallest, F.min(F.when(F.col("_p") != 0, F.abs("_p"))))
        size = size * 2
    return [
        (below > size * 0.5).alias(f"_flip{tag}"),
        F.pow(F.lit(10.0), F.floor(F.log10(smallest)) + EPS_EXPONENT).alias(f"_perturb{tag}"),
    ]


def _log_pair(floor: float, has_pred: bool, filler: float, tag: str) -> tuple[Column, Column]:
    def fixed(name: str) -> Column:
        val = F.when(F.col(f"_flip{tag}"), -F.col(name)).otherwise(F.col(name))
        return F.when(val < floor, floor + F.coalesce(f"_perturb{tag}", F.lit(0.0))).otherwise(val)

    return fixed("_t"), (fixed("_p") if has_pred else F.lit(filler))


def _safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def error_metrics(
    df: DataFrame,
    keys: Sequence[str],
    true: str,
    pred: str | None = None,
    weight: str | None = None,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key with the wanted metrics.

    Means divide by the weight sum; totals use weights scaled to mean 1.
    """
    wanted = list(metrics or [*PLAIN_METRICS, "median_abs_err", *LOG_METRICS, *DEVIANCE_METRICS])
    rows = _inputs(df, true, pred, weight)
    has_pred = pred is not None
    more: list[Column] = []
    if "r2_score" in wanted:
        more += [F.try_divide(F.sum(F.col("_w") * F.col("_t")), F.sum("_w")).alias("_mean_w"),
                 F.avg("_t").alias("_mean_1")]
    if set(wanted) & set(LOG_METRICS):
        more += _log_stats(-1.0, has_pred, "1")
    if set(wanted) & set(DEVIANCE_METRICS):
        more += _log_stats(0.0, has_pred, "0")
    rows = _mean_one_weights(rows, keys, *more)
    w, wn, sum_w = F.col("_w"), F.col("_wn"), F.sum("_w")
    err = F.col("_t") - F.col("_p")
    perc = F.abs(err) / F.abs(F.when(F.col("_t") != 0, F.col("_t")).otherwise(TINY))
    exprs: dict[str, Column] = {
        "mean_abs_err": F.sum(w * F.abs(err)) / sum_w,
        "total_abs_err": F.sum(wn * F.abs(err)),
        "mean_squared_err": F.sum(w * err * err) / sum_w,
        "total_squared_err": F.sum(wn * err * err),
        "root_mean_squared_err": F.sqrt(F.sum(w * err * err) / sum_w),
        "root_mean_abs_err": F.sqrt(F.sum(w * F.abs(err)) / sum_w),
        "mean_abs_perc_err": F.sum(w * perc) / sum_w,
        "total_abs_perc_err": F.sum(wn * perc),
    }
    if "r2_score" in wanted:
        centre = F.coalesce("_mean_w", "_mean_1")
        sse, sst = F.sum(wn * err * err), F.sum(wn * (F.col("_t") - centre) * (F.col("_t") - centre))
        exprs["r2_score"] = F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(
            1 - F.try_divide(sse, sst)
        )
    if set(wanted) & set(LOG_METRICS):
        t1, p1 = _log_pair(-1.0, has_pred, 0.0, "1")
        for base, fn in (("log", F.log), ("log10", F.log10)):
            d = F.when((t1 > -1) & (p1 > -1), fn(1 + t1) - fn(1 + p1))
            exprs[f"mean_{base}_error"] = F.sum(w * d) / sum_w
            exprs[f"total_{base}_error"] = F.sum(wn * d)
            exprs[f"mean_squared_{base}_error"] = F.sum(w * d * d) / sum_w
            exprs[f"total_squared_{base}_error"] = F.sum(wn * d * d)
    if set(wanted) & set(DEVIANCE_METRICS):
        t0, p0 = _log_pair(0.0, has_pred, TINY, "0")
        ratio = F.try_divide(t0, p0)
        exprs["mean_poisson_dev"] = F.sum(w * 2 * (t0 * _safe_log(ratio) + p0 - t0)) / sum_w
        exprs["mean_gamma_dev"] = (
            F.sum(w * 2 * (_safe_log(F.try_divide(p0, t0)) + ratio - 1)) / sum_w
        )
    direct = [m for m in wanted if m != "median_abs_err"]
    out = rows.groupBy(*keys).agg(*[exprs[m].alias(m) for m in direct]) if direct else None
    if "median_abs_err" in wanted:
        med = median_abs_err(df, keys, true, pred, weight)
        out = attach(out, med, keys) if out is not None else med
    return out.select(*keys, *wanted)


def median_abs_err(
    df: DataFrame, keys: Sequence[str], true: str, pred: str | None = None, weight: str | None = None
) -> DataFrame:
    """Plain or weighted median of the absolute error."""
    rows = _inputs(df, true, pred, weight).withColumn("_e", F.abs(F.col("_t") - F.col("_p")))
    if weight is None:
        return quantiles(rows, keys, "_e", {"median_abs_err": 0.5})
    return weighted_median(rows, keys, "_e", "_w", "median_abs_err")


def row_errors(
    df: DataFrame,
    keys: Sequence[str],
    true: str,
    pred: str | None = None,
    weight: str | None = None,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Add per-row error columns; weights are scaled to mean 1 per key."""
    wanted = list(metrics or ROW_METRICS)
    rows = _inputs(df, true, pred, weight)
    has_pred = pred is not None
    more: list[Column] = []
    if any("log" in m for m in wanted):
        more += _log_stats(-1.0, has_pred, "1")
    err = F.col("_t") - F.col("_p")
    if any("z_scores" in m for m in wanted):
        more += [F.try_divide(F.sum(F.col("_w") * err), F.sum("_w")).alias("_mu_w"), F.avg(err).alias("_mu_1")]
    rows = _mean_one_weights(rows, keys, *more)
    if any("z_scores" in m for m in wanted):
        rows = rows.withColumn("_mu", F.coalesce("_mu_w", "_mu_1"))
        dev = err - F.col("_mu")
        rows = with_group(rows, keys, F.sqrt(F.sum(F.col("_w") * dev * dev) / F.sum("_w")).alias("_sd"))
    wn = F.col("_wn")
    perc = F.abs(err) / F.abs(F.when(F.col("_t") != 0, F.col("_t")).otherwise(TINY))
    exprs = {
        "residuals": err * wn,
        "squared_err": err * err * wn,
        "abs_err": F.abs(err) * wn,
        "max_err": F.abs(err) * wn,
        "abs_perc_err": perc * wn,
    }
    if any("log" in m for m in wanted):
        t1, p1 = _log_pair(-1.0, has_pred, 0.0, "1")
        for base, fn in (("log", F.log), ("log10", F.log10)):
            d = F.when((t1 > -1) & (p1 > -1), fn(1 + t1) - fn(1 + p1))
            exprs[f"{base}_error"] = d * wn
            exprs[f"squared_{base}_error"] = d * d * wn
    if any("z_scores" in m for m in wanted):
        z = F.when(F.col("_sd") == 0, 0.0).otherwise(F.try_divide(err - F.col("_mu"), F.col("_sd")))
        exprs["z_scores"], exprs["abs_z_scores"] = z, F.abs(z)
    return rows.select(*df.columns, *[exprs[m].alias(m) for m in wanted])


def modified_z_scores(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, name: str = "mod_z"
) -> DataFrame:
    """0.6745 (x - median) / MAD per key, 0 where the MAD is 0."""

    def middle(rows: DataFrame, col: str, out: str) -> DataFrame:
        if weight is None:
            return quantiles(rows, keys, col, {out: 0.5})
        return weighted_median(rows, keys, col, weight, out)

    rows = attach(df, middle(df, value, "_med"), keys).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    rows = attach(rows, middle(rows, "_dev", "_mad"), keys)
    z = F.when(F.col("_mad") == 0, 0.0).otherwise(
        NORMAL_75 * F.try_divide(F.col(value) - F.col("_med"), F.col("_mad"))
    )
    return rows.select(*df.columns, z.alias(name))


def propagated_error(result: str, pairs: Sequence[tuple[str, str]]) -> Column:
    """result * sqrt(sum((err / value)^2)) for products and quotients."""
    total = F.lit(0.0)
    for value, err in pairs:
        part = F.try_divide(F.col(err), F.col(value))
        total = total + part * part
    return F.col(result) * F.sqrt(total)


def aicc(rss: Column, n: Column, k: int) -> Column:
    """Corrected Akaike criterion; infinity where rss is not positive."""
    base = n * F.log(F.try_divide(F.when(rss > 0, rss), n)) + 2 * k
    small = F.when(n - k - 1 > 0, F.lit(2.0 * k * (k + 1)) / F.nullif(n - k - 1, F.lit(0))).otherwise(0.0)
    return F.when(rss <= 0, F.lit(float("inf"))).otherwise(base + small)


def sums_of_squares(df: DataFrame, keys: Sequence[str], true: str, pred: str) -> DataFrame:
    """Residual and total sum of squares with R2 (null when the total is 0)."""
    err = F.col(true) - F.col(pred)
    return df.groupBy(*keys).agg(
        F.sum(err * err).alias("rss"),
        F.regr_syy(F.col(true), F.col(true)).alias("tss"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("r2", 1 - F.try_divide(F.col("rss"), F.col("tss")))


def dataset_error(
    data: DataFrame,
    model: DataFrame,
    keys: Sequence[str],
    freq: str,
    forms: Sequence[str],
    metric: str = "mean_abs_perc_err",
    band: tuple[float, float] | None = None,
) -> DataFrame:
    """Metric over the stacked forms of data against model values."""

    def stacked(df: DataFrame, name: str) -> DataFrame:
        if band:
            df = df.where(F.col(freq).between(*band))
        return df.select(*keys, freq, *forms).unpivot([*keys, freq], list(forms), "form", name)

    both = attach(stacked(data, "_true"), stacked(model, "_pred"), [*keys, freq, "form"], "inner")
    if "log" in metric:
        both = both.withColumn("_true", F.abs("_true")).withColumn("_pred", F.abs("_pred"))
    return error_metrics(both, keys, "_true", "_pred", None, [metric])
