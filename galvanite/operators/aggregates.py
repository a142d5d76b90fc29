"""Aggregations per dataset, run or segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.keyed import Ordered, attach, counted_quantiles, counted_values, has_hot_group, quantiles, weighted_median, with_group, with_total


def settled_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], start: str | None = None
) -> DataFrame:
    """Mean over rows [int(.6 n), n - max(1, int(.05 n))) of each segment.

    Segments below four rows, or with an empty span, use all rows. `start`
    names a time column whose first value is kept.
    """
    rows = Ordered(df, keys, order).positions("_i", "_n")
    n = F.col("_n")
    lo = F.floor(n * 0.6)
    hi = n - F.greatest(F.lit(1), F.floor(n * 0.05))
    inside = (n < 4) | (lo >= hi) | ((F.col("_i") >= lo) & (F.col("_i") < hi))
    aggs = [F.avg(F.when(inside, F.col(v))).alias(v) for v in values]
    if start:
        aggs.append(F.min_by(start, "_i").alias(f"first_{start}"))
    return rows.groupBy(*keys).agg(F.max("_n").alias("rows"), *aggs)


def polarity_aggregate(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], reference: str, fill: bool = True
) -> DataFrame:
    """Mean and sample std per key, split by the sign of `reference`.

    Columns are named `pos X`, `pos X_std`, `neg X`, `neg X_std`; empty cells
    get the mean of their column.
    """
    neg = F.col(reference) < 0
    aggs = []
    for c in columns:
        for tag, cond in (("pos", ~neg), ("neg", neg)):
            val = F.when(cond, F.col(c).cast("double"))
            aggs += [F.avg(val).alias(f"{tag} {c}"), F.stddev_samp(val).alias(f"{tag} {c}_std")]
    out = df.groupBy(*keys).agg(*aggs)
    if not fill:
        return out
    names = [c for c in out.columns if c not in keys]
    full = with_total(out, *[F.avg(F.col(f"`{c}`")).alias(f"_m {c}") for c in names])
    return full.select(
        *keys, *[F.coalesce(F.col(f"`{c}`"), F.col(f"`_m {c}`")).alias(c) for c in names]
    )


def segment_stats(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, columns: Sequence[str]
) -> DataFrame:
    """Last time and representative first/last value of each segment.

    The earlier of the smallest and largest magnitude stands for the start
    when it lies within the first quarter, the later one for the end when it
    lies within the last quarter; otherwise the edge value is taken.
    """
    rows = Ordered(df, keys, order).positions("_i", "_n")
    aggs = [F.max("_n").alias("_n"), F.max_by(time, "_i").alias("time")]
    for c in columns:
        mag = F.abs(F.col(c))
        lo = F.min_by(F.struct(F.col("_i").alias("i"), F.col(c).alias("v")), F.struct(mag, F.col("_i")))
        hi = F.max_by(F.struct(F.col("_i").alias("i"), F.col(c).alias("v")), F.struct(mag, -F.col("_i")))
        aggs += [
            F.least(lo, hi).alias(f"_a_{c}"),
            F.greatest(lo, hi).alias(f"_z_{c}"),
            F.min_by(c, "_i").alias(f"_first_{c}"),
            F.max_by(c, "_i").alias(f"_last_{c}"),
        ]
    got = rows.groupBy(*keys).agg(*aggs)
    quarter = F.floor(F.col("_n") / 4)
    cols: list[Column] = []
    for c in columns:
        first = F.when(F.col(f"_a_{c}.i") <= quarter, F.col(f"_a_{c}.v")).otherwise(F.col(f"_first_{c}"))
        last = F.when(F.col(f"_z_{c}.i") > 3 * quarter, F.col(f"_z_{c}.v")).otherwise(F.col(f"_last_{c}"))
        cols += [
            F.when(quarter >= 1, first).alias(f"{c}_0"),
            F.when(quarter >= 1, last).alias(f"{c}_f"),
        ]
    return got.select(*keys, "time", *cols)


def longest_time(stats: DataFrame, time: str = "time") -> DataFrame:
    """Largest segment time of the table, at least 2."""
    return stats.agg(F.greatest(F.max(time), F.lit(2.0)).alias("max_time"))


def stats_summary(
    df: DataFrame, fit: str, measurement: str, values: Sequence[str], updated: str
) -> DataFrame:
    """median/mean/std/min/max per (fit, measurement) and for fit = 'all'.

    Each statistic also comes with a `u` prefix over updated rows only (all
    rows when nothing was updated). Standard deviations are sample ones per
    fit and population ones for 'all'.
    """
    flag = F.col(updated).cast("boolean")
    measured = with_group(df, [fit, measurement], F.bool_or(flag).alias("_any")).withColumn(
        "_u", F.coalesce(flag, F.lit(False)) | ~F.coalesce("_any", F.lit(False))
    )
    for v in values:
        measured = measured.withColumn(f"_u_{v}", F.when(F.col("_u"), F.col(v)))

    # A key of the finer level is never larger than one of the coarser.
    hot = has_hot_group(df, [measurement])
    counted = {v: counted_values(measured, [fit, measurement, "_u"], v).withColumn(f"_u_{v}", F.when(F.col("_u"), F.col(v))) for v in values} if hot else {}

    def stats(keys: list[str], std) -> DataFrame:
        aggs = [F.sum(flag.cast("long")).alias("updated")]
        wanted = []
        for v in values:
            for tag, src in (("", v), ("u", f"_u_{v}")):
                aggs += [
                    F.avg(src).alias(f"{v}_{tag}mean"),
                    std(src).alias(f"{v}_{tag}std"),
                    F.min(src).alias(f"{v}_{tag}min"),
                    F.max(src).alias(f"{v}_{tag}max"),
                ]
                wanted.append((v, src, f"{v}_{tag}median"))
        if not hot:
            aggs += [F.percentile(src, 0.5).alias(n) for _, src, n in wanted]
            return measured.groupBy(*keys).agg(*aggs)
        out = measured.groupBy(*keys).agg(*aggs)
        for v, src, n in wanted:
            out = attach(out, counted_quantiles(counted[v], keys, src, {n: 0.5}), keys)
        return out

    per_fit = stats([fit, measurement], F.stddev_samp)
    overall = stats([measurement], F.stddev_pop).withColumn(fit, F.lit("all"))
    return per_fit.withColumn(fit, F.col(fit).cast("string")).unionByName(overall)


def group_points(
    df: DataFrame, levels: Sequence[Sequence[str]], name: str = "group_id", prefix: Column | str | None = None
) -> DataFrame:
    """One copy of every row per level list; the group id joins its parts."""
    head = [F.lit(prefix) if isinstance(prefix, str) else prefix] if prefix is not None else []
    ids = [F.concat_ws(" ", *head, *[F.col(c).cast("string") for c in lv]) for lv in levels]
    return df.withColumn(name, F.explode(F.array(*ids)))


def trimmed_midpoint(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], q: float = 0.25, logspace: bool = True
) -> DataFrame:
    """Mean over columns of the mean of the q and 1-q quantiles of |x|.

    In log space zeros are left out; with no usable value at all the median
    of the column medians is returned.
    """
    q = min(max(q, 0.0), 0.5)
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "_c", "_raw"
    )
    mag = F.abs("_raw")
    usable = F.when(mag > 0, F.log10(mag)) if logspace else mag
    gk = [*keys, "_c"]
    if has_hot_group(long, gk):
        counted, of = counted_values(long, gk, "_raw"), counted_quantiles
    else:
        counted, of = long, quantiles
    part = attach(
        of(counted.withColumn("_v", usable), gk, "_v", {"_lo": q, "_hi": 1 - q}), of(counted, gk, "_raw", {"_med": 0.5}), gk
    )
    out = part.groupBy(*keys).agg(
        F.avg((F.col("_lo") + F.col("_hi")) / 2).alias("_mid"), F.percentile("_med", 0.5).alias("_fallback")
    )
    mid = F.pow(F.lit(10.0), F.col("_mid")) if logspace else F.col("_mid")
    return out.select(*keys, F.coalesce(mid, F.col("_fallback")).alias("midpoint"))


def weighted_median_of(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str = "median") -> DataFrame:
    return weighted_median(df, keys, value, weight, name)


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value, the smallest one on ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.v").alias(name), (-F.col("_b.n")).alias("occurrences")
    )


def edge_means(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], perc: float = 5.0
) -> DataFrame:
    """Mean of the max(1, int(n perc/100)) lowest and highest rows in order.

    `values` maps a column to its output stem: `<stem>_zero` and
    `<stem>_infinity`.
    """
    rows = Ordered(df, keys, order).positions("_i", "_n")
    take = F.greatest(F.lit(1), F.floor(F.col("_n") * (perc / 100)))
    aggs = []
    for c, stem in values.items():
        aggs += [
            F.avg(F.when(F.col("_i") < take, F.col(c))).alias(f"{stem}_zero"),
            F.avg(F.when(F.col("_i") >= F.col("_n") - take, F.col(c))).alias(f"{stem}_infinity"),
        ]
    return rows.groupBy(*keys).agg(*aggs)


def merge_close_points(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], freq: str, values: Sequence[str], tol: float = 1e-3
) -> DataFrame:
    """Average chains of neighbours with |df| <= tol (f1 + f2) / 2."""
    rows = Ordered(df, keys, order)
    stepped = rows.frame({"_prev": lambda w: F.lag(freq).over(w)})
    apart = F.abs(F.col(freq) - F.col("_prev")) > tol * (F.col(freq) + F.col("_prev")) / 2
    chained = Ordered(
        stepped.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("long")), keys, order, split=rows.split
    ).running({"chain": ("sum", F.col("_new"))})
    return chained.groupBy(*keys, "chain").agg(
        F.count(F.lit(1)).alias("points"), F.avg(freq).alias(freq), *[F.avg(v).alias(v) for v in values]
    )


def merge_ratio(merged: DataFrame, keys: Sequence[str], least: float = 0.05) -> DataFrame:
    """Share of points that a merge removed, and whether it is below 5 %."""
    out = merged.groupBy(*keys).agg((1 - F.count(F.lit(1)) / F.sum("points")).alias("shrink"))
    return out.withColumn("too_little", F.col("shrink") < least)


def cycling_test(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, pass_single: bool = False
) -> DataFrame:
    """True when every sign is the opposite of the one before (nulls removed)."""
    rows = Ordered(df.where(F.col(value).isNotNull()).select(*keys, *order, value).distinct()
                   if value not in order else df.where(F.col(value).isNotNull()), keys, order)
    got = rows.frame({"_s": lambda w: F.lag(F.signum(F.col(value))).over(w)})
    out = got.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and(F.signum(F.col(value)) == -F.col("_s")).alias("_ok")
    )
    return out.select(*keys, F.when(F.col("_n") < 2, pass_single).otherwise(F.col("_ok")).alias("cycling"))


def decay_verdict(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    time: str,
    resistance: str,
    voltage: str,
    point: Sequence[str],
    min_slope: float = 0.0,
    ensure_point: bool = True,
) -> DataFrame:
    """Accept segments whose |resistance| rises in their second half.

    slope = least-squares slope over rows >= n // 2, divided by the largest
    magnitude there; below four rows it is 0 and not accepted. With
    `ensure_point` each (point keys, polarity) group without an accepted
    segment gets the one with the slope nearest to `min_slope`.
    """
    rows = Ordered(df, keys, order).positions("_i", "_n")
    half = F.floor(F.col("_n") / 2)
    late = F.col("_i") >= half
    mag = F.abs(F.col(resistance))
    slope = F.try_divide(
        F.regr_slope(F.when(late, mag), F.when(late, F.col(time).cast("double"))), F.max(F.when(late, mag))
    )
    got = rows.groupBy(*keys).agg(
        F.max("_n").alias("rows"),
        F.max(F.when(F.col("_i") == half, F.signum(F.col(voltage)))).alias("polarity"),
        slope.alias("_slope"),
    )
    small = F.col("rows") < 4
    got = got.withColumn("slope", F.when(small, 0.0).otherwise(F.col("_slope"))).withColumn(
        "accepted", F.when(small, False).otherwise(F.coalesce(F.col("slope") >= min_slope, F.lit(False)))
    ).drop("_slope")
    if not ensure_point:
        return got
    gk = [*point, "polarity"]
    # One struct per group: whether any passed and the key of the nearest one.
    dist = F.abs(F.lit(float(min_slope)) - F.col("slope"))
    near = F.min_by(F.struct(*keys), F.struct(F.coalesce(dist, F.lit(float("inf"))), *keys))
    got = with_group(got, gk, F.bool_or("accepted").alias("_any"), near.alias("_near"))
    pick = ~F.col("_any") & (F.struct(*keys) == F.col("_near"))
    return got.withColumn("accepted", F.col("accepted") | pick).drop("_any", "_near")


def rank_datasets(df: DataFrame, keys: Sequence[str], score: str, ascending: bool = False) -> DataFrame:
    """Datasets ordered by their largest score."""
    best = df.groupBy(*keys).agg(F.max(score).alias("score"))
    return best.orderBy(F.col("score").asc() if ascending else F.col("score").desc(), *keys)


def rank_periods(metrics: DataFrame, run: Sequence[str], rows: str, min_strength: float = 1.0, sparse: bool = True) -> DataFrame:
    """Most likely period per run and the channel that shows it best.

    Input: one row per (run, channel) with period, strength, snr, sharpness
    and the number of samples. A run has as many rows as it has channels, so
    the rank windows below stay small.
    """
    from pyspark.sql import Window

    ok = F.col("period").isNotNull() & (F.col("strength") >= min_strength)
    if sparse:
        ok = ok & (F.floor(F.try_divide(F.col(rows), F.col("period"))) < F.col("period"))
    kept = metrics.where(ok)
    common = kept.groupBy(*run, "period").agg(F.count(F.lit(1)).alias("_k")).groupBy(*run).agg(
        F.min_by("period", F.struct(-F.col("_k"), F.col("period"))).alias("_common")
    )
    kept = with_group(kept, run, F.avg("period").alias("_mean"))
    centre = kept.groupBy(*run).agg(
        F.min_by("period", F.struct(F.abs(F.col("period") - F.col("_mean")), F.col("period"))).alias("_centre")
    )
    kept = attach(attach(kept, common, run), centre, run)
    kept = kept.withColumn("_dc", F.abs(F.col("period") - F.col("_common"))).withColumn(
        "_da", F.abs(F.col("period") - F.col("_centre"))
    )
    per = kept.groupBy(*run, "period").agg(*[F.max(c).alias(c) for c in ("strength", "snr", "sharpness", "_dc", "_da")])
    by = Window.partitionBy(*run)
    total = sum(
        [F.rank().over(by.orderBy(F.col(c).desc())) for c in ("strength", "snr", "sharpness")]
        + [F.rank().over(by.orderBy(F.col(c).asc())) for c in ("_dc", "_da")],
        F.lit(0),
    )
    best = per.select(*run, "period", total.alias("_rank")).groupBy(*run).agg(
        F.min_by("period", F.struct("_rank", "period")).alias("_best")
    )
    cand = attach(kept, best, run).where(F.col("period") == F.col("_best"))
    chan_rank = sum([F.rank().over(by.orderBy(F.col(c).desc())) for c in ("strength", "snr", "sharpness")], F.lit(0))
    cand = cand.withColumn("_rank", chan_rank)
    return cand.groupBy(*run).agg(
        F.max("_best").alias("period"), F.min_by("channel", F.struct("_rank", "channel")).alias("channel")
    )


def describe_bootstrap(df: DataFrame, keys: Sequence[str], value: str, interval: float | None = None) -> DataFrame:
    """Mean and sample std, or half the width of the central interval (%)."""
    base = df.groupBy(*keys).agg(F.avg(value).alias("value"), F.stddev_samp(value).alias("std"))
    if interval is None:
        return base
    tail = (100 - interval) / 200
    q = quantiles(df, keys, value, {"_lo": tail, "_hi": 1 - tail})
    return attach(base, q, keys).select(*keys, "value", ((F.col("_hi") - F.col("_lo")) / 2).alias("std"))


def band_percentiles(
    df: DataFrame, keys: Sequence[str], freq: str, value: str, low: float = 2.5, high: float = 97.5
) -> DataFrame:
    """Percentile band with mean and std per frequency."""
    gk = [*keys, freq]
    band = quantiles(df, gk, value, {"low": low / 100, "high": high / 100})
    return attach(band, df.groupBy(*gk).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")), gk)


def nyquist_band(
    df: DataFrame, keys: Sequence[str], freq: str, real: str, imag: str, low: float = 2.5, high: float = 97.5,
    per_decade: int = 50,
) -> DataFrame:
    """Band of the imaginary part in decades * 50 equal bins of the real axis."""
    lim = with_group(
        df, keys,
        F.min(real).alias("_lo"), F.max(real).alias("_hi"),
        F.min(F.log10(F.when(F.col(freq) > 0, F.col(freq)))).alias("_f0"),
        F.max(F.log10(F.when(F.col(freq) > 0, F.col(freq)))).alias("_f1"),
    )
    bins = F.greatest(F.lit(1), F.round((F.col("_f1") - F.col("_f0")) * per_decade)).cast("long")
    at = F.floor(F.try_divide(F.col(real) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)
    rows = lim.withColumn("bin", F.least(F.coalesce(at, F.lit(0)), bins - 1).cast("long"))
    gk = [*keys, "bin"]
    band = quantiles(rows, gk, imag, {"low": low / 100, "high": high / 100})
    return attach(rows.groupBy(*gk).agg(F.avg(real).alias("real"), F.count(F.lit(1)).alias("points")), band, gk)


def array_attrs(col: Column, how: str = "scalar", default: Column | None = None) -> Column:
    """Reduce an attribute array: drop nulls and repeats, then one value.

    `scalar` keeps the value only when one remains; `min` and `first` reduce.
    """
    vals = F.array_distinct(F.array_compact(col))
    if how == "min":
        out = F.array_min(vals)
    elif how == "first":
        out = F.try_element_at(vals, F.lit(1))
    else:
        out = F.when(F.size(vals) == 1, F.try_element_at(vals, F.lit(1)))
    return F.coalesce(out, default) if default is not None else out
