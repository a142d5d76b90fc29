"""Whole jobs over many runs: segmenting, standardising, trends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.functions.ieee import finite
from galvanite.functions.standard import RAW, raw_to_standard
from galvanite.keyed import Ordered, attach, checked_once, has_hot_group, quantiles, with_group
from galvanite.operators.aggregates import decay_verdict, group_points, polarity_aggregate, rank_periods, settled_mean, stats_summary
from galvanite.operators.channels import channel_traits, enforce_trend, infer_multiplier, resolve_channels
from galvanite.operators.cleaning import clean_segments
from galvanite.operators.joins import map_channels, split_by_verdict
from galvanite.operators.regress import arrhenius_points, arrhenius_rollup, temperature_moments, group_trend
from galvanite.operators.windows import polarity, savgol, savgol_fraction, segments_from_breakpoints, time_axis
from galvanite.plans.spectra import detect_period
from galvanite.session import cut_lineage, cut_to_files, measured_broadcasts


def find_runs_period(samples: DataFrame, run: Sequence[str], order: Sequence[str], channel: str = "channel", value: str = "value") -> DataFrame:
    """Most likely period of each run and the channel that shows it."""
    metrics = detect_period(samples, [*run, channel], order, value)
    return rank_periods(metrics.withColumnRenamed(channel, "channel"), run, "n")


def _steep_peaks(rows: DataFrame, keys: list[str], value: str, share: float = 0.85) -> DataFrame:
    """Local maxima of |value| above a quantile and in the upper height bins.

    A run without clear maxima (mean / mean height above .2) gives none.
    """
    mag = F.abs(F.col(value))
    rows = attach(rows, quantiles(rows, keys, value, {"_q": share}), keys)
    near = Ordered(rows, keys, ["_i"]).frame({"_a": lambda w: F.lag(mag).over(w), "_b": lambda w: F.lead(mag).over(w)})
    near = with_group(near, keys, F.avg(mag).alias("_mean"))
    tops = near.where((mag > F.col("_a")) & (mag > F.col("_b")) & (mag >= F.col("_q"))).withColumn("_h", mag)
    tops = with_group(tops, keys, F.min("_h").alias("_h0"), F.max("_h").alias("_h1"))
    upper = (F.col("_h") > F.col("_h0") + (F.col("_h1") - F.col("_h0")) / 4) | (F.col("_h0") == F.col("_h1"))
    tops = tops.where(upper)
    tops = with_group(tops, keys, F.avg("_h").alias("_hm"))
    return tops.where(F.col("_mean") / F.col("_hm") <= 0.2).select(*keys, F.col("_i").alias("peak"))


def _nearest_peak(centers: DataFrame, peaks: DataFrame, keys: list[str]) -> DataFrame:
    """Peak nearest to each centre: neighbours on both sides by running values."""
    a = centers.select(*keys, "center", F.col("center").alias("_at"), F.lit(1).alias("_side"))
    b = peaks.select(*keys, F.col("peak").cast("double").alias("_at"), F.lit(0).alias("_side"), F.col("peak").cast("double").alias("_p")).distinct()
    both = a.unionByName(b, allowMissingColumns=True)
    seq = Ordered(both, keys, ["_at", "_side"])
    got = seq.running({"_lo": ("last", F.col("_p"))})
    got = Ordered(got, keys, ["_at", "_side"], split=seq.split).running({"_hi": ("last", F.col("_p"))}, reverse=True)
    low_near = F.coalesce(F.col("center") - F.col("_lo") <= F.col("_hi") - F.col("center"), F.col("_hi").isNull())
    return got.where(F.col("_side") == 1).select(*keys, "center", F.when(low_near, F.col("_lo")).otherwise(F.col("_hi")).alias("peak"))


def _averaged_peaks(peaks: DataFrame, centers: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """Peaks averaged around the nearest centre, repeated; few per run."""
    types = dict(peaks.dtypes)
    both = peaks.select(*keys, F.col("peak").cast("double").alias("_x"), F.lit(False).alias("_is_c")).unionByName(
        centers.select(*keys, F.col("_c").cast("double").alias("_x"), F.lit(True).alias("_is_c")))

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.sort(pdf.loc[pdf["_is_c"], "_x"].to_numpy())
        p = pdf.loc[~pdf["_is_c"], "_x"].to_numpy()
        for _ in range(rounds if len(c) and len(p) else 0):
            owner = np.searchsorted((c[1:] + c[:-1]) / 2, p)  # centres stay sorted; a tie goes to the lower one
            sums, counts = np.bincount(owner, p, len(c)), np.bincount(owner, minlength=len(c))
            c = np.where(counts > 0, sums / np.maximum(counts, 1), c)
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(c) for k in keys})
        out["peak"] = np.rint(c).astype("int64")
        return out

    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "peak long"
    return both.groupBy(*keys).applyInPandas(average, schema).distinct()


def refine_breakpoints(samples: DataFrame, run: Sequence[str], order: Sequence[str], value: str, period: DataFrame, lloyd_rounds: int = 10) -> DataFrame:
    """Segment limits (run, breakpoint) near the multiples of the period.

    Steep places of the 3-point smoothed signal are matched to evenly spaced
    centres; when the length is no multiple of the period and there are more
    peaks than segments, the peaks are first averaged around the centres.
    """
    keys = list(run)
    rows = Ordered(samples, keys, order).positions("_i", "_n")
    seq = rows.select(*keys, "_i", "_n", F.col(value).cast("double").alias("_v"))
    smooth = savgol(seq, keys, ["_i"], "_v", 3, 1, name="_s")
    slopes = savgol(smooth, keys, ["_i"], "_s", 3, 2, deriv=1, name="_d1")
    slopes = savgol(slopes, keys, ["_i"], "_s", 3, 2, deriv=2, name="_d2")
    slopes = cut_lineage(slopes)
    peaks = _steep_peaks(slopes, keys, "_d1").unionByName(_steep_peaks(slopes, keys, "_d2")).distinct()
    facts = attach(rows.groupBy(*keys).agg(F.max("_n").alias("_n")), period.select(*keys, F.col("period").alias("_per")), keys)
    facts = facts.withColumn("_segs", F.greatest(F.lit(1), F.rint(F.col("_n") / F.col("_per"))).cast("int"))
    peaks = attach(peaks, facts, keys)
    half = F.floor(F.col("_per") / 2)
    peaks = cut_lineage(peaks.where((F.col("peak") >= half) & (F.col("peak") <= F.col("_n") - half)).select(*keys, "peak"))
    step = F.when(F.col("_segs") > 2, F.try_divide(F.col("_n") - 2 * F.col("_per"), (F.col("_segs") - 2).cast("double"))).otherwise(0.0)
    centers = facts.where((F.col("_segs") >= 2) & F.col("_per").isNotNull()).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_segs") - 2)))
    centers = centers.select(*keys, (F.col("_per") + F.col("_k") * step).cast("double").alias("center"), F.col("_k"))
    counts = peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_found"))
    uneven = attach(facts, counts, keys).where((F.col("_n") % F.col("_per") != 0) & (F.col("_found") > F.col("_segs"))).select(*keys)
    targets = peaks
    if not uneven.isEmpty():
        moving = attach(centers, uneven, keys, "left_semi").select(*keys, "_k", F.col("center").alias("_c"))
        pts = attach(peaks, uneven, keys, "left_semi")
        if not has_hot_group(pts, keys):
            rounded = _averaged_peaks(pts, moving, keys, lloyd_rounds)
        else:
            for _ in range(lloyd_rounds):
                owner = _nearest_peak(pts.select(*keys, F.col("peak").cast("double").alias("center")), moving.select(*keys, F.col("_c").alias("peak")), keys)
                mean = owner.groupBy(*keys, "peak").agg(F.avg("center").alias("_new")).withColumnRenamed("peak", "_c")
                moving = cut_lineage(attach(moving, mean, [*keys, "_c"]).select(*keys, "_k", F.coalesce("_new", "_c").alias("_c")))
            rounded = moving.select(*keys, F.rint("_c").cast("long").alias("peak")).distinct()
        targets = attach(peaks, uneven, keys, "left_anti").unionByName(rounded)
    near = attach(_nearest_peak(centers, targets, keys), facts.select(*keys, "_per"), keys)
    inner = near.where(F.abs(F.col("peak") - F.col("center")) <= F.col("_per") / 2).select(*keys, F.col("peak").cast("long").alias("breakpoint"))
    ends = facts.select(*keys, F.explode(F.array(F.lit(0).cast("long"), F.col("_n"))).alias("breakpoint"))
    return inner.unionByName(ends).distinct()


def standardise_runs(samples: DataFrame, run: Sequence[str], ts: str, **options) -> dict[str, DataFrame]:
    """Raw channel samples to accepted and rejected standard segments.

    Input rows: (run keys, row_idx, ts, channel, value). Steps: time axis,
    period and breakpoints, segment means, channel roles, decade factors,
    standard channels, trimming, smoothing, decay test. Keys stay columns, so
    all runs go through together. Options: the column names `sample`,
    `condition`, `temp`; `smooth` (share of a segment), `min_slope`, `clean`.
    """
    samples = cut_to_files(samples)
    # No step makes more than two rows of one, counted over all channels.
    with measured_broadcasts(samples.sparkSession), checked_once(samples, run, growth=2):
        return _standardise(samples, list(run), ts, **options)


def _finite_channels(df: DataFrame) -> DataFrame:
    """Readings without a value where a zero current or resistance leaves none."""
    return df.withColumns({c: finite(F.col(c)) for c in ("current", "resistance", "current_rms", "current_abs")})


def _standardise(
    samples: DataFrame, run: Sequence[str], ts: str, sample: str = "sample_name", condition: str = "condition", temp: str = "temp",
    smooth: float | None = None, min_slope: float = 0.0, clean: dict | None = None,
) -> dict[str, DataFrame]:
    axis = samples.select(*run, "row_idx", ts).distinct()
    axis = cut_to_files(time_axis(axis, run, ["row_idx"], ts, "t"))
    period = cut_to_files(find_runs_period(samples, run, ["row_idx"]))
    lead = attach(samples, period.select(*run, "channel"), [*run, "channel"], "left_semi")
    breaks = cut_to_files(refine_breakpoints(lead, run, ["row_idx"], "value", period))
    seg_axis = cut_to_files(segments_from_breakpoints(axis, breaks, run, ["row_idx"], "t"))
    seg = [*run, "segment"]
    rows = attach(samples.drop(ts), seg_axis.select(*run, "row_idx", "segment", "t", ts), [*run, "row_idx"])
    # Each cut writes a table that several later steps read.
    rows = cut_to_files(rows)
    means = cut_to_files(settled_mean(rows, [*seg, "channel"], ["row_idx"], ["value"]))
    traits = cut_to_files(channel_traits(means, run, ["segment"]))
    roles = cut_to_files(resolve_channels(traits, means, run, ["segment"], temp, trend=[c for c in run if c in (sample, condition)]))
    mapping = roles.where(F.col("std_channel").isNotNull()).select(*run, F.col("channel").alias("raw_channel"), "std_channel", "multiplier")
    points = cut_to_files(_finite_channels(raw_to_standard(map_channels(means, mapping, run, ["segment"], sorted(RAW.values())), temp)))
    factors = cut_to_files(infer_multiplier(points, sample, condition, temp))
    points = cut_to_files(enforce_trend(factors, sample, condition, temp))
    factor = points.select(*seg, F.col("multiplier").alias("decade"))
    wide = map_channels(rows, mapping, run, ["segment", "row_idx", "t"], sorted(RAW.values()))
    std = cut_to_files(_finite_channels(raw_to_standard(attach(wide, factor, seg), temp, "decade")))
    cleaned = clean_segments(std, seg, ["row_idx"], "voltage", "current", "t", **(clean or {}))
    if smooth:
        for c in ("voltage", "current", "resistance"):
            cleaned = savgol_fraction(cleaned, seg, ["row_idx"], c, smooth, 2, name="_s").withColumn(c, F.col("_s")).drop("_s")
    cleaned = cut_to_files(cleaned)
    verdict = cut_to_files(decay_verdict(cleaned, seg, ["row_idx"], "t", "resistance", "voltage", [sample, condition, temp], min_slope))
    # The caller's plan splits the rows, so it is told here that the verdict has a row for every segment.
    good, bad = split_by_verdict(cleaned, verdict.hint("merge"), seg)
    return {"points": points, "channel_map": mapping, "segments": good, "rejected": bad, "verdict": verdict}


def point_trends(tables: dict[str, DataFrame], keys: Sequence[str], temp: str, columns: Sequence[str], reference: str, error: str | None = None) -> DataFrame:
    """Arrhenius trends of several point tables in one job.

    The tables are stacked with a `kind`; each row also counts for its
    polarity and for the groups by every key prefix and every single key.
    Output: kind, group_id, column, n, A, Ea, r2, rss, aicc. Without errors
    the rows are reduced once to moments per finest group and temperature,
    and only these take part in all groups (`arrhenius_rollup`); weights from
    errors belong to a group, so rows with errors do.
    """
    keys = list(keys)
    parts = []
    for kind, df in tables.items():
        sel = [*keys, temp, *columns, reference, *([error] if error and error in df.columns else [])]
        parts.append(df.select(*dict.fromkeys(sel)).withColumn("kind", F.lit(kind)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.withColumn("_side", F.when(F.col(reference) < 0, "neg").otherwise("pos"))
    levels = [keys[:k] for k in range(1, len(keys) + 1)] + [[k] for k in keys[1:]]
    heads = [F.col("kind"), F.concat_ws(" ", "kind", "_side")]
    ids = F.array(*heads, *[F.concat_ws(" ", h, *[F.col(c).cast("string") for c in lv]) for h in heads for lv in levels])
    if error:
        return arrhenius_points(rows.withColumn("group_id", F.explode(ids)), ["kind", "group_id"], temp, columns, error)
    moments = cut_lineage(temperature_moments(rows, ["kind", "_side", *keys], temp, [c for c in columns if c in rows.columns]))
    return arrhenius_rollup(moments.withColumn("group_id", F.explode(ids)), ["kind", "group_id", "column"])
