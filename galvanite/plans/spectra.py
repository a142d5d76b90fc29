"""Fourier transforms per key: chosen bins as sums, full spectra as kernels.

A full spectrum of a key within the group limit is one FFT. A longer key is
transformed by the chirp method over a power-of-two length, whose FFTs run as
two grouped passes of about sqrt(n) rows each, so no task holds the series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.functions.units import log_grid
from galvanite.keyed import Ordered, attach, checked_once, has_hot_group, map_keys, quantiles, with_group
from galvanite.operators.windows import downsample
from galvanite.plans.decays import spread_by_points
from galvanite.plans.interpolation import interpolate_at
from galvanite.session import cut_lineage, group_limit


def dft_bins(df: DataFrame, keys: Sequence[str], i: str, n: str, value: str, bins: Sequence[int]) -> DataFrame:
    """Chosen DFT bins of every key, all of them in one aggregation.

    The angle uses (k i) mod n, so it stays exact for long series.
    """
    v = F.col(value).cast("double")
    aggs = []
    for k in bins:
        ang = 2 * F.pi() * ((F.lit(int(k)) * F.col(i)) % F.col(n)) / F.col(n)
        aggs += [F.sum(v * F.cos(ang)).alias(f"_c{k}"), (-F.sum(v * F.sin(ang))).alias(f"_s{k}")]
    got = df.groupBy(*keys).agg(F.max(n).alias("n"), *aggs)
    items = F.array(*[
        F.struct(F.lit(int(k)).alias("k"), F.col(f"_c{k}").alias("re"), F.col(f"_s{k}").alias("im")) for k in bins
    ])
    return got.select(*keys, "n", F.explode(items).alias("_x")).select(*keys, "n", "_x.*").where(F.col("k") < F.col("n"))


def _fields(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{k}` {types[k]}, " for k in keys)


def spectrum(df: DataFrame, keys: Sequence[str], i: str, value: str, limit: int | None = None) -> DataFrame:
    """Full DFT of every key: (keys, bin, re, im). `i` is the 0-based position."""
    keys = list(keys)
    limit = limit or group_limit(df.sparkSession)
    rows = df.select(*keys, F.col(i).cast("long").alias("_i"), F.col(value).cast("double").alias("_v"))

    def whole(_: np.ndarray, v: np.ndarray) -> tuple[None, list[np.ndarray]]:
        z = np.fft.fft(v)
        return None, [np.arange(len(z)), z.real, z.imag]

    def fft(part: DataFrame) -> DataFrame:
        out = map_keys(part, keys, ["_i"], ["_i", "_v"], whole, "bin double, re double, im double")
        return out.select(*keys, F.col("bin").cast("long").alias("bin"), "re", "im")

    if not has_hot_group(df, keys, limit):
        return fft(rows)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    short = attach(rows, sizes.where(F.col("_n") <= limit), keys, "left_semi")
    long = attach(rows, sizes.where(F.col("_n") > limit), keys, "inner")
    return fft(short).unionByName(_chirp(long, keys))


def _chirp(rows: DataFrame, keys: list[str]) -> DataFrame:
    """DFT of arbitrary length by a convolution of power-of-two length."""
    n, j = F.col("_n"), F.col("_i")
    size = F.pow(F.lit(2.0), F.ceil(F.log2((2 * n - 1).cast("double")))).cast("long")
    ang = F.pi() * ((j * j) % (2 * n)) / n
    a = rows.select(*keys, "_n", size.alias("_m"), "_i", (F.col("_v") * F.cos(ang)).alias("re"), (-F.col("_v") * F.sin(ang)).alias("im"))
    heads = a.select(*keys, "_n", "_m").distinct()
    # The chirp is made in slices, so no row carries a long array.
    slices = heads.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(4096).cast("long"))).alias("_s"))
    idx = slices.select(
        *keys, "_n", "_m", F.explode(F.sequence(F.col("_s"), F.least(F.col("_s") + 4095, n - 1))).alias("_j")
    )
    wave = F.pi() * ((F.col("_j") * F.col("_j")) % (2 * n)) / n
    sides = F.when(F.col("_j") == 0, F.array(F.col("_j"))).otherwise(F.array(F.col("_j"), F.col("_m") - F.col("_j")))
    b = idx.select(*keys, "_n", "_m", F.explode(sides).alias("_i"), F.cos(wave).alias("re"), F.sin(wave).alias("im"))
    fa, fb = _two_pass(a, keys, -1), _two_pass(b, keys, -1)
    fb = fb.select(*keys, "_i", F.col("re").alias("_br"), F.col("im").alias("_bi"))
    prod = attach(fa, fb, [*keys, "_i"], "inner").select(
        *keys, "_n", "_m", "_i",
        (F.col("re") * F.col("_br") - F.col("im") * F.col("_bi")).alias("re"),
        (F.col("re") * F.col("_bi") + F.col("im") * F.col("_br")).alias("im"),
    )
    conv = _two_pass(prod, keys, 1).where(F.col("_i") < n)
    ang = F.pi() * ((j * j) % (2 * n)) / n
    re, im = F.col("re") / F.col("_m"), F.col("im") / F.col("_m")
    return conv.select(
        *keys, F.col("_i").alias("bin"),
        (re * F.cos(ang) + im * F.sin(ang)).alias("re"), (im * F.cos(ang) - re * F.sin(ang)).alias("im"),
    )


def _two_pass(rows: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """Unscaled FFT of length _m = 2^p by columns and then rows of a matrix.

    Missing positions count as zero. Every group has at most 2^ceil(p/2) rows.
    """
    half = F.pow(F.lit(2.0), F.floor(F.log2(F.col("_m").cast("double")) / 2)).cast("long")
    cut = rows.withColumn("_p", half)
    schema = _fields(rows, keys) + "_n long, _m long, _p long, _g long, _q long, re double, im double"

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        m, p, g = int(pdf["_m"].iloc[0]), int(pdf["_p"].iloc[0]), int(pdf["_g"].iloc[0])
        rest = m // p
        z = np.zeros(p, dtype=complex)
        z[pdf["_q"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        z = np.fft.fft(z) if sign < 0 else np.fft.ifft(z) * p
        k1 = np.arange(p)
        z = z * np.exp(sign * 2j * np.pi * ((k1 * g) % m) / m)
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * p for k in [*keys, "_n"]})
        out["_m"], out["_p"], out["_g"], out["_q"] = m, p, k1, g
        out["re"], out["im"] = z.real, z.imag
        return out[[*keys, "_n", "_m", "_p", "_g", "_q", "re", "im"]]

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        m, p, k1 = int(pdf["_m"].iloc[0]), int(pdf["_p"].iloc[0]), int(pdf["_g"].iloc[0])
        rest = m // p
        z = np.zeros(rest, dtype=complex)
        z[pdf["_q"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        z = np.fft.fft(z) if sign < 0 else np.fft.ifft(z) * rest
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * rest for k in [*keys, "_n"]})
        out["_m"], out["_i"] = m, k1 + p * np.arange(rest)
        out["re"], out["im"] = z.real, z.imag
        return out[[*keys, "_n", "_m", "_i", "re", "im"]]

    rest = (F.col("_m") / F.col("_p")).cast("long")
    first = cut.select(*keys, "_n", "_m", "_p", (F.col("_i") % rest).alias("_g"), F.floor(F.col("_i") / rest).alias("_q"), "re", "im")
    mid = first.groupBy(*keys, "_g").applyInPandas(columns, schema)
    return mid.groupBy(*keys, "_g").applyInPandas(lines, _fields(rows, keys) + "_n long, _m long, _i long, re double, im double")


def detect_period(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Dominant period of every series with strength, snr and sharpness.

    Standardised values, largest non-dc bin below n/2; noise is the 90th
    percentile of the other bins, sharpness the ratio to the neighbours;
    strength = sharpness / snr; period = int(n / k / 2).
    """
    rows = Ordered(df, keys, order).positions("_i", "_n")
    v = F.col(value).cast("double")
    rows = with_group(rows, keys, F.avg(v).alias("_mu"), F.stddev_pop(v).alias("_sd"))
    scale = F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    rows = rows.withColumn("_z", (v - F.col("_mu")) / scale)
    rows = cut_lineage(rows)
    spec = cut_lineage(spectrum(rows, keys, "_i", "_z"))
    sizes = rows.groupBy(*keys).agg(F.max("_n").alias("n"))
    spec = attach(spec, sizes, keys).where((F.col("bin") >= 1) & (F.col("bin") < F.floor(F.col("n") / 2)))
    spec = spec.withColumn("mag", F.hypot("re", "im"))
    top = spec.groupBy(*keys).agg(F.min_by(F.struct("bin", "mag"), F.struct(-F.col("mag"), F.col("bin"))).alias("_p"))
    spec = attach(spec, top, keys)
    others = spec.where(F.col("bin") != F.col("_p.bin"))
    noise = quantiles(others, keys, "mag", {"noise": 0.9})
    near = spec.groupBy(*keys).agg(
        F.max("_p.bin").alias("bin"), F.max("_p.mag").alias("peak"), F.max("n").alias("n"),
        F.avg(F.when(F.abs(F.col("bin") - F.col("_p.bin")) == 1, F.col("mag"))).alias("_near"),
    )
    out = attach(near, noise, keys)
    sharp = F.col("peak") / (F.coalesce("_near", F.lit(1e-12)) + 1e-12)
    snr = F.when(F.coalesce("noise", F.lit(0.0)) == 0, 0.0).otherwise(F.try_divide(F.col("peak"), F.col("noise")))
    out = out.select(
        *keys, "n", F.floor(F.col("n") / F.col("bin") / 2).cast("long").alias("period"), snr.alias("snr"), sharp.alias("sharpness"),
    )
    return attach(sizes.select(*keys), out.withColumn(
        "strength", F.col("sharpness") / F.when(F.col("snr") > 0, F.col("snr")).otherwise(1e-12)
    ), keys)


def permittivity(
    decay: DataFrame, keys: Sequence[str], resample: str | None = "log", max_points: int = 500, method: str = "cubic"
) -> DataFrame:
    """Spectrum of prepared decays (keys, i, dt, decay, n) at freq >= 0.

    `resample` puts n values on a log (or linear) grid from the first
    positive to the last frequency; then points are thinned by position.
    """
    decay = cut_lineage(decay)
    # Knots and grid of a key are at most twice its rows, taken together.
    with checked_once(decay, keys, growth=2):
        return _permittivity(decay, keys, resample, max_points, method)


def _permittivity(decay: DataFrame, keys: Sequence[str], resample: str | None, max_points: int, method: str) -> DataFrame:
    sizes = decay.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("dt").alias("dt"))
    spec = attach(spectrum(decay, keys, "i", "decay"), sizes, keys)
    spec = spec.where(F.col("bin") <= F.floor((F.col("n") - 1) / 2)).withColumn("freq", F.col("bin") / (F.col("n") * F.col("dt")))
    spec = cut_lineage(spec.withColumn("mag", F.hypot("re", "im")).withColumn("phase", F.degrees(F.atan2("im", "re"))))
    if resample:
        ends = spec.groupBy(*keys).agg(
            F.greatest(F.min(F.when(F.col("freq") > 0, F.col("freq"))), F.lit(1e-10)).alias("_lo"), F.max("freq").alias("_hi"),
            F.max("n").alias("n"), F.max("dt").alias("dt"),
        )
        if resample == "log":
            lo, hi = F.log10("_lo"), F.log10("_hi")
            step = F.try_divide(hi - lo, (F.col("n") - 1).cast("double"))
            at = F.pow(F.lit(10.0), lo + F.col("_j") * step)
        else:
            at = F.col("_lo") + F.col("_j") * F.try_divide(F.col("_hi") - F.col("_lo"), (F.col("n") - 1).cast("double"))
        ends = spread_by_points(cut_lineage(ends), F.col("n"))
        j = F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))
        grid = ends.withColumn("_j", j).select(*keys, "n", "dt", at.alias("freq"))
        values = interpolate_at(spec, grid, keys, "freq", ["re", "im", "mag", "phase"], method)
        out = attach(grid.distinct(), values, [*keys, "freq"])
    else:
        out = spec.select(*keys, "n", "dt", "freq", "re", "im", "mag", "phase")
    out = out.withColumn("loss", F.try_divide(F.col("im"), F.when(F.col("re") != 0, F.col("re")).otherwise(1e-32)))
    out = cut_lineage(out)
    return downsample(out, keys, ["freq"], max_points, F.col("dt")) if max_points else out


def permittivity_limits(perm: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values at the lowest and highest frequency and the negative share."""
    return perm.groupBy(*keys).agg(
        F.min_by("re", "freq").alias("dc_real"), F.min_by("im", "freq").alias("dc_imag"),
        F.max_by("re", "freq").alias("inf_real"), F.max_by("im", "freq").alias("inf_imag"),
        F.avg((F.col("re") < 0).cast("double")).alias("negative_share"),
    )
