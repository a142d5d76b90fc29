"""Raw channels to standard ones, bounds and deviations of parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.functions.ieee import divide
from galvanite.functions.units import millivolt_to_celsius
from galvanite.keyed import attach, quantiles, with_group

ROOT2 = math.sqrt(2.0)
# Nominal voltage, current above which a decade factor applies,
# temperature below which a reading is a thermocouple voltage, cold junction.
NOMINAL_VOLTAGE = 2.0
FACTOR_CURRENT = 1e-8
THERMO_LIMIT = 10.0
COLD_JUNCTION = 30.0

RAW = {
    "voltage": "raw_voltage", "voltage_abs": "raw_voltage_abs", "voltage_rms": "raw_voltage_rms",
    "current": "raw_current", "current_abs": "raw_current_abs", "current_rms": "raw_current_rms",
    "resistance": "raw_resistance", "temperature": "raw_temperature",
}


def raw_to_standard(df: DataFrame, temp: str | None = None, multiplier: str | None = None, t_factor: float = 1e3) -> DataFrame:
    """Fill standard channels from whatever raw channels exist.

    Sign: the first of raw V, V rms, I, I rms; NaN has none (0). Voltage: raw, |raw| * sign,
    rms / sqrt 2, nominal. Current likewise, then V / R. Resistance: raw,
    then V / I (infinite or NaN at I = 0). Readings below 10 degrees are thermocouple millivolts.
    """
    raw = {k: (F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")) for k, c in RAW.items()}
    sign = F.nanvl(F.signum(F.coalesce(raw["voltage"], raw["voltage_rms"], raw["current"], raw["current_rms"], F.lit(1.0))), F.lit(0.0))
    factor = F.coalesce(F.col(multiplier).cast("double"), F.lit(1.0)) if multiplier else F.lit(1.0)
    set_temp = F.col(temp).cast("double") if temp else F.lit(0.0)

    def scaled(c: Column) -> Column:
        return F.when((factor != 1) & (F.abs(c) > FACTOR_CURRENT), c * factor).otherwise(c)

    out = df.withColumn(
        "voltage",
        F.coalesce(raw["voltage"], raw["voltage_abs"] * sign, raw["voltage_rms"] / ROOT2, NOMINAL_VOLTAGE * sign),
    )
    current = F.coalesce(
        raw["current"], raw["current_abs"] * sign, raw["current_rms"] / ROOT2, divide(F.col("voltage"), raw["resistance"])
    )
    out = out.withColumn("_current", current).withColumn("current", scaled(F.col("_current"))).drop("_current")
    out = out.withColumn("resistance", F.coalesce(raw["resistance"], divide(F.col("voltage"), F.col("current"))))
    reading = F.coalesce(F.abs(raw["temperature"] * t_factor), set_temp)
    out = out.withColumn("_reading", reading).withColumn(
        "temperature",
        F.when(F.col("_reading") < THERMO_LIMIT, millivolt_to_celsius(F.col("_reading"), COLD_JUNCTION)).otherwise(F.col("_reading")),
    ).drop("_reading")
    return out.select(
        "*",
        F.coalesce(raw["voltage_rms"], F.col("voltage") * ROOT2).alias("voltage_rms"),
        scaled(F.coalesce(raw["current_rms"], F.col("current") * ROOT2)).alias("current_rms"),
        F.coalesce(raw["voltage_abs"], F.abs("voltage")).alias("voltage_abs"),
        scaled(F.coalesce(raw["current_abs"], F.abs("current"))).alias("current_abs"),
    )


def spacing(x: Column) -> Column:
    """Distance to the next double: 2^(floor(log2|x|) - 52)."""
    return F.when(x == 0, 5e-324).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(F.nullif(x, F.lit(0.0))))) - 52))


def ordered_bounds(lb: Column, p0: Column, ub: Column, multiply: bool = True, shift: float = 1e-14) -> tuple[Column, Column, Column]:
    """lb <= p0 <= ub: widen equal bounds, swap inverted ones, clip the value."""
    step = F.abs(lb) * shift if multiply else F.lit(shift)
    lo = F.when(lb == ub, lb - step).when(lb > ub, ub).otherwise(lb)
    hi = F.when(lb == ub, ub + step).when(lb > ub, lb).otherwise(ub)
    val = F.least(F.greatest(p0, lo + spacing(lo) * 100), hi - spacing(hi) * 100)
    return lo, F.when(p0.isNotNull(), val), hi


def validate_bounds(df: DataFrame, multiply: bool = True) -> DataFrame:
    lo, val, hi = ordered_bounds(F.col("lb"), F.col("p0"), F.col("ub"), multiply)
    rest = [c for c in df.columns if c not in ("lb", "p0", "ub")]
    return df.select(*rest, lo.alias("lb"), val.alias("p0"), hi.alias("ub"))


def separate_pair(df: DataFrame, keys: Sequence[str], low: str, high: str, geometric: bool = True) -> DataFrame:
    """Split the bounds of two neighbouring parameters at a common midpoint.

    Wide input with `lb_x, p0_x, ub_x` for x = low, high (magnitudes). The
    midpoint comes from the nearest values when they do not overlap, else
    from the trimmed quantiles of both; a bound that would invert keeps its
    former ratio (or distance).
    """
    names = [f"{b}_{x}" for x in (low, high) for b in ("lb", "p0", "ub")]
    rows = df
    for x in (low, high):
        lo, val, hi = ordered_bounds(F.abs(F.col(f"lb_{x}")), F.abs(F.col(f"p0_{x}")), F.abs(F.col(f"ub_{x}")), geometric)
        rows = rows.withColumns({f"lb_{x}": lo, f"p0_{x}": val, f"ub_{x}": hi})
    rows = with_group(
        rows, keys,
        F.max(f"ub_{low}").alias("_ub_low"), F.min(f"lb_{high}").alias("_lb_high"),
        F.max(f"p0_{low}").alias("_p_low"), F.min(f"p0_{high}").alias("_p_high"),
    )
    scale = (lambda c: F.log10(F.when(c > 0, c))) if geometric else (lambda c: c)
    back = (lambda c: F.pow(F.lit(10.0), c)) if geometric else (lambda c: c)
    rows = rows.withColumns({"_s_low": scale(F.col(f"p0_{low}")), "_s_high": scale(F.col(f"p0_{high}"))})
    q_low = quantiles(rows, keys, "_s_low", {"_a1": 0.25, "_a2": 0.75})
    q_high = quantiles(rows, keys, "_s_high", {"_b1": 0.25, "_b2": 0.75})
    rows = attach(attach(rows, q_low, keys), q_high, keys)
    near = (scale(F.col("_p_low")) + scale(F.col("_p_high"))) / 2
    trimmed = (F.col("_a1") + F.col("_a2") + F.col("_b1") + F.col("_b2")) / 4
    mid = back(F.when(F.col("_p_low") <= F.col("_p_high"), near).otherwise(trimmed))
    clash = F.col("_ub_low") > F.col("_lb_high")
    if geometric:
        new_lb_low = mid * F.try_divide(F.col(f"lb_{low}"), F.col(f"ub_{low}"))
        new_ub_high = mid * F.try_divide(F.col(f"ub_{high}"), F.col(f"lb_{high}"))
    else:
        new_lb_low = mid - (F.col(f"ub_{low}") - F.col(f"lb_{low}"))
        new_ub_high = mid + (F.col(f"ub_{high}") - F.col(f"lb_{high}"))
    return rows.select(
        *[c for c in df.columns if c not in names],
        F.when(clash & (F.col(f"lb_{low}") > mid), new_lb_low).otherwise(F.col(f"lb_{low}")).alias(f"lb_{low}"),
        F.col(f"p0_{low}"),
        F.when(clash, mid).otherwise(F.col(f"ub_{low}")).alias(f"ub_{low}"),
        F.when(clash, mid).otherwise(F.col(f"lb_{high}")).alias(f"lb_{high}"),
        F.col(f"p0_{high}"),
        F.when(clash & (F.col(f"ub_{high}") < mid), new_ub_high).otherwise(F.col(f"ub_{high}")).alias(f"ub_{high}"),
    )


# Fixed value: largest power of ten of a default bound (308 / 4).
MAX_POWER = 77.0


def banded_values(
    df: DataFrame, factors: tuple[float, float] = (0.1, 10.0), rebound_unlocked: bool = False, shift_band: bool = False
) -> DataFrame:
    """Fill and order `bnd_low`, `value`, `bnd_high`, `std` of parameter rows.

    Missing bounds are factors of the value; infinite and zero bounds become
    large and small numbers; then either the bounds widen (`shift_band`) or
    the value is clipped when any row of the table is out of its bounds.
    """
    v = F.col("value").cast("double")
    big, small = 10.0**MAX_POWER, 10.0**-MAX_POWER
    lo = F.coalesce(F.col("bnd_low"), factors[0] * v, F.lit(small))
    hi = F.coalesce(F.col("bnd_high"), factors[1] * v, F.lit(big))
    if rebound_unlocked:
        lo = F.when(~F.coalesce("bnd_low_lock", F.lit(False)), factors[0] * v).otherwise(lo)
        hi = F.when(~F.coalesce("bnd_high_lock", F.lit(False)), factors[1] * v).otherwise(hi)
    lo = F.when(lo == float("-inf"), -big).when(lo == 0, small).otherwise(lo)
    hi = F.when(hi == float("inf"), big).otherwise(hi)
    rows = df.withColumn("bnd_low", lo).withColumn("bnd_high", hi)
    lo, hi = F.col("bnd_low"), F.col("bnd_high")
    if shift_band:
        low, high = F.least(lo, v), F.greatest(hi, v)
        new = (low - spacing(low), v, high + spacing(high))
    else:
        new = (lo, F.when(v.isNotNull(), F.least(F.greatest(v, lo + spacing(lo)), hi - spacing(hi))), hi)
    rows = rows.select(
        *[c for c in rows.columns if c not in ("bnd_low", "bnd_high", "value")],
        new[0].alias("bnd_low"), F.coalesce(new[1], (lo + hi) / 2).alias("value"), new[2].alias("bnd_high"),
    )
    return rows.withColumn("std", F.coalesce("std", F.col("value") * 0.1))


def sane_std(value: Column, std: Column) -> Column:
    """0 when the value is 0 or the deviation is out of proportion."""
    ratio = F.log10(F.abs(F.try_divide(F.nullif(std, F.lit(0.0)), value)))
    k = F.greatest(F.floor(F.abs(F.log10(F.abs(F.nullif(value, F.lit(0.0)))))), F.lit(6))
    return F.when(value == 0, 0.0).when((ratio > k * 0.75) | (ratio < -k), 0.0).otherwise(std)
