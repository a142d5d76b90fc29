"""Unit factors, thermocouple polynomials and frequency grids as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# SI factor and dimension of the accepted units.
UNITS = {
    "m": (1.0, "length"), "km": (1e3, "length"), "cm": (1e-2, "length"), "mm": (1e-3, "length"),
    "um": (1e-6, "length"), "nm": (1e-9, "length"), "inch": (0.0254, "length"), "ft": (0.3048, "length"),
    "s": (1.0, "time"), "ms": (1e-3, "time"), "us": (1e-6, "time"), "ns": (1e-9, "time"),
    "min": (60.0, "time"), "hour": (3600.0, "time"), "day": (86400.0, "time"),
    "kg": (1.0, "mass"), "g": (1e-3, "mass"), "mg": (1e-6, "mass"),
    "V": (1.0, "voltage"), "mV": (1e-3, "voltage"), "kV": (1e3, "voltage"),
    "A": (1.0, "current"), "mA": (1e-3, "current"), "uA": (1e-6, "current"), "nA": (1e-9, "current"),
    "ohm": (1.0, "resistance"), "kohm": (1e3, "resistance"), "Mohm": (1e6, "resistance"),
    "F": (1.0, "capacitance"), "uF": (1e-6, "capacitance"), "nF": (1e-9, "capacitance"), "pF": (1e-12, "capacitance"),
    "Hz": (1.0, "frequency"), "kHz": (1e3, "frequency"), "MHz": (1e6, "frequency"),
    "J": (1.0, "energy"), "eV": (1.602176634e-19, "energy"),
    "K": (1.0, "temperature"),
}
NUMBER_UNIT = r"^\s*([+-]?\d*\.?\d+(?:[eE][+-]?\d+)?)?\s*[\[\(]?([A-Za-z]+)(?:\^|\*\*)?([+-]?\d+)?[\]\)]?\s*$"


def _table(part: int) -> Column:
    return F.create_map(*[F.lit(x) for u, v in UNITS.items() for x in (u, v[part])])


def convert_units(value: Column, unit_from: Column | str, unit_to: Column | str, exponent: int | Column = 1) -> Column:
    """Value in another unit (to a power); null for unlike or unknown units."""
    a = F.lit(unit_from) if isinstance(unit_from, str) else unit_from
    b = F.lit(unit_to) if isinstance(unit_to, str) else unit_to
    factors, dims = _table(0), _table(1)
    ratio = F.try_divide(factors[a], factors[b])
    return F.when(dims[a] == dims[b], value * F.pow(ratio, exponent if isinstance(exponent, Column) else F.lit(exponent)))


def parse_quantity(text: Column) -> Column:
    """struct(number, unit, exponent) of text like `2.5 cm^2` or `25 [mm]`."""
    num = F.regexp_extract(text, NUMBER_UNIT, 1)
    power = F.regexp_extract(text, NUMBER_UNIT, 3)
    return F.when(
        text.rlike(NUMBER_UNIT),
        F.struct(
            F.when(num == "", 1.0).otherwise(num.try_cast("double")).alias("number"),
            F.regexp_extract(text, NUMBER_UNIT, 2).alias("unit"),
            F.when(power == "", 1).otherwise(power.try_cast("int")).alias("exponent"),
        ),
    )


def convert_quantity(text: Column, unit_to: str) -> Column:
    q = parse_quantity(text)
    return convert_units(q["number"], q["unit"], unit_to, q["exponent"])


# ITS-90 type K reference functions (NIST), powers ascending.
K_FORWARD_NEGATIVE = (
    0.0, 0.394501280250e-01, 0.236223735980e-04, -0.328589067840e-06, -0.499048287770e-08, -0.675090591730e-10,
    -0.574103274280e-12, -0.310888728940e-14, -0.104516093650e-16, -0.198892668780e-19, -0.163226974860e-22,
)
K_FORWARD_POSITIVE = (
    -0.176004136860e-01, 0.389212049750e-01, 0.185587700320e-04, -0.994575928740e-07, 0.318409457190e-09,
    -0.560728448890e-12, 0.560750590590e-15, -0.320207200030e-18, 0.971511471520e-22, -0.121047212750e-25,
)
K_EXPONENTIAL = (0.118597600000, -0.118343200000e-03, 0.126968600000e03)
K_INVERSE = (
    (-5.891, 0.0, (0.0, 2.5173462e01, -1.1662878, -1.0833638, -8.9773540e-01, -3.7342377e-01, -8.6632643e-02,
                   -1.0450598e-02, -5.1920577e-04)),
    (0.0, 20.644, (0.0, 2.508355e01, 7.860106e-02, -2.503131e-01, 8.315270e-02, -1.228034e-02, 9.804036e-04,
                   -4.413030e-05, 1.057734e-06, -1.052755e-08)),
    (20.644, 54.886, (-1.318058e02, 4.830222e01, -1.646031, 5.464731e-02, -9.650715e-04, 8.802193e-06, -3.110810e-08)),
)
K_CELSIUS_RANGE = (-270.0, 1372.0)


def _poly(x: Column, coef: Sequence[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), list(reversed(coef))[1:], F.lit(coef[-1]))


def _clamp(x: Column, lo: float, hi: float) -> Column:
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def celsius_to_millivolt(t: Column) -> Column:
    t = _clamp(t.cast("double"), *K_CELSIUS_RANGE)
    a0, a1, a2 = K_EXPONENTIAL
    warm = _poly(t, K_FORWARD_POSITIVE) + a0 * F.exp(a1 * (t - a2) * (t - a2))
    return F.when(t < 0, _poly(t, K_FORWARD_NEGATIVE)).otherwise(warm)


def millivolt_to_celsius(mv: Column, ambient: Column | float | None = None) -> Column:
    """Temperature of a type K reading; `ambient` adds the cold junction."""
    mv = mv.cast("double")
    if ambient is not None:
        mv = mv + celsius_to_millivolt(ambient if isinstance(ambient, Column) else F.lit(float(ambient)))
    mv = _clamp(mv, K_INVERSE[0][0], K_INVERSE[-1][1])
    out = _poly(mv, K_INVERSE[-1][2])
    for lo, hi, coef in reversed(K_INVERSE[:-1]):
        out = F.when(mv < hi, _poly(mv, coef)).otherwise(out)
    return out


def scale_to_target(value: Column, low: Column | float, high: Column | float, exponents: Sequence[int] = tuple(range(-9, 10))) -> Column:
    """Power of ten nearest to 0 that brings the value into [low, high]."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    ranked = sorted(exponents, key=lambda e: (abs(e), e))
    factors = F.array(*[F.lit(10.0**e) for e in ranked])
    fits = F.filter(factors, lambda f: (value * f >= low) & (value * f <= high))
    return F.try_element_at(fits, F.lit(1))


# --- grids -------------------------------------------------------------------

def log_range(start: float, stop: float, per_decade: int = 24, shift: int = 0, extend_by: int = 0,
              extend_to: float | None = None) -> tuple[float, float, int]:
    """(log10 start, log10 stop, count) of a grid; driver-side parameters only."""
    a, b = math.log10(start), math.log10(stop)
    count = int(1 + per_decade * abs(a - b))
    delta = (b - a) / (count - 1) if count > 1 else float("nan")
    a, b = a + delta * shift, b + delta * shift
    if extend_by < 0:
        a += delta * extend_by
    elif extend_by > 0:
        b += delta * extend_by
    if extend_to is not None and extend_to > 0:
        to = math.log10(extend_to)
        if to < a:
            a += delta * (1 + (to - a) // delta)
        elif to > b:
            b += delta * ((to - b) // delta)
    return a, b, math.ceil((b - a) / delta) + 1


def log_grid(lo: Column, hi: Column, count: Column) -> Column:
    """Array of `count` values from 10^lo to 10^hi, evenly spaced in log10."""
    step = F.try_divide(hi - lo, (count - 1).cast("double"))
    return F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.pow(F.lit(10.0), lo + i * F.coalesce(step, F.lit(0.0))))


def decade_grid(df: DataFrame, lo: str, hi: str, per_decade: int, name: str = "freq") -> DataFrame:
    """One row per grid frequency between two columns of each dataset."""

    @F.pandas_udf("array<double>")
    def grid(low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([_decade_points(x, y, per_decade) for x, y in zip(low, high)], dtype=object)

    return df.withColumn(name, F.explode(grid(F.col(lo).cast("double"), F.col(hi).cast("double"))))


def _decade_points(lo: float, hi: float, per_decade: int) -> list[float] | None:
    """The count is cut to a whole number, so the last bit of a logarithm decides about
    a point: the C library's one is taken, not Java's."""
    if not (0 < lo < math.inf and 0 < hi < math.inf):
        return None
    a, b = math.log10(lo), math.log10(hi)
    n = int(1 + per_decade * abs(a - b))
    return [10.0 ** (a + i * (b - a) / (n - 1)) for i in range(n)] if n > 1 else [10.0 ** a]


def time_to_frequency(dt: Column, t_max: Column) -> tuple[Column, Column]:
    """(highest, lowest) frequency of a sampling: 1/(2 dt) and 1/t_max."""
    return F.try_divide(F.lit(1.0), 2 * dt), F.try_divide(F.lit(1.0), t_max)


def frequency_to_time(f_max: Column, f_min: Column) -> tuple[Column, Column]:
    return F.try_divide(F.lit(1.0), 2 * f_max), F.try_divide(F.lit(1.0), f_min)


def significant(x: Column, decimals: int = 8) -> Column:
    """Round to `decimals - int(log10|x|)` places; 0 and null-like give 0."""
    power = F.log10(F.abs(F.nullif(x, F.lit(0.0))))
    places = decimals - F.when(power < 0, F.ceil(power)).otherwise(F.floor(power))
    scale = F.pow(F.lit(10.0), places)
    return F.when(x == 0, 0.0).otherwise(F.rint(x * scale) / scale)


# --- time models ---------------------------------------------------------------

TAU_GUARD = 1e-32


def linear_curve(t: Column, a: Column, b: Column) -> Column:
    return a * t + b


def power_curve(t: Column, a: Column, tau: Column, b: Column) -> Column:
    return a * F.pow(F.when(t == 0, TAU_GUARD).otherwise(t), -tau) + b


def _decay(t: Column, tau: Column) -> Column:
    return F.exp(-t / F.when(tau == 0, TAU_GUARD).otherwise(tau))


def exponential_curve(t: Column, a: Column, tau: Column, b: Column) -> Column:
    return a * _decay(t, tau) + b


def double_exponential_curve(t: Column, a1: Column, tau1: Column, a2: Column, tau2: Column, b: Column) -> Column:
    return a1 * _decay(t, tau1) + a2 * _decay(t, tau2) + b


def stretched_curve(t: Column, a: Column, tau: Column, beta: Column, b: Column) -> Column:
    return a * F.exp(-F.pow(t / F.when(tau == 0, TAU_GUARD).otherwise(tau), beta)) + b


def multi_exponential_curve(t: Column, params: Column) -> Column:
    """Sum over (A, tau) pairs of an array; an odd last entry is the offset."""
    pairs = F.floor(F.size(params) / 2).cast("int")
    idx = F.when(pairs > 0, F.sequence(F.lit(0), pairs - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(idx, F.lit(0.0), lambda acc, i: acc + F.get(params, 2 * i) * _decay(t, F.get(params, 2 * i + 1)))
    offset = F.when(F.size(params) % 2 == 1, F.element_at(params, -1)).otherwise(0.0)
    return total + offset
