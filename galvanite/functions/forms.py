"""Physical forms of an impedance column and the way back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.functions.complexnum import Cx
from galvanite.functions.ieee import divide
from galvanite.keyed import attach, with_group
from galvanite.operators.aggregates import edge_means

# Fixed value: vacuum permittivity of the form conversions, F/cm.
EPS0 = 8.85418782e-14

# Accepted names of each form.
FORM_NAMES = {
    "impedance": ("z", "impedance"),
    "admittance": ("y", "admittance"),
    "modulus": ("m", "modulus"),
    "capacitance": ("c", "capacitance"),
    "permittivity": ("e", "permittivity"),
    "relative_permittivity": ("e_r", "relative_permittivity"),
    "relative_permittivity_corrected": ("e_r_corr", "relative_permittivity_corrected"),
    "susceptibility": ("chi", "susceptibility"),
    "conductivity": ("sigma", "conductivity"),
    "resistivity": ("rho", "resistivity"),
}
NEGATIVE_IMAGINARY = ("permittivity", "relative_permittivity", "relative_permittivity_corrected", "susceptibility")
MAX_PHASE = 91.0


def form_name(name: str) -> str:
    low = name.lower()
    for form, names in FORM_NAMES.items():
        if low in names:
            return form
    raise KeyError(f"unknown form {name!r}")


class Sample:
    """Columns that the conversions need: frequency, area, thickness."""

    def __init__(self, freq: Column, area: Column | float = 1.0, thickness: Column | float = 1.0,
                 sigma_dc: Column | None = None, eps_inf: Column | None = None):
        self.omega = 2 * F.pi() * freq
        area = area if isinstance(area, Column) else F.lit(float(area))
        thickness = thickness if isinstance(thickness, Column) else F.lit(float(thickness))
        self.a_d = area / thickness
        self.c0 = EPS0 * self.a_d
        self.mu = Cx(F.lit(0.0), self.omega * self.c0)
        self.sigma_dc = sigma_dc
        self.eps_inf = eps_inf


def from_impedance(z: Cx, form: str, s: Sample) -> Cx:
    """Any of the ten forms as columns; e_r(corr) and chi need the sample's
    dc conductivity and high-frequency permittivity columns."""
    form = form_name(form)
    if form == "impedance":
        return z
    if form == "admittance":
        return z.inverse()
    if form == "modulus":
        return s.mu * z
    if form == "capacitance":
        return _inverse_of_j(z, s.omega)
    if form == "conductivity":
        return z.inverse() / s.a_d
    if form == "resistivity":
        return z * s.a_d
    e_r = _inverse_of_j(z, s.omega * s.c0)
    if form == "permittivity":
        e_r = e_r * EPS0
    elif form == "relative_permittivity_corrected":
        e_r = Cx(e_r.re, e_r.im + dc_loss(s))
    elif form == "susceptibility":
        e_r = Cx(e_r.re - s.eps_inf, e_r.im)
    return e_r.with_sign(-1)


def _inverse_of_j(z: Cx, k: Column) -> Cx:
    """1 / (j k z); infinite at k = 0."""
    m = k * (z.re * z.re + z.im * z.im)
    return Cx(divide(-z.im, m), divide(-z.re, m))


def dc_loss(s: Sample) -> Column:
    """Loss of the dc conductivity: sigma_dc / (eps0 omega)."""
    return divide(s.sigma_dc, EPS0 * s.omega)


def to_impedance(x: Cx, form: str, s: Sample) -> Cx:
    """Inverse of `from_impedance`."""
    form = form_name(form)
    x = x.with_sign(1)
    if form == "impedance":
        return x
    if form == "admittance":
        return x.inverse()
    if form == "modulus":
        return x / s.mu
    if form == "capacitance":
        return (Cx(F.lit(0.0), s.omega) * x).inverse()
    if form == "conductivity":
        return (x * s.a_d).inverse()
    if form == "resistivity":
        return x / s.a_d
    if form == "permittivity":
        return EPS0 / (s.mu * x)
    if form == "relative_permittivity":
        return (s.mu * x).inverse()
    if form == "susceptibility":
        return (s.mu * Cx(x.re + s.eps_inf, x.im)).inverse()
    # e_r(corr) = e_r + j sigma/(eps0 w), and mu * j sigma/(eps0 w) = -sigma A/d.
    return (s.mu * x + Cx(s.sigma_dc * s.a_d, F.lit(0.0))).inverse()


def loss_forms(z: Cx, s: Sample) -> dict[str, Column]:
    e_r = from_impedance(z, "relative_permittivity", s)
    return {
        "dissipation_factor": F.try_divide(e_r.imag, e_r.real),
        "loss_index": e_r.imag,
        "loss_angle": e_r.phase,
    }


def signed_log(x: Column, base10: bool = False) -> Column:
    """Log of |x| with the sign of x put back; zero stays zero."""
    fn = F.log10 if base10 else F.log
    return F.when(x == 0, 0.0).when(x < 0, -fn(-x)).otherwise(fn(F.when(x > 0, x)))


def with_edge_constants(
    df: DataFrame, keys: Sequence[str], freq: Sequence[str], re: str, im: str,
    area: Column | float = 1.0, thickness: Column | float = 1.0, perc: float = 5.0,
) -> DataFrame:
    """Add `sigma_dc` and `eps_inf` of each dataset from its edge rows; rows without a frequency come after the highest one."""
    z = Cx(F.col(re), F.col(im))
    s = Sample(F.col(freq[0]), area, thickness)
    rows = df.withColumn("_sig", from_impedance(z, "conductivity", s).re).withColumn(
        "_eps", from_impedance(z, "relative_permittivity", s).re
    )
    edge = edge_means(rows.withColumn("_none", F.col(freq[0]).isNull()), keys, ["_none", *freq], {"_sig": "sig", "_eps": "eps"}, perc)
    edge = edge.select(*keys, F.col("sig_zero").alias("sigma_dc"), F.col("eps_infinity").alias("eps_inf"))
    return attach(df, edge, keys)


def with_forms(
    df: DataFrame, freq: str, re: str, im: str, wanted: dict[str, str],
    area: Column | float = 1.0, thickness: Column | float = 1.0,
) -> DataFrame:
    """Add columns for wanted parts: name -> `form.part` or an expression.

    A part like `Z.real` is replaced by its column inside a Spark SQL
    expression, so `log10(Z.mag)` or `abs(M.imag)/2` work as written. The
    logarithm of zero is minus infinity.
    """
    import re as regex

    z = Cx(F.col(re), F.col(im))
    s = Sample(F.col(freq), area, thickness,
               F.col("sigma_dc") if "sigma_dc" in df.columns else None,
               F.col("eps_inf") if "eps_inf" in df.columns else None)
    found: dict[str, Column] = {}
    texts = {}
    for name, text in wanted.items():
        def swap(m):
            token = f"_f_{m.group(1)}_{m.group(2)}"
            found[token] = from_impedance(z, m.group(1), s).part(m.group(2))
            return token

        texts[name] = _logs_of_zero(regex.sub(r"\b([A-Za-z_]\w*)\.(real|imag|mag|phase|slope)\b", swap, text))
    out = df.select("*", *[c.alias(t) for t, c in found.items()])
    return out.select("*", *[F.expr(t).alias(n) for n, t in texts.items()]).drop(*found)


def _logs_of_zero(text: str) -> str:
    """The expression with log10(x), log2(x) and ln(x) giving minus infinity at x = 0."""
    import re as regex

    for found in reversed(list(regex.finditer(r"\b(log10|log2|ln)\s*\(", text))):
        depth, end = 1, found.end()
        while depth and end < len(text):
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        arg = text[found.end():end - 1]
        if depth == 0:
            text = f"{text[:found.start()]}(CASE WHEN ({arg}) = 0 THEN -double('infinity') ELSE {found.group(1)}({arg}) END){text[end:]}"
    return text


def convert_checked(
    df: DataFrame, keys: Sequence[str], freq: str, re: str, im: str, from_form: str, to_form: str,
    area: Column | float = 1.0, thickness: Column | float = 1.0,
) -> DataFrame:
    """Convert between forms; a dataset whose phases leave +-91 degrees in some
    form is taken as conjugated and converted again. Adds `re_out`, `im_out`,
    `conjugated` and `phase_ok`.
    """
    s = Sample(F.col(freq), area, thickness,
               F.col("sigma_dc") if "sigma_dc" in df.columns else F.lit(0.0),
               F.col("eps_inf") if "eps_inf" in df.columns else F.lit(0.0))
    base = Cx(F.col(re), F.col(im))
    forms = [f for f in FORM_NAMES if f not in ("relative_permittivity_corrected", "susceptibility")]
    rows = df
    for tag, x in (("a", base), ("b", base.conj())):
        z = to_impedance(x, from_form, s)
        rows = rows.withColumn(f"_re_{tag}", z.re).withColumn(f"_im_{tag}", z.im)
        zc = Cx(F.col(f"_re_{tag}"), F.col(f"_im_{tag}"))
        # A value of zero has no phase in some forms.
        worst = F.greatest(*[F.nanvl(F.abs(from_impedance(zc, f, s).phase), F.lit(None)) for f in forms])
        rows = rows.withColumn(f"_w_{tag}", worst)
    rows = with_group(
        rows, keys,
        F.coalesce(F.bool_and(F.col("_w_a") <= MAX_PHASE), F.lit(True)).alias("_ok_a"),
        F.coalesce(F.bool_and(F.col("_w_b") <= MAX_PHASE), F.lit(True)).alias("_ok_b"),
    )
    conj = ~F.col("_ok_a")
    z = Cx(F.when(conj, F.col("_re_b")).otherwise(F.col("_re_a")), F.when(conj, F.col("_im_b")).otherwise(F.col("_im_a")))
    out = from_impedance(z, to_form, s)
    return rows.select(
        *df.columns, out.re.alias("re_out"), out.im.alias("im_out"), conj.alias("conjugated"),
        (F.col("_ok_a") | F.col("_ok_b")).alias("phase_ok"),
    )
