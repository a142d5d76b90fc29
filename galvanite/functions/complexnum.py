"""Complex values as two double columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from galvanite.functions.ieee import divide


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Cx:
    """Pair of columns; `sign` -1 shows the imaginary part inverted."""

    re: Column
    im: Column
    sign: int = 1

    @staticmethod
    def of(x) -> "Cx":
        if isinstance(x, Cx):
            return x
        if isinstance(x, complex):
            return Cx(F.lit(x.real), F.lit(x.imag))
        return Cx(_lit(x), F.lit(0.0))

    def __add__(self, o):
        o = Cx.of(o)
        return Cx(self.re + o.re, self.im + o.im, self.sign)

    __radd__ = __add__

    def __sub__(self, o):
        o = Cx.of(o)
        return Cx(self.re - o.re, self.im - o.im, self.sign)

    def __rsub__(self, o):
        return Cx.of(o) - self

    def __neg__(self):
        return Cx(-self.re, -self.im, self.sign)

    def __mul__(self, o):
        if isinstance(o, (Cx, complex)):
            o = Cx.of(o)
            return Cx(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re, self.sign)
        return Cx(self.re * _lit(o), self.im * _lit(o), self.sign)

    __rmul__ = __mul__

    def inverse(self):
        m = self.re * self.re + self.im * self.im
        return Cx(divide(self.re, m), divide(-self.im, m), self.sign)

    def __truediv__(self, o):
        if isinstance(o, (Cx, complex)):
            return self * Cx.of(o).inverse()
        return Cx(divide(self.re, _lit(o)), divide(self.im, _lit(o)), self.sign)

    def __rtruediv__(self, o):
        return Cx.of(o) * self.inverse()

    def __pow__(self, p):
        mag, ang = F.pow(self.mag, _lit(p)), F.atan2(self.im, self.re) * _lit(p)
        return Cx(mag * F.cos(ang), mag * F.sin(ang), self.sign)

    def conj(self):
        return Cx(self.re, -self.im, self.sign)

    def with_sign(self, sign: int):
        return Cx(self.re, self.im, sign)

    @property
    def real(self) -> Column:
        return self.re

    @property
    def imag(self) -> Column:
        return self.im * self.sign if self.sign != 1 else self.im

    @property
    def mag(self) -> Column:
        """The root of the squares, as SQL has it; `hypot`, which differs in the last digit, where the squares leave their range."""
        square = self.re * self.re + self.im * self.im
        return F.when(square.between(1e-280, 1e300), F.sqrt(square)).otherwise(F.hypot(self.re, self.im))

    @property
    def phase(self) -> Column:
        return F.degrees(F.atan2(self.im, self.re)) * self.sign

    @property
    def slope(self) -> Column:
        return F.try_divide(self.im, self.re) * self.sign

    def part(self, name: str) -> Column:
        return {"real": self.real, "imag": self.imag, "mag": self.mag, "phase": self.phase, "slope": self.slope}[name]

    def struct(self) -> Column:
        return F.struct(self.re.alias("re"), self.im.alias("im"))
