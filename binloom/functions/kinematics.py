"""Four-vector algebra and event kinematics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

PI = math.pi
MISSING = -9999.0


class P4:
    """A four-vector held as px, py, pz, e expressions."""

    def __init__(self, px: Column, py: Column, pz: Column, e: Column):
        self.px, self.py, self.pz, self.e = px, py, pz, e

    @classmethod
    def ptetaphim(cls, pt, eta, phi, m=None) -> "P4":
        m = F.lit(0.0) if m is None else m
        pz = pt * F.sinh(eta)
        return cls(pt * F.cos(phi), pt * F.sin(phi), pz, F.sqrt(pt * pt + pz * pz + m * m))

    @classmethod
    def of(cls, obj: Column) -> "P4":
        """From a struct column with pt, eta, phi, mass."""
        return cls.ptetaphim(obj["pt"], obj["eta"], obj["phi"], obj["mass"])

    def __add__(self, o: "P4") -> "P4":
        return P4(self.px + o.px, self.py + o.py, self.pz + o.pz, self.e + o.e)

    def mass(self) -> Column:
        m2 = self.e * self.e - self.px * self.px - self.py * self.py - self.pz * self.pz
        return F.when(m2 >= 0, F.sqrt(F.abs(m2))).otherwise(-F.sqrt(F.abs(m2)))

    def pt(self) -> Column:
        return F.sqrt(self.px * self.px + self.py * self.py)

    def phi(self) -> Column:
        return F.atan2(self.py, self.px)


def wrap_phi(d: Column) -> Column:
    """One-turn wrap into (-pi, pi]."""
    return F.when(d > PI, d - 2 * PI).when(d <= -PI, d + 2 * PI).otherwise(d)


def delta_phi(a: Column, b: Column) -> Column:
    return wrap_phi(a - b)


def delta_r2(eta1, phi1, eta2, phi2, wrap: bool = True) -> Column:
    de, dp = eta1 - eta2, phi1 - phi2
    if wrap:
        dp = wrap_phi(dp)
    return de * de + dp * dp


def dr2_objects(a: Column, b: Column) -> Column:
    return delta_r2(a["eta"], a["phi"], b["eta"], b["phi"])


def transverse_mass(pt1: Column, phi1: Column, pt2: Column, phi2: Column) -> Column:
    return F.sqrt(2.0 * pt1 * pt2 * (1.0 - F.cos(phi1 - phi2)))


def charge(pdg: Column) -> Column:
    """Particles with positive code carry negative charge."""
    return F.when(pdg < 0, F.lit(1)).otherwise(F.lit(-1))


def erf(x: Column) -> Column:
    """Error function, rational approximation (absolute error below 1.5e-7)."""
    # Abramowitz and Stegun, formula 7.1.26
    p = 0.3275911
    a = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    t = 1.0 / (1.0 + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def gaussian(x: Column, mean: float, sigma: float) -> Column:
    u = (x - mean) / sigma
    return F.exp(-0.5 * u * u)


def interpol(x: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Straight line between two points, flat beyond both ends."""
    line = F.lit(y1) + (y2 - y1) * (x - x1) / (x2 - x1)
    return F.when(x < x1, F.lit(y1)).when(x > x2, F.lit(y2)).otherwise(line)
