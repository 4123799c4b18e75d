"""Vectors (struct<x,y,z>), tensors, dense matrices (array<array<double>>), splines and dual numbers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def vec(x, y, z) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lit(x).alias("x"), lit(y).alias("y"), lit(z).alias("z"))


def _each(f: Callable[..., Column], *v: Column) -> Column:
    return vec(*(f(*(a[k] for a in v)) for k in AXES))


def add(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p + q, a, b)


def sub(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p - q, a, b)


def scale(a: Column, s) -> Column:
    return _each(lambda p: p * s, a)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def vsum(a: Column) -> Column:
    """Aggregate: componentwise sum."""
    return vec(*(F.sum(a[k]) for k in AXES))


def tensor_vec(t: Column, v: Column) -> Column:
    return vec(*(dot(t[k], v) for k in AXES))


def outer(a: Column, b: Column) -> Column:
    return F.struct(*(scale(b, a[k]).alias(k) for k in AXES))


def rotate(a: Column, axis: str, cos: Column | float, sin: Column | float) -> Column:
    """Rotation about x, y or z by an angle given by its cosine and sine."""
    i, j = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}[axis]
    new = {axis: a[axis], i: a[i] * cos - a[j] * sin, j: a[i] * sin + a[j] * cos}
    return vec(*(new[k] for k in AXES))


def matvec(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: F.aggregate(F.zip_with(row, v, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x))


def solve3(m: Column, b: Column) -> Column:
    """Solution of a 3 x 3 system (tensor, vector) by Cramer's rule, in generated code."""
    det = dot(m["x"], cross(m["y"], m["z"]))
    col = lambda k: vec(m["x"][k], m["y"][k], m["z"][k])
    c = [col(k) for k in AXES]
    triple = lambda p, q, r: dot(p, cross(q, r))
    return vec(triple(b, c[1], c[2]) / det, triple(c[0], b, c[2]) / det, triple(c[0], c[1], b) / det)


def lu_solve(a: str, b: str, n: int):
    """A pandas UDF that solves dense systems of any size: arrays in, array out (partial pivoting)."""
    @F.pandas_udf("array<double>")
    def solve(m: pd.Series, v: pd.Series) -> pd.Series:
        if not len(m):
            return pd.Series([], dtype=object)
        mats = np.stack([np.array([np.asarray(r, float) for r in x]) for x in m])
        return pd.Series(list(np.linalg.solve(mats, np.stack([np.asarray(x, float) for x in v])[..., None])[..., 0]))

    return solve(F.col(a), F.col(b))


def dual(value: Column, grad: Column) -> Column:
    return F.struct(value.alias("v"), grad.alias("d"))


def dual_apply(f: str, a: Column) -> Column:
    """f of a dual number: forward-mode derivative."""
    v, d = a["v"], a["d"]
    table = {
        "sin": (F.sin(v), F.cos(v)), "cos": (F.cos(v), -F.sin(v)), "tan": (F.tan(v), 1 / (F.cos(v) * F.cos(v))), "exp": (F.exp(v), F.exp(v)), "log": (F.log(v), 1 / v),
        "log10": (F.log10(v), 1 / (v * 2.302585092994046)), "sqrt": (F.sqrt(v), 0.5 / F.sqrt(v)), "abs": (F.abs(v), F.signum(v)), "sinh": (F.sinh(v), F.cosh(v)), "cosh": (F.cosh(v), F.sinh(v)),
        "tanh": (F.tanh(v), 1 - F.tanh(v) * F.tanh(v)), "asin": (F.asin(v), 1 / F.sqrt(1 - v * v)), "acos": (F.acos(v), -1 / F.sqrt(1 - v * v)), "atan": (F.atan(v), 1 / (1 + v * v)),
        "asinh": (F.asinh(v), 1 / F.sqrt(v * v + 1)), "acosh": (F.acosh(v), 1 / F.sqrt(v * v - 1)), "atanh": (F.atanh(v), 1 / (1 - v * v)), "ceil": (F.ceil(v).cast("double"), F.lit(0.0)), "floor": (F.floor(v).cast("double"), F.lit(0.0)),
    }
    if f not in table:
        raise ValueError(f"no derivative of {f}")
    value, slope = table[f]
    return dual(value, slope * d)


def dual_mul(a: Column, b: Column) -> Column:
    return dual(a["v"] * b["v"], a["d"] * b["v"] + a["v"] * b["d"])


def dual_add(a: Column, b: Column) -> Column:
    return dual(a["v"] + b["v"], a["d"] + b["d"])


def dual_div(a: Column, b: Column) -> Column:
    return dual(a["v"] / b["v"], (a["d"] * b["v"] - a["v"] * b["d"]) / (b["v"] * b["v"]))


def dual_pow(a: Column, b: Column) -> Column:
    """a to the power b; where the base isn't positive the exponent counts as a constant."""
    v = F.pow(a["v"], b["v"])
    grow = F.when(a["v"] > 0, v * F.log(F.when(a["v"] > 0, a["v"])) * b["d"]).otherwise(0.0)
    return dual(v, F.when(b["v"] == 0, 0.0).otherwise(b["v"] * F.pow(a["v"], b["v"] - 1) * a["d"]) + grow)


def dual_atan2(y: Column, x: Column) -> Column:
    return dual(F.atan2(y["v"], x["v"]), (y["d"] * x["v"] - x["d"] * y["v"]) / (x["v"] * x["v"] + y["v"] * y["v"]))


def dual_max(a: Column, b: Column) -> Column:
    """The larger of two; of equal ones the second."""
    return F.when(a["v"] > b["v"], a).otherwise(b)


def dual_min(a: Column, b: Column) -> Column:
    """The smaller of two; of equal ones the second."""
    return F.when(a["v"] < b["v"], a).otherwise(b)


def erf(x: Column) -> Column:
    """The error function, to 1.2e-7: a Chebyshev fit of its complement (Numerical Recipes, 6.2)."""
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = 1 / (1 + 0.5 * F.abs(x))
    poly = F.lit(c[-1])
    for k in c[-2::-1]:
        poly = poly * t + k
    rest = t * F.exp(-x * x + poly)
    return F.when(x >= 0, 1 - rest).otherwise(rest - 1)


def dual_erf(a: Column) -> Column:
    return dual(erf(a["v"]), F.lit(1.1283791670955126) * F.exp(-a["v"] * a["v"]) * a["d"])


def uniform(entity: Column, seed: int) -> Column:
    """A number in [0, 1) by entity and seed, whatever the partitions: 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(entity, F.lit(seed)), 11) / F.lit(float(1 << 53))


class Spline:
    """Piecewise cubic fitted to a function within a tolerance; evaluation, derivative and (for monotone functions) inverse."""

    def __init__(self, f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-6, most: int = 4096):
        n = 4
        while True:
            x = np.linspace(low, high, n + 1)
            y = np.array([f(v) for v in x])
            self.x, self.y, self.m = x, y, np.gradient(y, x, edge_order=2)
            probe = (x[:-1] + x[1:]) / 2
            if max(abs(self(p) - f(p)) for p in probe) <= tolerance or n >= most:
                break
            n *= 2

    def _at(self, v: float) -> tuple[int, float, float]:
        import bisect

        i = min(max(bisect.bisect_right(self.x.tolist(), v) - 1, 0), len(self.x) - 2)
        h = self.x[i + 1] - self.x[i]
        return i, h, (v - self.x[i]) / h

    def __call__(self, v: float) -> float:
        i, h, t = self._at(v)
        return float((2 * t**3 - 3 * t**2 + 1) * self.y[i] + (t**3 - 2 * t**2 + t) * h * self.m[i] + (3 * t**2 - 2 * t**3) * self.y[i + 1] + (t**3 - t**2) * h * self.m[i + 1])

    def slope(self, v: float) -> float:
        i, h, t = self._at(v)
        return float((6 * t**2 - 6 * t) * self.y[i] / h + (3 * t**2 - 4 * t + 1) * self.m[i] + (6 * t - 6 * t**2) * self.y[i + 1] / h + (3 * t**2 - 2 * t) * self.m[i + 1])

    def inverse(self, value: float) -> float:
        lo, hi = float(self.x[0]), float(self.x[-1])
        up = self.y[-1] >= self.y[0]
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (self(mid) < value) == up else (lo, mid)
        return (lo + hi) / 2
