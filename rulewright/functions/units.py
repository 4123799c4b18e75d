"""Units of measure: parsing, compatibility and conversion in MKS."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class UnitError(ValueError):
    """An unknown unit or an incompatible conversion."""


DIMENSIONS = ("meter", "kilogram", "second", "kelvin", "mole", "ampere", "candela", "radian")
#: Fixed values: (factor to MKS, exponents of length, mass, time, temperature, amount, current, light, angle).
_L, _M, _T, _K, _N, _I, _J, _A = (tuple(int(i == j) for j in range(8)) for i in range(8))


def _mix(**e: int) -> tuple[int, ...]:
    at = dict(zip("LMTKNIJA", range(8), strict=True))
    out = [0] * 8
    for k, v in e.items():
        out[at[k]] = v
    return tuple(out)


UNITS: dict[str, tuple[float, tuple[int, ...]]] = {
    "meter": (1, _L), "m": (1, _L), "centimeter": (0.01, _L), "cm": (0.01, _L), "millimeter": (0.001, _L), "mm": (0.001, _L), "micrometer": (1e-6, _L), "kilometer": (1000, _L), "km": (1000, _L),
    "inch": (0.0254, _L), "in": (0.0254, _L), "foot": (0.3048, _L), "feet": (0.3048, _L), "ft": (0.3048, _L), "yard": (0.9144, _L), "yd": (0.9144, _L), "mile": (1609.344, _L), "mi": (1609.344, _L), "angstrom": (1e-10, _L),
    "kilogram": (1, _M), "kg": (1, _M), "gram": (0.001, _M), "g": (0.001, _M), "milligram": (1e-6, _M), "mg": (1e-6, _M), "pound": (0.45359237, _M), "lbm": (0.45359237, _M), "lb": (0.45359237, _M), "ounce": (0.028349523125, _M), "oz": (0.028349523125, _M), "slug": (14.59390294, _M), "ton": (1000, _M),
    "second": (1, _T), "s": (1, _T), "sec": (1, _T), "millisecond": (0.001, _T), "ms": (0.001, _T), "microsecond": (1e-6, _T), "minute": (60, _T), "min": (60, _T), "hour": (3600, _T), "h": (3600, _T), "hr": (3600, _T), "day": (86400, _T),
    "kelvin": (1, _K), "K": (1, _K), "rankine": (1 / 1.8, _K), "R": (1 / 1.8, _K), "celsius": (1, _K), "C": (1, _K), "fahrenheit": (1 / 1.8, _K), "F": (1 / 1.8, _K),
    "mole": (1, _N), "mol": (1, _N), "kmol": (1000, _N), "ampere": (1, _I), "A": (1, _I), "candela": (1, _J), "cd": (1, _J),
    "radian": (1, _A), "rad": (1, _A), "degree": (0.017453292519943295, _A), "deg": (0.017453292519943295, _A), "rpm": (0.10471975511965977, _mix(A=1, T=-1)),
    "hertz": (1, _mix(T=-1)), "Hz": (1, _mix(T=-1)), "newton": (1, _mix(L=1, M=1, T=-2)), "N": (1, _mix(L=1, M=1, T=-2)), "dyne": (1e-5, _mix(L=1, M=1, T=-2)), "lbf": (4.4482216152605, _mix(L=1, M=1, T=-2)),
    "pascal": (1, _mix(L=-1, M=1, T=-2)), "Pa": (1, _mix(L=-1, M=1, T=-2)), "kPa": (1000, _mix(L=-1, M=1, T=-2)), "MPa": (1e6, _mix(L=-1, M=1, T=-2)), "bar": (1e5, _mix(L=-1, M=1, T=-2)), "atm": (101325, _mix(L=-1, M=1, T=-2)), "psi": (6894.757293168361, _mix(L=-1, M=1, T=-2)), "torr": (133.32236842105263, _mix(L=-1, M=1, T=-2)),
    "joule": (1, _mix(L=2, M=1, T=-2)), "J": (1, _mix(L=2, M=1, T=-2)), "kJ": (1000, _mix(L=2, M=1, T=-2)), "calorie": (4.184, _mix(L=2, M=1, T=-2)), "cal": (4.184, _mix(L=2, M=1, T=-2)), "btu": (1055.05585262, _mix(L=2, M=1, T=-2)), "erg": (1e-7, _mix(L=2, M=1, T=-2)),
    "watt": (1, _mix(L=2, M=1, T=-3)), "W": (1, _mix(L=2, M=1, T=-3)), "kW": (1000, _mix(L=2, M=1, T=-3)), "hp": (745.6998715822702, _mix(L=2, M=1, T=-3)), "volt": (1, _mix(L=2, M=1, T=-3, I=-1)), "V": (1, _mix(L=2, M=1, T=-3, I=-1)),
    "liter": (0.001, _mix(L=3)), "l": (0.001, _mix(L=3)), "gallon": (4.54609e-3, _mix(L=3)), "poise": (0.1, _mix(L=-1, M=1, T=-1)), "stokes": (1e-4, _mix(L=2, T=-1)), "knot": (0.5144444444444445, _mix(L=1, T=-1)), "mph": (0.44704, _mix(L=1, T=-1)),
}
#: Absolute temperatures: kelvin = value * factor + shift.
ABSOLUTE = {"fahrenheit": (1 / 1.8, 459.67 / 1.8), "F": (1 / 1.8, 459.67 / 1.8), "celsius": (1.0, 273.15), "C": (1.0, 273.15), "rankine": (1 / 1.8, 0.0), "R": (1 / 1.8, 0.0)}


@dataclass(frozen=True)
class Unit:
    factor: float
    exponents: tuple[int, ...]
    name: str = ""


def cgs_factor(unit: Unit) -> float:
    """How many CGS units an MKS unit of the same kind is."""
    return 100.0 ** unit.exponents[0] * 1000.0 ** unit.exponents[1]


def parse_unit(text: str) -> Unit:
    """``kg*m/s/s``, ``m^2``, ``1/s``; operators apply left to right."""
    factor, exps, sign = 1.0, [0] * 8, 1
    for token in re.findall(r"[*/]|[A-Za-z]+(?:\^-?\d+)?|[\d.]+", text.replace("**", "^")):
        if token in "*/":
            sign = 1 if token == "*" else -1
            continue
        if token[0].isdigit():
            factor *= float(token) ** sign
            continue
        name, _, p = token.partition("^")
        if name not in UNITS:
            raise UnitError(f"unknown unit {name!r} in {text!r}")
        f, e = UNITS[name]
        n = sign * int(p or 1)
        factor *= f**n
        exps = [x + n * y for x, y in zip(exps, e, strict=True)]
    return Unit(factor, tuple(exps), text.strip())


@dataclass(frozen=True)
class Quantity:
    value: float
    unit: Unit

    @property
    def mks(self) -> float:
        if self.unit.name in ABSOLUTE:
            f, shift = ABSOLUTE[self.unit.name]
            return self.value * f + shift
        return self.value * self.unit.factor

    @property
    def cgs(self) -> float:
        """In centimetres, grams and seconds, the other base units as in MKS."""
        return self.mks * cgs_factor(self.unit)

    def compatible(self, unit: str) -> bool:
        return parse_unit(unit).exponents == self.unit.exponents

    def get_value_in(self, unit: str) -> float:
        to = parse_unit(unit)
        if to.exponents != self.unit.exponents:
            raise UnitError(f"{self.unit.name} and {unit} don't agree")
        if to.name in ABSOLUTE:
            f, shift = ABSOLUTE[to.name]
            return (self.mks - shift) / f
        return self.mks / to.factor


def parse_quantity(text: str) -> Quantity:
    m = re.match(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*(.*)$", text)
    if not m:
        raise UnitError(f"no number in {text!r}")
    return Quantity(float(m[1]), parse_unit(m[2]))


def convert(value: Column, source: str, target: str) -> Column:
    """A column of ``source`` units in ``target`` units, as one expression."""
    a, b = parse_unit(source), parse_unit(target)
    if a.exponents != b.exponents:
        raise UnitError(f"{source} and {target} don't agree")
    fa, sa = ABSOLUTE.get(a.name, (a.factor, 0.0))
    fb, sb = ABSOLUTE.get(b.name, (b.factor, 0.0))
    return (value * F.lit(fa) + F.lit(sa - sb)) / F.lit(fb)


def to_cgs(value: Column, source: str) -> Column:
    """A column of ``source`` units in centimetres, grams and seconds."""
    a = parse_unit(source)
    f, shift = ABSOLUTE.get(a.name, (a.factor, 0.0))
    return (value * F.lit(f) + F.lit(shift)) * F.lit(cgs_factor(a))
