"""Constants and conversion between any two units of length, energy, force, pressure, frequency and wave vector.

Units within a quantity differ by a factor. A wave's length, energy, frequency and wave vector are converted into each other by E = hc/l, f = c/l
and k = 2 pi/l, so these conversions divide. Factors are worked out once, in Python; a converted column is one multiplication or division.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values (CODATA 2022): value and unit.
CONSTANTS = {
    "am": (1.66053906892e-27, "kg"), "c": (299792458.0, "ms-1"), "e": (1.602176634e-19, "C"), "eps0": (8.8541878188e-12, "Fm-1"), "h": (6.62607015e-34, "JHz-1"),
    "hbar": (1.054571817e-34, "Js"), "kb": (1.380649e-23, "JK-1"), "me": (9.1093837139e-31, "kg"), "na": (6.02214076e23, "mol-1"),
}


def constant(name: str) -> float:
    return CONSTANTS[name.lower()][0]


def constant_unit(name: str) -> str:
    return CONSTANTS[name.lower()][1]


_e, _me, _eps0, _hbar = (constant(n) for n in ("e", "me", "eps0", "hbar"))
_BOHR = 4e10 * math.pi * _eps0 * _hbar**2 / (_me * _e**2)  # in angstrom
_HARTREE = _hbar**2 / (_me * (_BOHR * 1e-10) ** 2) / _e  # in eV
_JOULE, _PASCAL, _HZ = 1 / _e, 1 / (_e * 1e30), 1.0

#: Units of each quantity in its base unit: angstrom, eV, eV/angstrom, eV/angstrom^3, Hz, 1/angstrom.
UNITS: dict[str, dict[str, float]] = {
    "length": {"ang": 1.0, "angstrom": 1.0, "nm": 10.0, "micro_m": 1e4, "micron": 1e4, "mm": 1e7, "m": 1e10, "bohr": _BOHR},
    "energy": {"ev": 1.0, "hartree": _HARTREE, "ha": _HARTREE, "rydberg": _HARTREE / 2, "joule": _JOULE, "j": _JOULE, "cal": 4.184 * _JOULE, "kj_per_mol": 1e3 * _JOULE / constant("na")},
    "force": {"ev_per_angstrom": 1.0, "ev_per_ang": 1.0, "hartree_per_bohr": _HARTREE / _BOHR, "ha_per_bohr": _HARTREE / _BOHR},
    "pressure": {"pa": _PASCAL, "pascal": _PASCAL, "bar": 1e5 * _PASCAL, "atm": 1.01325e5 * _PASCAL},
    "frequency": {p + "hz": _HZ * 1000.0**k for k, p in enumerate(["", "k", "m", "g", "t", "p"])},
    "wavevector": {"angstrom-1": 1.0, "nm-1": 1e-1, "micro_m-1": 1e-4, "mm-1": 1e-7, "cm-1": 1e-8, "m-1": 1e-10},
}
#: What a quantity of a wave times its length in angstrom gives, in base units.
_WAVE = {"energy": constant("h") * constant("c") * 1e10 / _e, "frequency": constant("c") * 1e10, "wavevector": 2 * math.pi}


def quantity_of(unit: str) -> str:
    for q, table in UNITS.items():
        if unit.lower() in table:
            return q
    raise ValueError(f"'{unit}' is no unit of {', '.join(UNITS)}")


def conversion(unit_1: str, unit_2: str) -> tuple[bool, float]:
    """(divides, k): the converted value is k / value if it divides, else k * value."""
    q1, q2 = quantity_of(unit_1), quantity_of(unit_2)
    f1, f2 = UNITS[q1][unit_1.lower()], UNITS[q2][unit_2.lower()]
    if q1 == q2:
        return False, f1 / f2
    if "length" in (q1, q2) and (q1 in _WAVE or q2 in _WAVE):
        return True, _WAVE[q1 if q2 == "length" else q2] / (f1 * f2)
    if q1 in _WAVE and q2 in _WAVE:
        return False, f1 / _WAVE[q1] * _WAVE[q2] / f2
    raise ValueError(f"{q1} can't be converted to {q2}")


def convert(value: float, unit_1: str, unit_2: str) -> float:
    divides, k = conversion(unit_1, unit_2)
    return k / value if divides else k * value


def convert_units(value: Column, unit_1: str, unit_2: str) -> Column:
    """A column in unit_1 as unit_2, units in any case; a wave's quantity of 0 has no length: null."""
    divides, k = conversion(unit_1, unit_2)
    return F.lit(k) / F.nullif(value, F.lit(0.0)) if divides else value * k


#: Last space-group number of each crystal system.
SYSTEMS = {"triclinic": 2, "monoclinic": 15, "orthorhombic": 74, "tetragonal": 142, "trigonal": 167, "hexagonal": 194, "cubic": 230}


def crystal_system(number: Column) -> Column:
    """Crystal system of a space-group number; null outside 1 to 230."""
    out = F.lit(None).cast("string")
    for name, last in reversed(SYSTEMS.items()):
        out = F.when(number <= last, name).otherwise(out)
    return F.when(number >= 1, out)
