"""Units of energy as text: what a text states, and the factor to the common scale, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values (CODATA 2018): one of each in eV.
EV = {
    "ev": 1.0, "mev": 1e-3, "hartree": 27.211386245988, "rydberg": 13.605693122994, "thz": 4.135667696e-3, "inv_cm": 1.239841984e-4,
    "kj_per_mol": 0.010364269656, "kcal_per_mol": 0.043364104241,
}
#: Lengths in angstrom.
ANGSTROM = {"angstrom": 1.0, "bohr": 0.529177210903, "nm": 10.0, "pm": 0.01, "m": 1e10}

_ENERGY = r"(?<![a-z])(milli[\s-]?(?:ev|electron\s?volts?)|mev|electron\s?volts?|ev|hartrees?|ha|a\.u\.|rydbergs?|ryd|ry|kj|kcal|terahertz|thz|cm\s?\^?-1|cm\^\{-1\}|1\s?/\s?cm)(?![a-z])"
_BASIS = _ENERGY + r"[\s_]*(?:\(ha\))?[\s_]*(?:per|/|\()?[\s_]*(atoms?|at\b|unit\s?cell|cell|mol)?"


#: Spellings, without blanks and signs, and the unit they mean.
_SPELLED = {
    "milliev": "mev", "millielectronvolt": "mev", "millielectronvolts": "mev", "mev": "mev", "electronvolt": "ev", "electronvolts": "ev", "ev": "ev",
    "hartree": "hartree", "hartrees": "hartree", "ha": "hartree", "au": "hartree", "rydberg": "rydberg", "rydbergs": "rydberg", "ryd": "rydberg", "ry": "rydberg",
    "kj": "kj", "kcal": "kcal", "terahertz": "thz", "thz": "thz", "cm1": "inv_cm", "1/cm": "inv_cm",
}
_SHORT = {"hartree": "ha", "rydberg": "ry", "kj": "kj_per_mol", "kcal": "kcal_per_mol"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def states_energy(text: Column) -> Column:
    return F.lower(text).rlike(_ENERGY)


def energy_word(text: Column) -> Column:
    """The energy unit that a text states: a key of EV (kJ and kcal as 'kj', 'kcal'), or null. Case, blanks and brackets don't matter."""
    return _lookup(F.regexp_replace(F.regexp_extract(F.lower(text), _ENERGY, 1), r"[\s^{}.-]", ""), _SPELLED)


def energy_unit(text: Column) -> Column:
    """Unit of an energy per atom or cell that a text states, such as 'ev_per_atom', 'ha_per_cell', 'kj_per_mol'; null if it states none.

    'mol' is of atoms; an energy without a basis is per atom. The basis must follow the unit: 'eV, cell relaxed' is per atom.
    """
    spelled = {k: _SHORT.get(v, v) for k, v in _SPELLED.items()}
    word = _lookup(F.regexp_replace(F.regexp_extract(F.lower(text), _ENERGY, 1), r"[\s^{}.-]", ""), spelled)
    cell = F.regexp_extract(F.lower(text), _BASIS, 2).endswith("cell")
    # kJ and kcal have their basis already
    return F.regexp_replace(F.concat(word, F.when(cell, "_per_cell").otherwise("_per_atom")), "_per_mol_per_(cell|atom)$", "_per_mol")


def ev_per_atom_factor(unit: Column, n_sites: Column) -> Column:
    """What a value in `unit` (of energy_unit) is multiplied by to give eV per atom."""
    one = {"ev": 1.0, "mev": EV["mev"], "ha": EV["hartree"], "ry": EV["rydberg"], "kj": EV["kj_per_mol"], "kcal": EV["kcal_per_mol"]}
    out = F.element_at(F.create_map(*[x for k, v in one.items() for x in (F.lit(k), F.lit(v))]), F.substring_index(unit, "_", 1))
    return F.when(unit.endswith("_per_cell"), out / F.nullif(n_sites, F.lit(0))).otherwise(out)


def ev_factor(word: Column) -> Column:
    out = F.lit(None).cast("double")
    for k in ("ev", "mev", "hartree", "rydberg", "thz", "inv_cm"):
        out = F.when(word == k, EV[k]).otherwise(out)
    return out


#: Texts and numbers that stand for a missing value.
NO_TEXT = ["", "-", "--", "?", "n/a", "na", "nan", "none", "null", "unknown", "not computed", "not available", "missing"]
NO_NUMBER = [-999.0, 999.0, 999.99, -999.99, 9999.0, -9999.0, 9999.99, -9999.99, 99999.0, -99999.0]


def real_number(x: Column, others: tuple[float, ...] = ()) -> Column:
    """x where it is a number and not a stand-in for a missing one, else null."""
    gone = F.isnan(x) | x.isin(*NO_NUMBER, *others) | (F.abs(x) == float("inf"))
    return F.when(~gone, x)


def real_text(x: Column) -> Column:
    """x, trimmed, where it is no stand-in for a missing value, else null."""
    return F.when(~F.lower(F.trim(x)).isin(*NO_TEXT), F.trim(x))


def number_in(text: Column) -> Column:
    """The first number in a text, or null."""
    return F.regexp_extract(text, r"([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")
