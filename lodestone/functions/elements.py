"""Properties of the elements as Spark expressions: symbol, name, number, mass, radii, electronegativity, valence electrons, groups.

An element may be given as symbol or name in any case, or as a number; what is no element gives null. Lookups are literals in the plan: no join, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators.crystals import SYMBOLS

#: Names in order of atomic number.
NAMES = """Hydrogen Helium Lithium Beryllium Boron Carbon Nitrogen Oxygen Fluorine Neon Sodium Magnesium Aluminium Silicon Phosphorus Sulfur Chlorine Argon
Potassium Calcium Scandium Titanium Vanadium Chromium Manganese Iron Cobalt Nickel Copper Zinc Gallium Germanium Arsenic Selenium Bromine Krypton Rubidium Strontium
Yttrium Zirconium Niobium Molybdenum Technetium Ruthenium Rhodium Palladium Silver Cadmium Indium Tin Antimony Tellurium Iodine Xenon Caesium Barium Lanthanum Cerium
Praseodymium Neodymium Promethium Samarium Europium Gadolinium Terbium Dysprosium Holmium Erbium Thulium Ytterbium Lutetium Hafnium Tantalum Tungsten Rhenium Osmium
Iridium Platinum Gold Mercury Thallium Lead Bismuth Polonium Astatine Radon Francium Radium Actinium Thorium Protactinium Uranium Neptunium Plutonium Americium Curium
Berkelium Californium Einsteinium Fermium Mendelevium Nobelium Lawrencium Rutherfordium Dubnium Seaborgium Bohrium Hassium Meitnerium Darmastadtium Roentgenium
Copernicium Nihonium Flerovium Moscovium Livermorium Tennessine Oganesson""".split()

#: Fixed values in order of atomic number, '-' where there is none.
MASS = """1.008 4.002602 6.94 9.0121831 10.81 12.011 14.007 15.999 18.998403163 20.1797 22.98976928 24.305 26.9815385 28.085 30.973761998 32.06 35.45 39.948 39.0983
40.078 44.955908 47.867 50.9415 51.9961 54.938044 55.845 58.933194 58.6934 63.546 65.38 69.723 72.630 74.921595 78.971 79.904 83.798 85.4678 87.62 88.90584 91.224
92.90637 95.95 97.90721 101.07 102.90550 106.42 107.8682 112.414 114.818 118.710 121.760 127.60 126.90447 131.293 132.90545196 137.327 138.90547 140.116 140.90766
144.242 144.91276 150.36 151.964 157.25 158.92535 162.500 164.93033 167.259 168.93422 173.054 174.9668 178.49 180.94788 183.84 186.207 190.23 192.217 195.084
196.966569 200.592 204.38 207.2 208.98040 208.98243 209.98715 222.01758 223.01974 226.02541 227.02775 232.0377 231.03588 238.02891 237.04817 244.06421 243.06138
247.07035 247.07031 251.07959 252.083 257.09511 258.09843 259.101 262.11 267.122 268.126 271.134 270.133 269.1338 278.156 281.165 281.166 285.177 286.182 289.19
289.194 293.204 293.208 294.214"""
#: doi 10.1039/B801115J
COVALENT = """0.31 0.28 1.28 0.96 0.84 0.76 0.71 0.66 0.57 0.58 1.66 1.41 1.21 1.11 1.07 1.05 1.02 1.06 2.03 1.76 1.70 1.60 1.53 1.39 1.39 1.32 1.26 1.24 1.32 1.22
1.22 1.20 1.19 1.20 1.20 1.16 2.20 1.95 1.90 1.75 1.64 1.54 1.47 1.46 1.42 1.39 1.45 1.44 1.42 1.39 1.39 1.38 1.39 1.40 2.44 2.15 2.07 2.04 2.03 2.01 1.99 1.98
1.98 1.96 1.94 1.92 1.92 1.89 1.90 1.87 1.87 1.75 1.70 1.62 1.51 1.44 1.41 1.36 1.36 1.32 1.45 1.46 1.48 1.40 1.50 1.50 2.60 2.21 2.15 2.06 2.00 1.96 1.90 1.87
1.80 1.69 - - - - - - - - - - - - - - - - - - - - - -"""
#: doi 10.1039/C9RA07327B
CHEN_MANZ = """0.38 - 0.86 0.53 1.01 0.88 0.86 0.89 0.82 - 1.15 1.28 1.53 1.38 1.28 1.20 1.17 - 1.44 1.17 1.62 1.65 1.51 1.53 1.53 1.43 1.31 1.33 1.31 1.41 1.40 1.35
1.39 1.40 1.39 - 1.65 1.30 1.84 1.73 1.66 1.57 - 1.58 1.63 1.68 1.56 1.56 1.53 1.64 1.64 1.65 1.58 - 1.85 1.52 1.91 1.98 1.75 1.92 - 1.89 1.83 1.79 1.82 1.79
1.63 1.80 1.84 1.80 1.86 1.73 - 1.33 1.29 - 1.50 1.66 1.68 1.88 - 1.72 1.72 - - - - - - 1.97 - 1.76 1.73 1.71 - - - - - - - - - - - - - - - - - - - - - - - -"""
#: doi 10.1039/C3DT50599E
VDW = """1.20 1.43 2.12 1.98 1.91 1.77 1.66 1.50 1.46 1.58 2.50 2.51 2.25 2.19 1.90 1.89 1.82 1.83 2.73 2.62 2.58 2.46 2.42 2.45 2.45 2.44 2.40 2.40 2.38 2.39 2.32 2.29
1.88 1.82 1.86 2.25 3.21 2.84 2.75 2.52 2.56 2.45 2.44 2.46 2.44 2.15 2.53 2.49 2.43 2.42 2.47 1.99 2.04 2.06 3.48 3.03 2.98 2.88 2.92 2.95 - 2.90 2.87 2.83 2.79
2.87 2.81 2.83 2.79 2.80 2.74 2.63 2.53 2.57 2.49 2.48 2.41 2.29 2.32 2.45 2.47 2.60 2.54 - - - - - 2.8 2.93 2.88 2.71 2.82 2.81 2.83 3.05 3.4 3.05 2.7 - - - - -
- - - - - - - - - - - - - -"""
#: doi 10.26434/chemrxiv-2024-m3rtp-v2
VDW_CHARRY_TKATCHENKO = """3.164697 2.672999 5.289595 4.2875 3.9302 3.6096 3.398 3.240 3.0822 2.935712 5.2850 4.6952 4.5574 4.281 4.043 3.8993 3.7441 3.600377 5.7384 5.276
4.907 4.929 4.832 4.799 4.664 4.603 4.525 4.451 4.425 4.3036 4.464 4.324 4.150 4.130 3.944 3.819973 5.8196 5.4300 5.280 5.009 4.914 4.832 4.765 4.703 4.64 4.0681
4.525 4.411 4.635 4.501 4.369 4.292 4.2049 4.0943 6.0103 5.686 5.498 5.461 5.502 5.472 5.442 5.410 5.377 5.262 5.317 5.294 5.252 5.223 5.192 5.166 5.155 4.950 4.72
4.66 4.603 4.548 4.513 4.438 4.259 4.2230 4.464 4.425 4.438 4.383 4.354 4.242 5.8144 5.605 5.453 5.51 5.242 5.111 5.228 5.13 5.12 5.19 5.09 5.07 5.05 5.02 4.99 4.996
5.820 5.009 4.354 4.324 4.292 4.259 4.225 4.188 4.19 4.109 4.130 4.169 4.69 - 4.74 4.560"""
PAULING = """2.20 - 0.98 1.57 2.04 2.55 3.04 3.44 3.98 - 0.93 1.31 1.61 1.90 2.19 2.58 3.16 - 0.82 1.00 1.36 1.54 1.63 1.66 1.55 1.83 1.88 1.91 1.90 1.65 1.81 2.01 2.18 2.55
2.96 3.00 0.82 0.95 1.22 1.33 1.6 2.16 1.90 2.2 2.28 2.20 1.93 1.69 1.78 1.96 2.05 2.1 2.66 2.6 0.79 0.89 1.10 1.12 1.13 1.14 - 1.17 - 1.20 - 1.22 1.23 1.24 1.25 -
1.27 1.3 1.5 2.36 1.9 2.2 2.20 2.28 2.54 2.00 1.62 2.33 2.02 2.0 2.2 - - 0.9 1.1 1.3 1.5 1.38 1.36 1.28 1.3 1.3 1.3 1.3 1.3 1.3 1.3 1.3 - - - - - - - - - - - - - - -
-"""
ALLEN = """2.300 4.160 0.912 1.576 2.051 2.544 3.066 3.610 4.193 4.787 0.869 1.293 1.613 1.916 2.253 2.589 2.869 3.242 0.734 1.034 1.19 1.38 1.53 1.65 1.75 1.80 1.84 1.88
1.85 1.588 1.756 1.994 2.211 2.424 2.685 2.966 0.706 0.963 1.12 1.32 1.41 1.47 1.51 1.54 1.56 1.58 1.87 1.521 1.656 1.824 1.984 2.158 2.359 2.582 0.659 0.881 - - - - -
- - - - - - - - - 1.09 1.16 1.34 1.47 1.60 1.65 1.68 1.72 1.92 1.765 1.789 1.854 2.01 2.19 2.39 2.60 0.67 0.89 - - - - - - - - - - - - - - - - - - - - - - - - - - - - - -"""
#: Valence electrons, one row of the periodic table after the other ('a..b' counts up).
VALENCE = "1 2 1..8 1..8 1..12 3..8 1..12 3..8 1..16 3..12 3..8 1 2 3 5 5 6..16 3..12 3..8"
#: Groups and their elements.
GROUPS = {
    "alkaline": "Li Na K Rb Cs Fr",
    "alkaline earth": "Be Mg Ca Sr Ba Ra",
    "transition metal": "Sc Ti V Cr Mn Fe Co Ni Cu Zn Y Zr Nb Mo Tc Ru Rh Pd Ag Cd Hf Ta W Re Os Ir Pt Au Hg Rf Db Sg Bh Hs Mt Ds Rg Cn",
    "rare earth": "La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu",
    "metalloid": "B Si Ge As Sb Te Po",
    "pnictogen": "N P As Sb Bi Mc",
    "chalcogen": "O S Se Te Po",
    "halogen": "F Cl Br I At Ts",
    "noble gas": "He Ne Ar Kr Xe Rn Og",
    "non-metal": "H He B C N O F Ne Si P S Cl Ar Ge As Se Br Kr Sb Te I Xe Po At Rn Ts Og",
}


def numbers(text: str) -> list[float | None]:
    """The values of a table, in order of atomic number."""
    return [None if t == "-" else float(t) for t in text.split()]


def _valence() -> list[int]:
    out: list[int] = []
    for t in VALENCE.split():
        a, _, b = t.partition("..")
        out += range(int(a), int(b or a) + 1)
    return out


RADII = {"covalent": numbers(COVALENT), "vdw": numbers(VDW), "chen_manz": numbers(CHEN_MANZ), "vdw_charry_tkatchenko": numbers(VDW_CHARRY_TKATCHENKO)}
SCALES = {"pauling": numbers(PAULING), "allen": numbers(ALLEN)}
MASSES = numbers(MASS)
VALENCE_ELECTRONS = _valence()


def members(group: str) -> list[str]:
    """The elements of a group, in order of atomic number; what is in no table of its own is a metal if it is no non-metal."""
    key = group.strip().lower()
    if key == "metal":
        return [s for s in SYMBOLS if s not in GROUPS["non-metal"].split()]
    if key not in GROUPS:
        raise ValueError(f"no group of elements is called {group!r}")
    return GROUPS[key].split()


def groups_of(symbol: str) -> list[str]:
    """The groups that hold an element, in alphabetical order."""
    return sorted(g for g in ["metal", *GROUPS] if symbol in members(g))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def atomic_number(element: Column) -> Column:
    """Number of an element from its symbol, name or number as text."""
    text = F.initcap(F.trim(element.cast("string")))
    known = {s: i + 1 for i, s in enumerate(SYMBOLS)} | {n: i + 1 for i, n in enumerate(NAMES)}
    number = text.try_cast("int")
    return F.coalesce(F.element_at(_map(known), text), F.when(number.between(1, len(SYMBOLS)), number))


def _by_number(element: Column, table: list, kind: str) -> Column:
    values = F.array(*[F.lit(v).cast(kind) for v in table])
    return F.get(values, atomic_number(element) - 1)


def element_symbol(element: Column) -> Column:
    return _by_number(element, SYMBOLS, "string")


def element_name(element: Column) -> Column:
    return _by_number(element, NAMES, "string")


def atomic_mass(element: Column) -> Column:
    return _by_number(element, MASSES, "double")


def atomic_radius(element: Column, radius_type: str = "covalent") -> Column:
    """Radius in angstrom; types: covalent, vdw, chen_manz, vdw_charry_tkatchenko (in bohr)."""
    return _by_number(element, RADII[radius_type], "double")


def electronegativity(element: Column, scale: str = "pauling") -> Column:
    return _by_number(element, SCALES[scale], "double")


def valence_electrons(element: Column) -> Column:
    return _by_number(element, VALENCE_ELECTRONS, "int")


def element_groups(element: Column) -> Column:
    """Groups of an element, in alphabetical order."""
    return F.get(F.array(*[F.array(*map(F.lit, groups_of(s))) for s in SYMBOLS]), atomic_number(element) - 1)


def in_group(element: Column, group: str) -> Column:
    return element_symbol(element).isin(*members(group))


def density(elements: Column, volume: Column) -> Column:
    """Mass density in g/cm3 of sites in a cell of `volume` cubic angstrom; null if a site is no element."""
    mass = F.aggregate(elements, F.lit(0.0), lambda a, e: a + atomic_mass(e))
    return mass * 1.66053906892 / F.nullif(volume, F.lit(0.0))
