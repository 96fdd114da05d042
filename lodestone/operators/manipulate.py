"""Structures made from structures: deleting and replacing sites, scaling cells, supercells, turning and moving, adding a guest, pipelines of such steps.

All are row-wise expressions: no shuffle, no Python, except for the seeded random steps. Operators keep every other column. Positions may be fractions of the
cell or angstrom (`unit_repair.fractional`), and stay what they are unless said otherwise. Rows without sites pass through unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import elements as E
from lodestone.functions import geometry as G
from lodestone.functions.formula_columns import let
from lodestone.operators.collection import symbol
from lodestone.operators.unit_repair import fractional

Vector = Sequence[float]
MATRIX = "array<array<double>>"


def _lit(v: Vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def times(v: Column, matrix: Column | Sequence[Vector]) -> Column:
    """Row vector times a 3 x 3 matrix."""
    m = matrix if isinstance(matrix, Column) else F.array(*map(_lit, matrix))
    return let(v, lambda u: F.array(*[u[0] * m[0][k] + u[1] * m[1][k] + u[2] * m[2][k] for k in range(3)]))


def _add(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: a + b)


def with_cartesian(structures: DataFrame) -> DataFrame:
    """positions in angstrom."""
    return structures.withColumn("positions", F.when(fractional(), F.transform("positions", lambda p: times(p, F.col("cell")))).otherwise(F.col("positions")))


def inverse(cell: Column) -> Column:
    """Inverse of a 3 x 3 matrix of row vectors; null if it has none."""
    v = F.nullif(G.dot(cell[0], G.cross(cell[1], cell[2])), F.lit(0.0))
    cols = [G.cross(cell[(k + 1) % 3], cell[(k + 2) % 3]) for k in range(3)]
    return F.array(*[F.array(*[cols[k][i] / v for k in range(3)]) for i in range(3)])


def with_scaled(structures: DataFrame, wrap: bool = False) -> DataFrame:
    """positions of crystals as fractions of the cell, wrapped into it if asked for; molecules stay."""
    inv = inverse(F.col("cell"))
    d = structures.withColumn("_i", F.when(F.size("cell") == 3, inv)).withColumn("_f", fractional())
    frac = F.when(F.col("_f"), F.col("positions")).otherwise(F.transform("positions", lambda p: times(p, F.col("_i"))))
    if wrap:
        frac = F.transform(frac, lambda p: F.transform(p, lambda x: F.pmod(F.bround(x, 15), F.lit(1.0))))
    return d.withColumn("positions", F.when(F.col("_i").isNotNull(), frac).otherwise(F.col("positions"))).drop("_i", "_f")


def add_label_suffix(structures: DataFrame, suffix: str) -> DataFrame:
    return structures.withColumn("label", F.concat("label", F.lit(suffix)))


def delete_atoms(structures: DataFrame, elements: Sequence[str] = (), sites: Sequence[int] = ()) -> DataFrame:
    """Without the sites of the given elements and those with the given numbers; null if nothing is left. kinds follow where each site has one."""
    gone = lambda e, i: F.coalesce(symbol(e).isin(*elements), F.lit(False)) | i.isin(*sites) if sites else F.coalesce(symbol(e).isin(*elements), F.lit(False))
    keep = F.filter(F.transform("elements", lambda e, i: F.when(~gone(e, i), i)), lambda i: i.isNotNull())
    d = structures.withColumn("_k", keep).withColumn("_n", F.size("elements"))
    some = F.size("_k") > 0
    pick = lambda c: F.when(some, F.transform("_k", lambda i: F.get(F.col(c), i)))
    changed = F.size("_k") < F.col("_n")
    for c in [c for c in ("kinds", "positions") if c in d.columns]:
        d = d.withColumn(c, F.when(changed & (F.size(c) == F.col("_n")), pick(c)).otherwise(F.col(c)))
    return d.withColumn("elements", F.when(changed, pick("elements")).otherwise(F.col("elements"))).drop("_k", "_n")


def substitute_elements(structures: DataFrame, pairs: Sequence[tuple[str, str]], radius_type: str | None = "covalent") -> DataFrame:
    """Elements replaced by others. With a radius_type, cells (and positions in angstrom) are scaled by the mean of new over old radius of the sites, 1 where a radius is unknown."""
    new = lambda e: F.coalesce(*[F.when(symbol(e) == a, b) for a, b in pairs], symbol(e))
    d = structures.withColumn("_new", F.transform("elements", new))
    if radius_type:
        ratio = F.zip_with(F.transform("elements", lambda e: symbol(e)), F.col("_new"), lambda a, b: F.when(a == b, 1.0).otherwise(F.coalesce(E.atomic_radius(b, radius_type) / E.atomic_radius(a, radius_type), F.lit(1.0))))
        d = d.withColumn("_r", F.aggregate(ratio, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(1.0))) / F.nullif(F.size("_new"), F.lit(0)))
        d = _scaled(d, lambda v: F.transform(v, lambda x: x * F.col("_r"))).drop("_r")
    return d.withColumn("elements", F.col("_new")).drop("_new")


def _scaled(d: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Cell vectors changed, and positions in angstrom with them; structures without a cell stay."""
    d = d.withColumn("_f", fractional())
    moved = F.transform("positions", change)
    d = d.withColumn("positions", F.when((F.size("cell") == 3) & ~F.col("_f"), moved).otherwise(F.col("positions")))
    return d.withColumn("cell", F.when(F.size("cell") == 3, F.transform("cell", change)).otherwise(F.col("cell"))).drop("_f")


def scale_unit_cell(structures: DataFrame, factors: float | Vector | Sequence[Vector] | None = None, pressure: float | None = None, bulk_modulus: float | None = None, random: tuple[float, float] | None = None, seed: int = 0) -> DataFrame:
    """Cells scaled by a number, one number for each axis of space, or a strain matrix; by pressure over bulk modulus (same unit); or by a seeded random number.

    Each cell vector v becomes v times the matrix. Under pressure the volume shrinks by pressure / bulk_modulus. The random factor lies in `random` and depends on seed and seq only.
    """
    if pressure is not None:
        factors = (1 - pressure / bulk_modulus) ** (1 / 3)
    if random is not None:
        low, high = random
        u = F.pmod(F.xxhash64(F.lit(seed), "seq"), F.lit(1 << 53)).cast("double") / float(1 << 53)
        d = structures.withColumn("_u", low + (high - low) * u)
        return _scaled(d, lambda v: F.transform(v, lambda x: x * F.col("_u"))).drop("_u")
    if isinstance(factors, int | float):
        factors = [factors] * 3
    rows = list(factors)
    matrix = rows if isinstance(rows[0], list | tuple) else [[float(f) if i == k else 0.0 for k in range(3)] for i, f in enumerate(rows)]
    return _scaled(structures, lambda v: times(v, matrix))


def create_supercell(structures: DataFrame, size: int | Sequence[int] = 2, wrap: bool = True) -> DataFrame:
    """Crystals repeated along their axes: cell vectors times the size, fractions of the new cell, sites cell after cell. Molecules stay."""
    n = [size] * 3 if isinstance(size, int) else list(size)
    shifts = F.array(*[F.array(F.lit(float(i)), F.lit(float(j)), F.lit(float(k))) for i in range(n[0]) for j in range(n[1]) for k in range(n[2])])
    d = with_scaled(structures, wrap)
    crystal = F.size("cell") == 3
    many = lambda c: F.flatten(F.array_repeat(c, math.prod(n)))
    pos = F.flatten(F.transform(shifts, lambda s: F.transform("positions", lambda p: F.array(*[(p[k] + s[k]) / n[k] for k in range(3)]))))
    d = d.withColumn("positions", F.when(crystal, pos).otherwise(F.col("positions")))
    for c in [c for c in ("elements", "kinds") if c in d.columns]:
        d = d.withColumn(c, F.when(crystal, many(c)).otherwise(F.col(c)))
    return d.withColumn("cell", F.when(crystal, F.array(*[F.array(*[F.col("cell")[i][k] * n[i] for k in range(3)]) for i in range(3)])).otherwise(F.col("cell")))


def _chosen(i: Column, sites: Sequence[int] | None) -> Column:
    return F.lit(True) if sites is None else i.isin(*sites)


def translate_structure(structures: DataFrame, vector: Vector, sites: Sequence[int] | None = None) -> DataFrame:
    """Sites moved by a vector in angstrom; positions come out in angstrom."""
    return with_cartesian(structures).withColumn("positions", F.transform("positions", lambda p, i: F.when(_chosen(i, sites), _add(p, _lit(vector))).otherwise(p)))


def rotation(angles: float | Vector, axis: Vector | None = None) -> list[list[float]]:
    """Rotation matrix for column vectors: an angle about an axis, or three angles in turn about x, y and z; degrees."""
    if axis is not None:
        t, length = math.radians(float(angles)), math.sqrt(sum(x * x for x in axis))  # type: ignore[arg-type]
        x, y, z = (v / length for v in axis)
        c, s = math.cos(t), math.sin(t)
        return [[c + x * x * (1 - c), x * y * (1 - c) - z * s, x * z * (1 - c) + y * s], [y * x * (1 - c) + z * s, c + y * y * (1 - c), y * z * (1 - c) - x * s], [z * x * (1 - c) - y * s, z * y * (1 - c) + x * s, c + z * z * (1 - c)]]
    out = [[float(i == j) for j in range(3)] for i in range(3)]
    for k, a in enumerate(angles):  # type: ignore[arg-type]
        turn = rotation(a, [float(k == i) for i in range(3)])
        out = [[sum(turn[i][m] * out[m][j] for m in range(3)) for j in range(3)] for i in range(3)]
    return out


def rotate_structure(structures: DataFrame, angles: float | Vector, axis: Vector | None = None, origin: Vector | None = None, sites: Sequence[int] | None = None) -> DataFrame:
    """Sites turned about an origin, by default the middle of the chosen sites; positions come out in angstrom."""
    r = rotation(angles, axis)
    turn = [[r[j][i] for j in range(3)] for i in range(3)]  # for row vectors
    d = with_cartesian(structures)
    chosen = F.filter("positions", lambda p, i: _chosen(i, sites))
    total = F.aggregate(chosen, F.array(*[F.lit(0.0)] * 3), _add)
    mean = F.transform(total, lambda x: x / F.nullif(F.size(chosen), F.lit(0)))
    about = _lit(origin) if origin is not None else mean
    one = lambda o: lambda p, i: F.when(_chosen(i, sites), let(G.minus(p, o), lambda v: _add(times(v, turn), o))).otherwise(p)
    return d.withColumn("positions", let(about, lambda o: F.transform("positions", one(o))))


#: Sites of small guests in angstrom, the binding site first.
GUESTS = {
    "H": [("H", (0.0, 0.0, 0.0))],
    "OH": [("O", (0.0, 0.0, 0.0)), ("H", (0.0, 0.0, 0.97))],
    "H2O": [("O", (0.0, 0.0, 0.0)), ("H", (0.757, 0.0, 0.587)), ("H", (-0.757, 0.0, 0.587))],
    "CH3": [("C", (0.0, 0.0, 0.0)), ("H", (1.028, 0.0, 0.363)), ("H", (-0.514, 0.890, 0.363)), ("H", (-0.514, -0.890, 0.363))],
    "NH2": [("N", (0.0, 0.0, 0.0)), ("H", (0.825, 0.0, 0.583)), ("H", (-0.825, 0.0, 0.583))],
    "NO2": [("N", (0.0, 0.0, 0.0)), ("O", (1.09, 0.0, 0.58)), ("O", (-1.09, 0.0, 0.58))],
    "COOH": [("C", (0.0, 0.0, 0.0)), ("O", (1.05, 0.0, 0.58)), ("O", (-1.16, 0.0, 0.68)), ("H", (-1.0, 0.0, 1.64))],
}


def guest_sites(guest: str | Sequence[tuple[str, Vector]]) -> list[tuple[str, Vector]]:
    return list(GUESTS[guest] if isinstance(guest, str) else guest)


def add_structure_position(structures: DataFrame, position: Vector, guest: str | Sequence[tuple[str, Vector]] = "CH3", min_distance: float | None = None) -> DataFrame:
    """A guest's sites added, its middle at `position` (angstrom). With min_distance, structures in which a guest's site would come nearer than that to a site, in the
    cell as written, stay unchanged and have added = false. Positions come out in angstrom; kinds of new sites are null."""
    sites = guest_sites(guest)
    mid = [sum(p[k] for _, p in sites) / len(sites) for k in range(3)]
    placed = [[position[k] + p[k] - mid[k] for k in range(3)] for _, p in sites]
    d = with_cartesian(structures)
    new = F.array(*map(_lit, placed))
    close = F.lit(False) if min_distance is None else F.exists("positions", lambda p: F.exists(new, lambda q: G.norm(G.minus(p, q)) < min_distance))
    d = d.withColumn("added", F.size("elements").isNotNull() & (F.size("elements") > 0) & ~F.coalesce(close, F.lit(False)))
    grow = lambda c, extra: F.when(F.col("added"), F.concat(c, extra)).otherwise(F.col(c))
    d = d.withColumn("positions", grow("positions", new)).withColumn("elements", grow("elements", F.array(*[F.lit(e) for e, _ in sites])))
    return d.withColumn("kinds", grow("kinds", F.array_repeat(F.lit(None).cast("string"), len(sites)))) if "kinds" in d.columns else d


def add_structure_random(structures: DataFrame, guest: str | Sequence[tuple[str, Vector]] = "CH3", min_distance: float = 0.8, tries: int = 64, seed: int = 0) -> DataFrame:
    """A guest added to crystals at a random place: of `tries` seeded points in the cell the first at which no site of the cell as written is nearer than min_distance to a
    guest's site. `added` tells whether there was one; what is drawn depends on seed and seq only. Molecules stay."""
    sites = guest_sites(guest)
    mid = [sum(p[k] for _, p in sites) / len(sites) for k in range(3)]
    d = with_cartesian(structures)
    u = lambda t, k: F.pmod(F.xxhash64(F.lit(seed), "seq", t, F.lit(k)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    spot = lambda t: times(F.array(*[u(t, k) for k in range(3)]), F.col("cell"))
    place = lambda t: F.transform(F.array(*[_lit([p[k] - mid[k] for k in range(3)]) for _, p in sites]), lambda q: _add(q, spot(t)))
    free = F.filter(F.sequence(F.lit(1), F.lit(tries)), lambda t: ~F.exists(place(t), lambda q: F.exists("positions", lambda p: G.norm(G.minus(p, q)) < min_distance)))
    d = d.withColumn("_t", F.when(F.size("cell") == 3, F.get(free, F.lit(0)))).withColumn("added", F.col("_t").isNotNull())
    grow = lambda c, extra: F.when(F.col("added"), F.concat(c, extra)).otherwise(F.col(c))
    d = d.withColumn("positions", grow("positions", place(F.col("_t")))).withColumn("elements", grow("elements", F.array(*[F.lit(e) for e, _ in sites])))
    d = d.withColumn("kinds", grow("kinds", F.array_repeat(F.lit(None).cast("string"), len(sites)))) if "kinds" in d.columns else d
    return d.drop("_t")


Step = Callable[..., DataFrame]


def run_pipeline(structures: DataFrame, steps: Sequence[tuple[Step, dict] | tuple[Step, dict, Sequence[int]]]) -> DataFrame:
    """Steps (operator, arguments) one after the other. With a third entry, a list of counts, a step fans out: copy i, its label ending in 'x{i}', gets it counts[i] times."""
    out = structures
    for step, how, *rest in steps:
        if not rest or len(rest[0]) == 1:
            for _ in range(rest[0][0] if rest else 1):
                out = step(out, **how)
            continue
        copies = []
        for i, times_ in enumerate(rest[0]):
            one = out
            for _ in range(times_):
                one = step(one, **how)
            copies.append(add_label_suffix(one, f"x{i}"))
        out = copies[0]
        for c in copies[1:]:
            out = out.unionByName(c)
    return out
