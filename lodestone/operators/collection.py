"""Collections of structures: normal symbols, sites, keyed access, composition, constraints and structure-to-structure changes.

A collection is a DataFrame of structures. Site-level work explodes the arrays of a row and stays in that row's partition: nothing here shuffles
unless it aggregates over structures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.crystals import SYMBOLS, Sites
from lodestone.operators.unit_repair import fractional


def symbol(c: F.Column) -> F.Column:
    """'TE', ' te', 'Te3', 'Te2-' are 'Te'; deuterium is 'H'; null for what is no symbol."""
    s = F.nullif(F.initcap(F.regexp_extract(F.trim(c), r"^([A-Za-z]{1,2})[0-9]*[+-]?[0-9]*$", 1)), F.lit(""))
    return F.when(s == "D", "H").otherwise(s)


def latest(structures: DataFrame, key: str = "label") -> DataFrame:
    """One row for each key: the one that arrived last (upsert by key). The aggregate combines on the map side, so repeated keys cost little."""
    keep = structures.groupBy(key).agg(F.max("seq").alias("seq")).select("seq")
    return structures.join(keep, "seq", "left_semi")


def element_counts(structures: DataFrame) -> DataFrame:
    """(seq, element, n_atoms, n_sites, concentration)."""
    sites = structures.select("seq", F.size("elements").alias("n_sites"), F.explode("elements").alias("e")).select("seq", "n_sites", symbol(F.col("e")).alias("element"))
    out = sites.groupBy("seq", "n_sites", "element").agg(F.count("*").alias("n_atoms"))
    return out.select("seq", "element", "n_atoms", "n_sites", (F.col("n_atoms") / F.col("n_sites")).alias("concentration"))


def formula_text(elements: str = "elements") -> F.Column:
    """'Cs4Te2' from an array of sites, elements in alphabetical order, without leaving the row."""
    sym = F.transform(elements, symbol)
    part = lambda e: F.concat(e, F.nullif(F.size(F.filter(sym, lambda x: x == e)).cast("string"), F.lit("1")))
    one = lambda e: F.coalesce(part(e), e)
    return F.array_join(F.transform(F.array_sort(F.array_distinct(F.array_compact(sym))), one), "")


def within_concentration(structures: DataFrame, element: str, low: float, high: float) -> DataFrame:
    """Structures whose share of `element` lies in [low, high]."""
    share = F.size(F.filter("elements", lambda e: symbol(e) == element)) / F.size("elements")
    return structures.where(share.between(low, high))


def only_elements(structures: DataFrame, allowed: list[str]) -> DataFrame:
    """Structures made of the allowed elements alone."""
    return structures.where(F.forall("elements", lambda e: F.coalesce(symbol(e).isin(*allowed), F.lit(False))))


def without_elemental(structures: DataFrame) -> DataFrame:
    """Structures of at least two elements."""
    return structures.where(F.size(F.array_distinct(F.transform("elements", symbol))) > 1)


def sites(structures: DataFrame) -> DataFrame:
    """(seq, site, element, x, y, z, ax … cz, frac): one row a site, with the cell vectors; frac tells whether x, y, z are fractions."""
    cell = [F.col("cell")[i][k].alias(f"{'abc'[i]}{'xyz'[k]}") for i in range(3) for k in range(3)]
    rows = structures.select("seq", fractional().alias("frac"), *cell, F.posexplode(F.arrays_zip("elements", "positions")).alias("site", "s"))
    return rows.select("seq", "site", symbol(F.col("s.elements")).alias("element"), *[F.col("s.positions")[k].alias("xyz"[k]) for k in range(3)], *[F.col(f"{v}{k}") for v in "abc" for k in "xyz"], "frac")


def cell_volume() -> F.Column:
    return F.expr("ax*(by*cz-bz*cy) - ay*(bx*cz-bz*cx) + az*(bx*cy-by*cx)")


def fraction_arrays(structures: DataFrame) -> DataFrame:
    """(seq, ax … cz, v, s): crystals with their sites as an array of (site, element, fx, fy, fz), fractions wrapped into the cell; rows stay in place."""
    cell = [F.col("cell")[i][k].alias(f"{'abc'[i]}{'xyz'[k]}") for i in range(3) for k in range(3)]
    d = structures.where("cell is not null").select("seq", fractional().alias("frac"), *cell, F.arrays_zip("elements", "positions").alias("raw")).withColumn("v", cell_volume())
    rec = {"fx": "by*cz-bz*cy bz*cx-bx*cz bx*cy-by*cx", "fy": "cy*az-cz*ay cz*ax-cx*az cx*ay-cy*ax", "fz": "ay*bz-az*by az*bx-ax*bz ax*by-ay*bx"}
    d = d.withColumns({f"r{n}{k}": F.expr(f"({e}) / v") for n, r in rec.items() for k, e in enumerate(r.split())})

    def one(s, i):
        p = s["positions"]
        f = [F.when(F.col("frac"), p[k]).otherwise(sum(p[j] * F.col(f"r{n}{j}") for j in range(3))) for k, n in enumerate(rec)]
        return F.struct(i.alias("site"), symbol(s["elements"]).alias("element"), *[(x - F.floor(x)).alias(n) for x, n in zip(f, rec)])

    return d.select("seq", *[f"{v}{k}" for v in "abc" for k in "xyz"], "v", F.transform("raw", one).alias("s"))


def with_fractions(structures: DataFrame) -> DataFrame:
    """(seq, site, element, fx, fy, fz) of crystals, one row a site."""
    return fraction_arrays(structures).select("seq", F.inline("s"))


def lattice(structures: DataFrame) -> DataFrame:
    """(seq, a, b, c, alpha, beta, gamma, volume) of crystals."""
    v = lambda i, k: F.col("cell")[i][k]
    dot = lambda i, j: sum(v(i, k) * v(j, k) for k in range(3))
    length = [F.sqrt(dot(i, i)) for i in range(3)]
    angle = lambda i, j: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(i, j) / (length[i] * length[j])))))
    d = structures.where("cell is not null")
    names = d.select("seq", *[v(i, k).alias(f"{'abc'[i]}{'xyz'[k]}") for i in range(3) for k in range(3)], *[x.alias(n) for x, n in zip(length, "abc")], angle(1, 2).alias("alpha"), angle(0, 2).alias("beta"), angle(0, 1).alias("gamma"))
    return names.select("seq", "a", "b", "c", "alpha", "beta", "gamma", F.abs(cell_volume()).alias("volume"))


def substitute(structures: DataFrame, old: str, new: str) -> DataFrame:
    """Every site of one element replaced by another; only structures that have it."""
    return structures.where(F.exists("elements", lambda e: symbol(e) == old)).withColumn("elements", F.transform("elements", lambda e: F.when(symbol(e) == old, new).otherwise(symbol(e))))


def delete_atoms(structures: DataFrame, element: str) -> DataFrame:
    """Sites of an element removed with their positions; structures that would be empty are left out."""
    kept = F.filter(F.arrays_zip("elements", "positions"), lambda s: F.coalesce(symbol(s["elements"]) != element, F.lit(True)))
    out = structures.withColumn("_s", kept).where(F.size("_s") > 0)
    return out.withColumn("elements", F.col("_s.elements")).withColumn("positions", F.col("_s.positions")).drop("_s")


def scale_cell(structures: DataFrame, factor: float) -> DataFrame:
    """Cells (and Cartesian positions) multiplied by a factor."""
    scaled = lambda a: F.transform(a, lambda r: F.transform(r, lambda x: x * factor))
    d = structures.where("cell is not null").withColumn("_f", fractional())
    return d.withColumn("positions", F.when(F.col("_f"), F.col("positions")).otherwise(scaled("positions"))).withColumn("cell", scaled("cell")).drop("_f")


def supercell(site_rows: DataFrame, na: int, nb: int, nc: int) -> DataFrame:
    """(seq, image, element, fx, fy, fz) of na x nb x nc cells, fractions of the large cell; site_rows: `with_fractions`."""
    image = F.explode(F.sequence(F.lit(0), F.lit(na * nb * nc - 1)))
    d = site_rows.withColumn("image", image)
    i, j, k = F.floor(F.col("image") / (nb * nc)), F.floor(F.col("image") / nc) % nb, F.col("image") % nc
    return d.select("seq", "site", "image", "element", ((F.col("fx") + i) / na).alias("fx"), ((F.col("fy") + j) / nb).alias("fy"), ((F.col("fz") + k) / nc).alias("fz"))


def _search(r_max: float):
    names = ["seq", "site", "element", "nbr", "nbr_element", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = np.array([None, *SYMBOLS], object)
        for b in batches:
            s = Sites(b.column(1), b.column(2), b.column(3))
            ids, frac = np.asarray(b.column(0), np.int64), s.fractions()
            out: list[tuple[np.ndarray, ...]] = []
            for r in np.flatnonzero(s.crystal & (s.n > 0)):
                f, z, cell = frac[s.off[r] : s.off[r + 1]], s.z[s.off[r] : s.off[r + 1]], s.cells[r]
                f = f - np.floor(f)
                # cells to look at: r_max over the height of the cell along each axis
                n = np.ceil(r_max * np.linalg.norm(np.linalg.inv(cell), axis=0)).astype(int)
                image = np.stack(np.meshgrid(*[np.arange(-k, k + 1) for k in n], indexing="ij"), -1).reshape(-1, 3)
                d = ((f[None, :, None] - f[:, None, None] + image) @ cell).astype(float)
                dist = np.sqrt((d**2).sum(3))
                i, j, k = np.nonzero((dist <= r_max) & (dist > 1e-6))
                out.append((np.full(len(i), ids[r]), i, z[i], j, z[j], dist[i, j, k]))
            seq, i, zi, j, zj, dist = map(np.concatenate, zip(*out)) if out else (np.zeros(0, np.int64),) * 5 + (np.zeros(0),)
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(i, pa.int64()), pa.array(label[zi], pa.string()), pa.array(j, pa.int64()), pa.array(label[zj], pa.string()), pa.array(dist)], names=names)

    return run


def neighbours(structures: DataFrame, r_max: float) -> DataFrame:
    """(seq, site, element, nbr, nbr_element, distance): all periodic neighbours of crystals within r_max, itself in other cells too.

    As many cells are looked at along each axis as r_max reaches. Partners come from the same row, so the search needs no join and no shuffle; as an
    expression the triple loop over images makes generated code too large to compile in useful time, so it is an Arrow kernel. Structures that can't be
    read and molecules have no rows.
    """
    d = structures.select(F.col("seq").cast("long"), "elements", "positions", "cell").where("seq is not null and cell is not null")
    return d.mapInArrow(_search(r_max), "seq long, site long, element string, nbr long, nbr_element string, distance double")


def coordination(nbrs: DataFrame) -> DataFrame:
    """(seq, element, nbr_element, n_sites, mean_distance, min_distance, max_distance, n_bonds): statistics over element pairs."""
    return nbrs.groupBy("seq", "element", "nbr_element").agg(F.countDistinct("site").alias("n_sites"), F.count("*").alias("n_bonds"), F.avg("distance").alias("mean_distance"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))


def nearest(nbrs: DataFrame, k: int) -> DataFrame:
    """The k nearest neighbours of each site; ties at the same distance go to the smaller neighbour."""
    w = Window.partitionBy("seq", "site").orderBy(F.round("distance", 6), "nbr")
    return nbrs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pair_distribution(nbrs: DataFrame, delta: float) -> DataFrame:
    """(seq, element, nbr_element, bin, n): histogram of distances by element pair."""
    return nbrs.groupBy("seq", "element", "nbr_element", F.floor(F.col("distance") / delta).alias("bin")).agg(F.count("*").alias("n"))
