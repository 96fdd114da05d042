"""Neighbours of sites and what follows from them, aggregated inside Arrow kernels: coordination by five methods, distance statistics, pair
distributions, fingerprints and their order parameter.

All partners of a site are in the row of its structure, so nothing here joins or shuffles: a structure goes in, its results come out. Periodic images of the
site itself are neighbours; the site in its own cell isn't. Crystals are periodic in all directions; without a cell a structure is a molecule.
Rows that can't be read (null, empty or uneven sites) give no rows. Structures are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.elements import RADII
from lodestone.operators.crystals import SYMBOLS, Sites
from lodestone.operators.voronoi import cells_of
from lodestone.operators.walks import order_parameters

LABEL = np.array([None, *SYMBOLS], object)
BLOCK = 4_000_000  # distances that are held at a time
HELD = 20_000  # sites whose walks are summed up at a time, or those of one structure
PAIRS = 100_000  # pairs whose Voronoi cells are cut at a time
METHODS = ("minimum_distance", "n_nearest_neighbours", "atomic_radius", "econ", "voronoi", "radius")


class Shell:
    """Pairs (i, j) of one structure with their distance and step, sorted by i, then distance (to 1e-6), then j."""

    def __init__(self, z: np.ndarray, i: np.ndarray, j: np.ndarray, step: np.ndarray, image: np.ndarray, cart: np.ndarray, volume: float):
        dist = np.sqrt((step**2).sum(1))
        order = np.lexsort((j, np.round(dist, 6), i))
        self.z, self.cart, self.volume, self.cells = z, cart, volume, None
        self.i, self.j, self.step, self.image, self.dist = i[order], j[order], step[order], image[order], dist[order]
        self.first = np.searchsorted(self.i, np.arange(len(z) + 1))
        self.rank = np.arange(len(i)) - self.first[self.i]

    def keep(self, mask: np.ndarray, weight: np.ndarray | None = None) -> tuple[Shell, np.ndarray | None]:
        out = object.__new__(Shell)
        out.z, out.cart, out.volume, out.cells = self.z, self.cart, self.volume, None
        out.i, out.j, out.step, out.image, out.dist = self.i[mask], self.j[mask], self.step[mask], self.image[mask], self.dist[mask]
        out.first = np.searchsorted(out.i, np.arange(len(self.z) + 1))
        out.rank = np.arange(len(out.i)) - out.first[out.i]
        return out, None if weight is None else weight[mask]


@lru_cache(64)
def _grid(a: int, b: int, c: int) -> np.ndarray:
    return np.stack(np.meshgrid(*[np.arange(-k, k + 1) for k in (a, b, c)], indexing="ij"), -1).reshape(-1, 3)


def shells(s: Sites, r_max: float) -> Iterator[tuple[int, Shell]]:
    """(row, pairs within r_max) for each structure of a batch that can be read; partners are searched in as many cells as r_max reaches."""
    frac = s.fractions()
    for r in np.flatnonzero(s.n > 0):
        x, z = frac[s.off[r] : s.off[r + 1]], s.z[s.off[r] : s.off[r + 1]]
        if s.crystal[r]:
            cell = s.cells[r]
            reach = np.ceil(r_max * np.linalg.norm(np.linalg.inv(cell), axis=0)).astype(int)
            grid = _grid(*reach.tolist())
            image = grid @ cell
            cart, volume = (x - np.floor(x)) @ cell, float(abs(np.linalg.det(cell)))
            # images that are too far for any two sites, to within rounding
            some = np.sqrt((image**2).sum(1)) <= r_max + np.linalg.norm(cart.max(0) - cart.min(0)) + 1e-6
            grid, image = grid[some], image[some]
        else:
            grid, image, cart, volume = np.zeros((1, 3), int), np.zeros((1, 3)), x, float("nan")
        home = int(np.flatnonzero((grid == 0).all(1))[0])
        parts = []
        step = max(1, BLOCK // (len(image) * len(x)))
        square = (image**2).sum(1)
        for a in range(0, len(x), step):
            own = np.arange(a, min(a + step, len(x)))
            # near ones by one product, a little beyond r_max; what counts is the step itself
            apart = (cart[None] - cart[own, None]).astype(float)
            near = 2 * (apart.reshape(-1, 3) @ image.T) + (apart.reshape(-1, 3) ** 2).sum(1)[:, None] + square
            near = (near <= r_max * r_max + 1e-6 * (1 + r_max * r_max)).reshape(len(own), len(x), len(image))
            near[own - a, own, home] = False
            i, j, k = np.nonzero(near)
            d = cart[j] + image[k] - cart[i + a]
            use = (d**2).sum(1) <= r_max * r_max
            parts.append((i[use] + a, j[use], d[use], grid[k[use]]))
        i, j, d, k = (np.concatenate(p) for p in zip(*parts))
        yield int(r), Shell(z, i, j, d, k, cart, volume)


def shells_for(method: str, weight_type: str | None = "rel_solid_angle", **_) -> Callable[[Sites, float], Iterator[tuple[int, Shell]]]:
    """How `shells` are found for a method: with their Voronoi cells, which are cut for many structures at a time, if it needs them."""

    def find(s: Sites, r_max: float) -> Iterator[tuple[int, Shell]]:
        held: list[tuple[int, Shell]] = []
        size = 0
        for r, shell in shells(s, r_max):
            held.append((r, shell))
            size += len(shell.i)
            if size >= PAIRS:
                yield from cut(held)
                held, size = [], 0
        yield from cut(held)

    def cut(held: list[tuple[int, Shell]]) -> list[tuple[int, Shell]]:
        for (_, shell), cells in zip(held, cells_of([shell for _, shell in held], weight_type, RADII)):
            shell.cells = weight_type, *cells
        return held

    return find if method == "voronoi" else shells


def bonds(shell: Shell, method: str, r_max: float, delta: float = 0.1, k: int = 5, radius_type: str = "chen_manz", radius_delta: float = 0.0, econ_tolerance: float = 0.5, econ_threshold: float = 1e-3, weight_type: str | None = "rel_solid_angle", weight_threshold: float = 0.5) -> tuple[Shell, np.ndarray | None]:
    """The pairs that count as bonds, and their weights where the method has some.

    minimum_distance: up to (1 + delta) times the site's shortest distance; n_nearest_neighbours: the k nearest, ties to the smaller partner; atomic_radius:
    up to (1 + radius_delta) times the sum of the radii, none where a radius is unknown; econ: weight exp(1 - (d / mean)^6) of at least econ_tolerance, where mean is the
    weighted mean distance, iterated until it moves by less than econ_threshold; voronoi: Voronoi neighbours above weight_threshold; radius: all in r_max.
    """
    if method == "radius":
        return shell, None
    if method == "n_nearest_neighbours":
        return shell.keep(shell.rank < k)
    if method == "atomic_radius":
        radius = np.array([np.nan, *[np.nan if v is None else v for v in RADII[radius_type]]])[shell.z]
        return shell.keep(shell.dist <= (1 + radius_delta) * (radius[shell.i] + radius[shell.j]))
    n = len(shell.z)
    some = shell.first[1:] > shell.first[:-1]
    least = np.full(n, np.inf)
    least[some] = shell.dist[shell.first[:-1][some]]
    if method == "minimum_distance":
        return shell.keep(shell.dist <= least[shell.i] * (1 + delta))
    if method == "econ":
        before, mean = np.full(n, np.nan), least.copy()
        go = some.copy()
        while go.any():
            before[go] = mean[go]
            with np.errstate(over="ignore", invalid="ignore"):
                w = np.exp(1 - (shell.dist / before[shell.i]) ** 6)
            mean[go] = (np.bincount(shell.i, w * shell.dist, n) / np.maximum(np.bincount(shell.i, w, n), 1e-300))[go]
            go &= np.abs(mean - before) >= econ_threshold
        w = np.exp(1 - (shell.dist / before[shell.i]) ** 6)
        return shell.keep(w >= econ_tolerance, w)
    if method == "voronoi":
        kind, w, face = shell.cells or (None, None, None)
        if w is None or kind != weight_type:
            w, face = cells_of([shell], weight_type, RADII)[0]
        if weight_type is None:
            return shell.keep(face)
        if weight_type.startswith("rel_"):
            most = np.zeros(n)
            np.maximum.at(most, shell.i[face], w[face])
            w = w / np.where(most > 0, most, 1.0)[shell.i]
        return shell.keep(face & (w > weight_threshold), w)
    raise ValueError(f"method {method!r} is none of {METHODS}")


def _kernel(names: list[str], work: Callable[[Shell], list[tuple]], kinds: list[pa.DataType], r_max: float, find=shells):
    """Arrow batches (id, elements, positions, cell) to rows (id, *work(shell)); work returns columns of equal length."""
    schema = pa.schema([("seq", pa.int64()), *zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for r, shell in find(Sites(b.column(1), b.column(2), b.column(3)), r_max):
                cols = work(shell)
                out.append((np.full(len(cols[0]), ids[r], np.int64), *cols))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for part in c for x in part], t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def _run(structures: DataFrame, names: list[str], ddl: str, work, kinds, r_max: float, find=shells) -> DataFrame:
    d = structures.select(F.col("seq").cast("long").alias("seq"), "elements", "positions", "cell").where("seq is not null and elements is not null and positions is not null")
    return d.mapInArrow(_kernel(names, work, kinds, r_max, find), f"seq long, {ddl}")


def pairs(structures: DataFrame, r_max: float = 10.0, method: str = "radius", **how) -> DataFrame:
    """(seq, site, element, nbr, nbr_element, distance, weight): one row a bond; weight is null where the method has none."""

    def work(shell: Shell):
        s, w = bonds(shell, method, r_max, **how)
        return s.i.astype(np.int64), LABEL[s.z[s.i]], s.j.astype(np.int64), LABEL[s.z[s.j]], s.dist, np.full(len(s.i), np.nan) if w is None else w

    out = _run(structures, ["site", "element", "nbr", "nbr_element", "distance", "weight"], "site long, element string, nbr long, nbr_element string, distance double, weight double",
               work, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64()], r_max, shells_for(method, **how))
    return out.withColumn("weight", F.when(~F.isnan("weight"), F.col("weight")))


_NBR = pa.list_(pa.struct([("site_index", pa.int64()), ("element", pa.string()), ("distance", pa.float64()), ("weight", pa.float64())]))


def coordination_sites(structures: DataFrame, method: str = "atomic_radius", r_max: float = 10.0, **how) -> DataFrame:
    """(seq, site, element, total_cn, min_dist, max_dist, avg_dist, neighbours): one row a site, 0 where it has no neighbours; neighbours sorted by site."""

    def work(shell: Shell):
        s, w = bonds(shell, method, r_max, **how)
        n = len(s.z)
        cn = np.bincount(s.i, minlength=n)
        low, high = np.full(n, np.inf), np.zeros(n)
        np.minimum.at(low, s.i, s.dist)
        np.maximum.at(high, s.i, s.dist)
        mean = np.bincount(s.i, s.dist, n) / np.maximum(cn, 1)
        weight = [None] * len(s.i) if w is None else w.tolist()
        order = np.lexsort((s.rank, s.j, s.i))
        rows = [{"site_index": int(s.j[k]), "element": LABEL[s.z[s.j[k]]], "distance": float(s.dist[k]), "weight": weight[k]} for k in order]
        return np.arange(n), LABEL[s.z], cn.astype(np.int64), np.where(cn > 0, low, 0.0), high, mean, [rows[a:b] for a, b in zip(s.first[:-1], s.first[1:])]

    return _run(structures, ["site", "element", "total_cn", "min_dist", "max_dist", "avg_dist", "neighbours"],
                "site long, element string, total_cn long, min_dist double, max_dist double, avg_dist double, neighbours array<struct<site_index: long, element: string, distance: double, weight: double>>",
                work, [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), _NBR], r_max, shells_for(method, **how))


def _moments(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, sample deviation (0 for one value), largest and smallest of the values of each group."""
    count = np.bincount(group, minlength=n)
    mean = np.bincount(group, value, n) / np.maximum(count, 1)
    dev = np.sqrt(np.bincount(group, (value - mean[group]) ** 2, n) / np.maximum(count - 1, 1))
    high, low = np.full(n, -np.inf), np.full(n, np.inf)
    np.maximum.at(high, group, value)
    np.minimum.at(low, group, value)
    return mean, dev, high, low


def pair_statistics(s: Shell) -> tuple:
    """Of bonds: (z1, z2, sites with a bond, bonds, mean, deviation, largest and smallest distance, then the same of the number of neighbours) by pair of elements;
    distances are NaN for pairs without bonds."""
    kinds, at = np.unique(s.z, return_inverse=True)
    m = len(kinds)
    pair = at[s.i] * m + at[s.j]
    d = _moments(pair, s.dist, m * m)
    count = np.bincount(pair, minlength=m * m)
    per = np.bincount(s.i * m + at[s.j], minlength=len(s.z) * m)
    k = _moments((at[:, None] * m + np.arange(m)).reshape(-1), per.astype(float), m * m)
    none = np.where(count > 0, 0.0, np.nan)
    a, b = np.divmod(np.arange(m * m), m)
    with_bond = np.bincount((at[:, None] * m + np.arange(m)).reshape(-1), per > 0, m * m).astype(np.int64)
    return kinds[a], kinds[b], with_bond, count.astype(np.int64), *[np.where(count > 0, x, 0.0) + none for x in d], *k


def coordination_statistics(structures: DataFrame, method: str = "atomic_radius", r_max: float = 10.0, **how) -> DataFrame:
    """(seq, element, nbr_element, n_sites, n_bonds, distance_avg/stdev/max/min, nrs_avg/stdev/max/min): one row for each pair of elements of a structure.

    nrs: the number of neighbours of nbr_element, over all sites of element, also those without; distances are null for pairs without bonds.
    """

    def work(shell: Shell):
        a, b, *rest = pair_statistics(bonds(shell, method, r_max, **how)[0])
        return LABEL[a], LABEL[b], *rest

    stats = [f"{q}_{f}" for q in ("distance", "nrs") for f in ("avg", "stdev", "max", "min")]
    out = _run(structures, ["element", "nbr_element", "n_sites", "n_bonds", *stats], "element string, nbr_element string, n_sites long, n_bonds long, " + ", ".join(f"{c} double" for c in stats),
               work, [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 8], r_max, shells_for(method, **how))
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in stats[:4]})


def histogram(shell: Shell, r_max: float, delta: float, weights: str) -> tuple[np.ndarray, np.ndarray]:
    """(kinds, values[kind1, kind2, bin]) over distances below r_max.

    prdf: each pair counts 3 / (4 pi (shell volume) n1); ffingerprint: volume / (4 pi delta d^2 n1 n2).
    """
    bins = int(np.ceil(r_max / delta))
    kinds, at, n = np.unique(shell.z, return_inverse=True, return_counts=True)
    use = shell.dist < r_max
    i, j, d = at[shell.i[use]], at[shell.j[use]], shell.dist[use]
    b = np.floor(d / delta).astype(int).clip(max=bins - 1)
    if weights == "prdf":
        low = b * delta
        w = 3 / (4 * np.pi * ((low + delta) ** 3 - low**3) * n[i])
    else:
        w = shell.volume / (4 * np.pi * delta * d**2 * n[i] * n[j])
    m = len(kinds)
    return kinds, np.bincount((i * m + j) * bins + b, w, m * m * bins).reshape(m, m, bins)


def pair_distribution(structures: DataFrame, r_max: float = 20.0, delta: float = 0.005) -> DataFrame:
    """(seq, element, nbr_element, bin, value): normalised partial pair distribution; bins without pairs have no row."""

    def work(shell: Shell):
        kinds, v = histogram(shell, r_max, delta, "prdf")
        a, b, k = np.nonzero(v)
        return LABEL[kinds[a]], LABEL[kinds[b]], k.astype(np.int64), v[a, b, k]

    return _run(structures, ["element", "nbr_element", "bin", "value"], "element string, nbr_element string, bin long, value double", work, [pa.string(), pa.string(), pa.int64(), pa.float64()], r_max)


def smooth(y: np.ndarray, sigma: float, method: str = "gaussian", width: float = 1.0, radius: int | None = None) -> np.ndarray:
    """Series along the last axis, convolved with a Gaussian or Lorentzian kernel of unit sum; edges are padded with 0, the length stays."""
    radius = int(4 * sigma + 0.5) if radius is None else radius
    x = np.arange(-radius, radius + width, width)
    w = np.exp(-0.5 * (x / sigma) ** 2) if method == "gaussian" else 0.5 * sigma / (x**2 + (0.5 * sigma) ** 2)
    w = w / w.sum()
    half, n = len(w) // 2, y.shape[-1]
    padded = np.concatenate([np.zeros((*y.shape[:-1], half)), y, np.zeros((*y.shape[:-1], half))], -1)
    return sum(c * padded[..., k : k + n] for k, c in enumerate(w[::-1]))


def fingerprint_values(shell: Shell, r_max: float, delta: float, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind1, kind2, values[pair, bin], weight) of each pair of elements, kind1 <= kind2 by symbol; weights n1 n2 add up to 1."""
    kinds, v = histogram(shell, r_max, delta, "ffingerprint")
    order = np.argsort(LABEL[kinds].astype(str))
    kinds, v = kinds[order], v[order][:, order]
    n = np.array([(shell.z == k).sum() for k in kinds], float)
    a, b = np.triu_indices(len(kinds))
    w = n[a] * n[b]
    return kinds[a], kinds[b], smooth(v[a, b], sigma) - 1, w / w.sum()


def fingerprints(structures: DataFrame, r_max: float = 20.0, delta: float = 0.005, sigma: float = 0.05) -> DataFrame:
    """(seq, element, nbr_element, weight, values): F-fingerprint of crystals for each pair of elements: smeared pair distribution less 1. sigma is in bins."""

    def work(shell: Shell):
        if not np.isfinite(shell.volume):
            return [], [], [], []
        a, b, v, w = fingerprint_values(shell, r_max, delta, sigma)
        return list(LABEL[a]), list(LABEL[b]), w.tolist(), v.tolist()

    return _run(structures, ["element", "nbr_element", "weight", "values"], "element string, nbr_element string, weight double, values array<double>", work, [pa.string(), pa.string(), pa.float64(), pa.list_(pa.float64())], r_max)


def site_fingerprints(structures: DataFrame, r_max: float = 20.0, delta: float = 0.005, sigma: float = 0.05) -> DataFrame:
    """(seq, site, element, nbr_element, values): F-fingerprint of every site of crystals towards each element."""
    bins = int(np.ceil(r_max / delta))

    def work(shell: Shell):
        if not np.isfinite(shell.volume):
            return [], [], [], []
        kinds, at, n = np.unique(shell.z, return_inverse=True, return_counts=True)
        use = shell.dist < r_max
        i, j, d = shell.i[use], at[shell.j[use]], shell.dist[use]
        b = np.floor(d / delta).astype(int).clip(max=bins - 1)
        w = shell.volume / (4 * np.pi * delta * d**2 * n[j])  # the site's own element counts once for each site of it
        v = smooth(np.bincount((i * len(kinds) + j) * bins + b, w, len(at) * len(kinds) * bins).reshape(len(at), len(kinds), bins), sigma) - 1
        site, kind = np.divmod(np.arange(len(at) * len(kinds)), len(kinds))
        return site.tolist(), list(LABEL[shell.z[site]]), list(LABEL[kinds[kind]]), v.reshape(-1, bins).tolist()

    return _run(structures, ["site", "element", "nbr_element", "values"], "site long, element string, nbr_element string, values array<double>", work, [pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64())], r_max)


def order_parameter(structures: DataFrame, r_max: float = 15.0, delta: float = 0.005, sigma: float = 0.05) -> DataFrame:
    """(seq, total): sum over element pairs of weight * delta * (volume / sites)^(1/3) * |fingerprint|^2, crystals only."""

    def work(shell: Shell):
        if not np.isfinite(shell.volume):
            return (np.zeros(0),)
        _, _, v, w = fingerprint_values(shell, r_max, delta, sigma)
        return (np.array([(w * (v**2).sum(1)).sum() * delta * np.cbrt(shell.volume / len(shell.z))]),)

    return _run(structures, ["total"], "total double", work, [pa.float64()], r_max)


def warren_cowley(structures: DataFrame, max_shells: int = 3, r_max: float = 10.0) -> DataFrame:
    """(seq, site, element, shell, value): 1 - p / c for each site and shell of Voronoi neighbours. p is the share of the site's own element among the ends of
    self-avoiding walks of `shell` steps, weighted by the product of the faces crossed; c is the element's share of all sites. 0 for structures of one element.

    Up to three shells of crystals are summed up for many at a time; molecules, crystals whose cells r_max leaves open and further shells are walked site by site.
    """

    def work(shell: Shell):
        n = len(shell.z)
        site, number = np.repeat(np.arange(n), max_shells), np.tile(np.arange(1, max_shells + 1), n)
        value = np.zeros((n, max_shells))
        if len(np.unique(shell.z)) > 1:
            s, w = bonds(shell, "voronoi", r_max, weight_type="area", weight_threshold=0.0)
            moves = [list(zip(s.j[a:b].tolist(), map(tuple, s.image[a:b].tolist()), w[a:b].tolist())) for a, b in zip(s.first[:-1], s.first[1:])]
            for at in range(n):
                # walks with the same end and the same sites behind them go on alike
                walks = {((at, (0, 0, 0)), frozenset()): 1.0}
                for k in range(max_shells):
                    after: dict = {}
                    for ((j, cell), seen), weight in walks.items():
                        behind = seen | {(j, cell)}
                        for to, shift, face in moves[j]:
                            end = (to, (cell[0] + shift[0], cell[1] + shift[1], cell[2] + shift[2]))
                            if end not in behind:
                                after[end, behind] = after.get((end, behind), 0.0) + weight * face
                    total = sum(after.values())
                    own = sum(v for ((j, _), _), v in after.items() if shell.z[j] == shell.z[at])
                    value[at, k] = 1 - own / total / (shell.z == shell.z[at]).mean() if total > 0 else np.nan
                    walks = after
        return site, LABEL[shell.z[site]], number.astype(np.int32), value.reshape(-1)

    names, kinds = ["site", "element", "shell", "value"], [pa.int64(), pa.string(), pa.int32(), pa.float64()]
    each = _kernel(names, work, kinds, r_max, shells_for("voronoi", "area"))
    schema = pa.schema([("seq", pa.int64()), *zip(names, kinds)])

    def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(b.column(1)), 0), np.int64))
        lo = 0
        while lo < len(b):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HELD, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in slices(b)):
            s = Sites(b.column(1), b.column(2), b.column(3))
            value, left = order_parameters(s, max_shells, r_max)
            at = np.repeat(np.flatnonzero(~left[s.row]), max_shells)
            number = np.tile(np.arange(1, max_shells + 1, dtype=np.int32), len(at) // max_shells)
            cols = np.asarray(b.column(0))[s.row[at]], at - s.off[s.row[at]], LABEL[s.z[at]], number, value[~left[s.row]].reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)
            if left.any():
                yield from each(iter([b.filter(pa.array(left))]))

    if max_shells > 3:
        run = each
    d = structures.select(F.col("seq").cast("long").alias("seq"), "elements", "positions", "cell").where("seq is not null and elements is not null and positions is not null")
    return d.mapInArrow(run, "seq long, site long, element string, shell int, value double")
