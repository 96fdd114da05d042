"""Feature vectors of structures for models, splits and kernels.

Fitting finds the columns (elements, or pairs of elements) of a collection: a distinct over elements, at most 118, comes to the driver. Transforming is row-wise;
elements that weren't there at fitting are left out, missing ones are 0.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import formula_columns as FC
from lodestone.operators import neighbours as N
from lodestone.operators.access import elements_of
from lodestone.operators.collection import symbol
from lodestone.operators.crystals import NUMBER, Sites

BLOCK = 1_000_000  # values of features that are held at a time


def fit_elements(structures: DataFrame) -> list[str]:
    """The elements of a collection in alphabetical order."""
    return sorted(r.element for r in elements_of(structures).collect())  # at most one row an element


def _counts(elements: list[str], over: Column) -> Column:
    """Number of sites of each element over a number; symbols are read once."""
    per = lambda m: F.array(*[F.coalesce(F.element_at(m, e), F.lit(0.0)) / over for e in elements])
    return FC.let(FC.from_list(F.transform("elements", symbol)), per)


def composition(structures: DataFrame, elements: list[str]) -> DataFrame:
    """(seq, features): share of each element."""
    return structures.select("seq", _counts(elements, F.nullif(F.size("elements"), F.lit(0))).alias("features"))


def density(structures: DataFrame, elements: list[str]) -> DataFrame:
    """(seq, features): sites of each element for a cubic angstrom; crystals only."""
    v = lambda i, k: F.col("cell")[i][k]
    volume = F.abs(v(0, 0) * (v(1, 1) * v(2, 2) - v(1, 2) * v(2, 1)) - v(0, 1) * (v(1, 0) * v(2, 2) - v(1, 2) * v(2, 0)) + v(0, 2) * (v(1, 0) * v(2, 1) - v(1, 1) * v(2, 0)))
    return structures.where(F.size("cell") == 3).select("seq", _counts(elements, F.nullif(volume, F.lit(0.0))).alias("features"))


def coordination(structures: DataFrame, elements: list[str], method: str = "minimum_distance", r_max: float = 10.0, **how) -> DataFrame:
    """(seq, features): mean, deviation, largest and smallest number of neighbours and distance of each ordered pair of elements.

    The vectors are filled in the kernel, a bounded number of values at a time: as columns of a plan they would be eight expressions a pair of elements.
    """
    m, find = len(elements), N.shells_for(method, **how)
    place = np.full(len(N.LABEL), -1)
    for k, e in enumerate(elements):
        if e in NUMBER:
            place[NUMBER[e]] = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = max(1, BLOCK // max(1, 8 * m * m)), []
        for b in batches:
            ids = b.column(0).to_pylist()
            for r, shell in find(Sites(b.column(1), b.column(2), b.column(3)), r_max):
                a, c, _, count, *v = N.pair_statistics(N.bonds(shell, method, r_max, **how)[0])
                at = np.flatnonzero((place[a] >= 0) & (place[c] >= 0))
                values = np.where(np.isfinite(v), v, 0.0)[[4, 5, 6, 7, 0, 1, 2, 3]][:, at].T  # numbers first, then distances
                rows.append((ids[r], (place[a[at]] * m + place[c[at]]), values))
                if len(rows) >= held:
                    yield vectors(rows)
                    rows = []
        if rows:
            yield vectors(rows)

    def vectors(rows: list) -> pa.RecordBatch:
        out = np.zeros((len(rows), m * m, 8))
        for x, (_, pair, values) in zip(out, rows):
            x[pair] = values
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (8 * m * m), pa.int32()), pa.array(out.reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), lists], names=["seq", "features"])

    d = structures.select(F.col("seq").cast("long").alias("seq"), "elements", "positions", "cell").where("seq is not null and elements is not null and positions is not null")
    return d.mapInArrow(run, "seq long, features array<double>")


def chemical_order(structures: DataFrame, elements: list[str], max_shells: int = 3, r_max: float = 10.0) -> DataFrame:
    """(seq, features): mean Warren-Cowley parameter of each element and shell."""
    w = N.warren_cowley(structures, max_shells, r_max).groupBy("seq", "element", "shell").agg(F.avg("value").alias("value"))
    one = w.groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "element", "shell").alias("k"), "value"))).alias("m"))
    return one.select("seq", F.array(*[F.coalesce(F.col("m")[f"{e}-{k}"], F.lit(0.0)) for e in elements for k in range(1, max_shells + 1)]).alias("features"))


def fingerprint(structures: DataFrame, elements: list[str], r_max: float = 20.0, delta: float = 0.005, sigma: float = 0.05) -> DataFrame:
    """(seq, features): fingerprints of each pair of elements, times the root of its weight, one after the other, 0 for pairs a structure lacks."""
    bins = int(-(-r_max // delta))
    f = N.fingerprints(structures, r_max, delta, sigma)
    part = F.transform("values", lambda v: v * F.sqrt("weight"))
    one = f.groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "element", "nbr_element").alias("k"), part.alias("v")))).alias("m"))
    none = F.array_repeat(F.lit(0.0), bins)
    return one.select("seq", F.flatten(F.array(*[F.coalesce(F.col("m")[f"{a}-{b}"], none) for a, b in itertools.combinations_with_replacement(elements, 2)])).alias("features"))


def pair_distribution(structures: DataFrame, elements: list[str], r_max: float = 20.0, delta: float = 0.5) -> DataFrame:
    """(seq, features): pair distributions of each ordered pair of elements, one after the other."""
    bins = int(-(-r_max // delta))
    p = N.pair_distribution(structures, r_max, delta).groupBy("seq", "element", "nbr_element").agg(F.map_from_entries(F.collect_list(F.struct("bin", "value"))).alias("v"))
    one = p.groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "element", "nbr_element").alias("k"), "v"))).alias("m"))
    spread = lambda m: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), lambda b: F.coalesce(F.element_at(m, b), F.lit(0.0)))
    none = F.array_repeat(F.lit(0.0), bins)
    return one.select("seq", F.flatten(F.array(*[F.coalesce(spread(F.col("m")[f"{a}-{b}"]), none) for a, b in itertools.product(elements, repeat=2)])).alias("features"))


def coulomb_matrix(structures: DataFrame) -> DataFrame:
    """(seq, features): eigenvalues, by falling size, of the Coulomb matrix of molecules: 0.5 Z^2.4 on the diagonal, Z1 Z2 / distance off it."""
    def run(batches):
        for b in batches:
            s, ids, out = Sites(b.column(1), b.column(2), b.column(3)), b.column(0).to_pylist(), []
            for r in np.flatnonzero((s.n > 0) & ~s.crystal):
                x, z = s.xyz[s.off[r] : s.off[r + 1]], s.z[s.off[r] : s.off[r + 1]].astype(float)
                d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
                m = z[:, None] * z[None] / np.where(d > 1e-9, d, np.inf)
                np.fill_diagonal(m, 0.5 * z**2.4)
                v = np.linalg.eigvalsh(m)
                out.append((ids[r], v[np.argsort(-np.abs(v))].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.float64()))], names=["seq", "features"])

    d = structures.select(F.col("seq").cast("long").alias("seq"), "elements", "positions", "cell").where("seq is not null and elements is not null and positions is not null")
    return d.mapInArrow(run, "seq long, features array<double>")


def cosine_distance(a: Column, b: Column) -> Column:
    """Half of 1 minus the cosine of two feature vectors; null where one is 0."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    length = lambda c: F.sqrt(total(F.transform(c, lambda x: x * x)))
    return 0.5 * (1 - dot / F.nullif(length(a) * length(b), F.lit(0.0)))


def cosine_kernel(a: Column, b: Column) -> Column:
    return 1 - cosine_distance(a, b)


def laplace_kernel(a: Column, b: Column, gamma: float = 1.0) -> Column:
    return F.exp(-gamma * cosine_distance(a, b))


def split_sizes(n: int, train: float | None = None, test: float | None = 0.2) -> tuple[int, int]:
    """Numbers of training and test structures; a size above 1 is a number, else a share (training rounded down, test up)."""
    size = lambda v, up: int(v) if v > 1 else -int(-(v * n) // 1) if up else int(v * n // 1)
    n_test = size(test, True) if test is not None else n - size(train, False)
    n_train = size(train, False) if train is not None else n - n_test
    if n_train + n_test > n or min(n_train, n_test) < 0:
        raise ValueError(f"{n_train} and {n_test} structures are more than the {n} there are")
    return n_train, n_test


def stratified_split(structures: DataFrame, strata: Column, test: float = 0.2, seed: int = 0) -> DataFrame:
    """(seq, part): 'test' or 'train', the shares nearly the same in every stratum; a structure's part depends on seed, seq and the share only, so it doesn't
    change when others arrive."""
    u = F.pmod(F.xxhash64(F.lit(seed), "seq"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return structures.select("seq", strata.alias("stratum"), F.when(u < test, "test").otherwise("train").alias("part"))
