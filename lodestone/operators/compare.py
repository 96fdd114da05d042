"""Comparison of structures and of sites: fingerprint distance, direct comparison, composition with symmetry; duplicates and equivalent sites.

Nothing compares all pairs. Fingerprints of structures with the same reduced formula are unit vectors: two that are close are close along any direction, so the
duplicates of one lie in its own or neighbouring bins of a few fixed directions. The result is the same as that of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import formula_columns as FC
from lodestone.operators import neighbours as N
from lodestone.operators.collection import symbol
from lodestone.operators.crystals import Sites, SiteTable, cells_agree, coincide, metric
from lodestone.session import Scratch


def reduced_formula_key(elements: str = "elements") -> F.Column:
    """The reduced formula as one text, the same for structures of the same composition."""
    return FC.canonical(FC.reduce_whole(FC.from_list(F.transform(elements, symbol))))


def fingerprint_vectors(structures: DataFrame, r_max: float = 20.0, delta: float = 0.005, sigma: float = 0.05) -> DataFrame:
    """(seq, formula, vector): fingerprints of crystals with their weights as one vector of length 1, pairs of elements in alphabetical order."""
    f = N.fingerprints(structures, r_max, delta, sigma)
    part = F.transform("values", lambda v: v * F.sqrt("weight"))
    one = f.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("element", "nbr_element", part.alias("v")))).alias("p"))
    flat = F.flatten(F.transform("p", lambda p: p["v"]))
    length = F.sqrt(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x * x))
    keys = structures.select("seq", reduced_formula_key().alias("formula"))
    return one.select("seq", F.transform(flat, lambda x: x / F.nullif(length, F.lit(0.0))).alias("vector")).join(keys, "seq").select("seq", "formula", "vector")


def fingerprint_distance(a: F.Column, b: F.Column) -> F.Column:
    """Half of 1 minus the cosine of two unit vectors."""
    return 0.5 * (1 - F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def close_fingerprints(vectors: DataFrame, threshold: float = 1e-3, directions: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(seq_1, seq_2, distance), seq_1 < seq_2: all pairs of different fingerprints of the same formula that are at most `threshold` apart; and (seq_1, seq_2): records with
    the fingerprint of an earlier one.

    Unit vectors that far apart differ by at most w = 2 sqrt(threshold) along any direction. Each vector is placed in a bin of width w for each of a few fixed directions and
    visits the nearer of the bins next to it; pairs that meet are then measured. Equal vectors are one row, that of the smallest seq.
    """
    wide = 2 * np.sqrt(threshold) + 1e-9

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for b in batches:
            out: list[list] = [[], [], [], []]
            for k, (seq, formula, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))):
                v = np.asarray(v.values, float)
                if len(v) not in drawn:
                    q, _ = np.linalg.qr(np.random.default_rng(seed + len(v)).normal(size=(len(v), min(directions, len(v)))))
                    drawn[len(v)] = q
                p = v @ drawn[len(v)]
                home = np.floor(p / wide).astype(np.int64)
                offers = np.stack(np.meshgrid(*[(0, 1)] * len(p), indexing="ij"), -1).reshape(-1, len(p))
                side = np.where(p / wide - home >= 0.5, 1, -1)
                for o in offers:
                    out[0].append(seq)
                    out[1].append(formula)
                    out[2].append((home + o * side).tolist())
                    out[3].append(not o.any())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.bool_())], names=["seq", "formula", "bin", "home"])

    scratch = Scratch(vectors.sparkSession, "fingerprints")
    vectors = scratch.keep(vectors.where("vector is not null and formula is not null"))
    first = vectors.groupBy("formula", "vector").agg(F.min("seq").alias("seq"))
    first = scratch.keep(first)
    # a row goes to its own bin and the nearer neighbour in every direction: two rows at most a bin's width apart share one
    placed = scratch.keep(first.select("seq", "formula", "vector").mapInArrow(bins, "seq long, formula string, bin array<long>, home boolean"))
    meet = placed.alias("a").join(placed.alias("b"), ["formula", "bin"]).where("a.seq < b.seq").select(F.col("a.seq").alias("seq_1"), F.col("b.seq").alias("seq_2")).distinct()
    v = first.select("seq", "vector")
    found = meet.join(v.select(F.col("seq").alias("seq_1"), F.col("vector").alias("v1")), "seq_1").join(v.select(F.col("seq").alias("seq_2"), F.col("vector").alias("v2")), "seq_2")
    found = found.select("seq_1", "seq_2", fingerprint_distance(F.col("v1"), F.col("v2")).alias("distance")).where(F.col("distance") <= threshold)
    copies = vectors.join(first.withColumnRenamed("seq", "first"), ["formula", "vector"]).where("seq <> first").select(F.col("first").alias("seq_1"), F.col("seq").alias("seq_2"))
    return scratch.keep(found), scratch.keep(copies)


def find_duplicates_by_fingerprint(structures: DataFrame, threshold: float = 1e-3, r_max: float = 20.0, delta: float = 0.005, sigma: float = 0.05) -> DataFrame:
    """(seq, duplicate_of): each crystal with an earlier one of the same reduced formula at a fingerprint distance of at most `threshold`, and the first such.

    Rows with equal fingerprints are duplicates of the first of them. Molecules and rows that can't be read have no fingerprint.
    """
    close, copies = close_fingerprints(fingerprint_vectors(structures, r_max, delta, sigma), threshold)
    first = close.groupBy(F.col("seq_2").alias("seq")).agg(F.min("seq_1").alias("duplicate_of"))
    again = copies.join(first.select(F.col("seq").alias("seq_1"), "duplicate_of"), "seq_1", "left").select(F.col("seq_2").alias("seq"), F.coalesce("duplicate_of", "seq_1").alias("duplicate_of"))
    return first.union(again)


def compare_pairs(structures: DataFrame, pairs: DataFrame, length_tol: float = 0.05, angle_tol: float = 1.0, site_tol: float = 0.3) -> DataFrame:
    """(seq_1, seq_2, same_formula, same_cell, same_sites) for the stated pairs of crystals, compared directly: equal reduced formula, cell lengths within length_tol,
    angles within angle_tol degrees (axes named in turn), and all sites of the one with more on sites of the other within site_tol angstrom for some origin."""
    d = structures.select(F.col("seq").cast("long").alias("seq"), "elements", "positions", "cell", reduced_formula_key().alias("formula"))
    side = lambda k: d.select(*[F.col(c).alias(f"{c}_{k}") for c in d.columns])
    both = pairs.select("seq_1", "seq_2").join(side(1), "seq_1").join(side(2), "seq_2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, q = Sites(b.column(3), b.column(4), b.column(5)), Sites(b.column(6), b.column(7), b.column(8))
            n = np.arange(b.num_rows)
            par, par2 = p.parameters(), q.parameters()
            with np.errstate(invalid="ignore"):
                agree = cells_agree(par, par2, length_tol, angle_tol)
            ta, tb = SiteTable(p.n, p.z, p.fractions()), SiteTable(q.n, q.z, q.fractions())
            pair, turn = np.nonzero(agree & ((p.n > 0) & (p.n == q.n))[:, None])
            ok = coincide(ta, tb, n[pair], n[pair], turn, metric(par[pair]), p.n[pair], site_tol)
            hit = np.zeros(b.num_rows, bool)
            hit[pair[ok]] = True
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(agree.any(1)), pa.array(hit)], names=["seq_1", "seq_2", "same_formula", "same_cell", "same_sites"])

    cols = both.select(F.col("seq_1").cast("long"), F.col("seq_2").cast("long"), (F.col("formula_1") == F.col("formula_2")).alias("same_formula"), *[f"{c}_{k}" for k in (1, 2) for c in ("elements", "positions", "cell")])
    return cols.mapInArrow(run, "seq_1 long, seq_2 long, same_formula boolean, same_cell boolean, same_sites boolean")


def duplicates_by_composition_and_symmetry(structures: DataFrame, space_group: F.Column) -> DataFrame:
    """(seq, duplicate_of): records with the same reduced formula and space group as an earlier one; null groups match nothing. One aggregate and one join on its result."""
    d = structures.select("seq", reduced_formula_key().alias("formula"), space_group.alias("sg")).where("formula is not null and sg is not null")
    first = d.groupBy("formula", "sg").agg(F.min("seq").alias("duplicate_of"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, ["formula", "sg"]).where("seq <> duplicate_of").select("seq", "duplicate_of")


def equivalent_sites(structures: DataFrame, method: str = "minimum_distance", r_max: float = 10.0, threshold: float = 0.1, **how) -> DataFrame:
    """(seq, element, group, site): sites of a structure whose neighbours agree. A site joins the first group of its element whose first site has as many
    neighbours of each element at distances that differ by less than threshold, sorted one by one; group is the place of the group among those of its element."""

    def work(shell: N.Shell):
        s, _ = N.bonds(shell, method, r_max, **how)
        about = []
        for a, b in zip(s.first[:-1], s.first[1:]):
            order = np.lexsort((s.dist[a:b], s.z[s.j[a:b]]))
            about.append((s.z[s.j[a:b]][order], s.dist[a:b][order]))
        groups: dict[int, list[int]] = {}
        number = np.zeros(len(s.z), np.int64)
        for k, (z, d) in enumerate(about):
            firsts = groups.setdefault(int(s.z[k]), [])
            for g, f in enumerate(firsts):
                if len(about[f][0]) == len(z) and (about[f][0] == z).all() and (np.abs(about[f][1] - d) < threshold).all():
                    number[k] = g
                    break
            else:
                number[k] = len(firsts)
                firsts.append(k)
        return N.LABEL[s.z], number, np.arange(len(s.z))

    return N._run(structures, ["element", "group", "site"], "element string, group long, site long", work, [pa.string(), pa.int64(), pa.int64()], r_max)


def equivalent_sites_by_fingerprint(structures: DataFrame, threshold: float = 1e-3, r_max: float = 20.0, delta: float = 0.005, sigma: float = 0.05) -> DataFrame:
    """(seq, element, group, site): as `equivalent_sites`, by the cosine distance of the sites' fingerprints."""
    bins = int(np.ceil(r_max / delta))

    def work(shell: N.Shell):
        if not np.isfinite(shell.volume):
            return [], [], []
        kinds, at, n = np.unique(shell.z, return_inverse=True, return_counts=True)
        use = shell.dist < r_max
        i, j, d = shell.i[use], at[shell.j[use]], shell.dist[use]
        b = np.floor(d / delta).astype(int).clip(max=bins - 1)
        v = np.bincount((i * len(kinds) + j) * bins + b, shell.volume / (4 * np.pi * delta * d**2 * n[j]), len(at) * len(kinds) * bins)
        v = (N.smooth(v.reshape(len(at), len(kinds), bins), sigma) - 1).reshape(len(at), -1)
        v /= np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
        number, groups = np.zeros(len(at), np.int64), {}
        for k in range(len(at)):
            firsts = groups.setdefault(int(at[k]), [])
            near = [g for g, f in enumerate(firsts) if 0.5 * (1 - v[f] @ v[k]) < threshold]
            number[k] = near[0] if near else len(firsts)
            if not near:
                firsts.append(k)
        return list(N.LABEL[shell.z]), number.tolist(), list(range(len(at)))

    return N._run(structures, ["element", "group", "site"], "element string, group long, site long", work, [pa.string(), pa.int64(), pa.int64()], r_max)
