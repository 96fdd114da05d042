"""Distances, angles and dihedral angles between numbered sites, with periodic boundaries. One Arrow kernel over whole batches; no shuffle."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.crystals import Sites

Index = int | Sequence[int] | None


def site_tuples(indices: Sequence[Index]) -> list[tuple[int, ...]]:
    """All choices of one site from each list, without repeats; of a tuple and its reverse only the first. None stands for all sites named elsewhere."""
    named = [[i] if isinstance(i, int) else None if i is None else list(i) for i in indices]
    every = sorted({k for part in named if part for k in part})
    out: dict[tuple[int, ...], None] = {}
    for t in itertools.product(*[every if part is None else part for part in named]):
        if len(set(t)) == len(t) and t[::-1] not in out:
            out[t] = None
    return list(out)


def _measure(tuples: list[tuple[int, ...]], fold: bool, apart: float):
    at = np.array(tuples, np.int64).reshape(len(tuples), -1)
    width = at.shape[1]
    names = ["seq", *[f"site_{k + 1}" for k in range(width)], "value"]
    image = np.array(list(itertools.product((0, -1, 1), repeat=3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Sites(b.column(1), b.column(2), b.column(3))
            ids, frac = np.asarray(b.column(0), np.int64), s.fractions()
            enough = np.flatnonzero(s.n > at.max(initial=-1))
            place = s.off[enough][:, None, None] + at[None]
            x = frac[place]  # rows, tuples, sites, 3
            crystal = s.crystal[enough]
            cell = np.where(crystal[:, None, None], np.nan_to_num(s.cells[enough]), np.eye(3))
            if fold:
                x = np.where(crystal[:, None, None, None], x - np.floor(x), x)
            x = np.einsum("rtki,rij->rtkj", x, cell)
            if fold:  # the image of every other site that is nearest to the first one
                shift = np.einsum("mi,rij->rmj", image, cell) * crystal[:, None, None]
                d = ((x[:, :, 1:, None] + shift[:, None, None] - x[:, :, :1, None]) ** 2).sum(-1)
                best = d.argmin(-1)
                if apart:
                    two = np.sqrt(np.partition(d, 1, -1)[..., :2])
                    clear = ((two[..., 1] - two[..., 0] >= apart) | ~crystal[:, None, None]).all(-1)
                x[:, :, 1:] += np.take_along_axis(shift[:, None, None].repeat(x.shape[1], 1).repeat(width - 1, 2), best[..., None, None], 3)[..., 0, :]
            if width == 2:
                v = np.linalg.norm(x[:, :, 1] - x[:, :, 0], axis=-1)
            elif width == 3:
                v = _angle(x[:, :, 1] - x[:, :, 0], x[:, :, 2] - x[:, :, 0])
            else:
                a, c, e = x[:, :, 1] - x[:, :, 0], x[:, :, 2] - x[:, :, 1], x[:, :, 3] - x[:, :, 2]
                v = _angle(np.cross(a, c), np.cross(c, e))
            n, t = v.shape
            cols = [np.repeat(ids[enough], t), *[np.tile(at[:, k], n) for k in range(width)], v.reshape(-1)]
            if fold and apart:
                cols = [c[clear.reshape(-1)] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return run


def _angle(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(u, axis=-1) * np.linalg.norm(v, axis=-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.degrees(np.arccos(np.clip((u * v).sum(-1) / length, -1, 1)))


def _run(structures: DataFrame, indices: Sequence[Index], fold: bool, name: str, apart: float = 0.0) -> DataFrame:
    tuples = site_tuples(indices)
    d = structures.select(F.col("seq").cast("long").alias("seq"), "elements", "positions", "cell").where("seq is not null and elements is not null and positions is not null")
    sites = ", ".join(f"site_{k + 1} long" for k in range(len(indices)))
    out = d.mapInArrow(_measure(tuples, fold, apart), f"seq long, {sites}, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value"))).withColumnRenamed("value", name)


def site_distances(structures: DataFrame, site_1: Index = 0, site_2: Index = 1, fold: bool = True) -> DataFrame:
    """(seq, site_1, site_2, distance): shortest distance over the images of the second site in the 27 cells about the first; without `fold` as written.

    Structures with too few sites, and those that can't be read, have no rows; molecules aren't folded.
    """
    return _run(structures, [site_1, site_2], fold, "distance")


def site_angles(structures: DataFrame, site_1: Index = 0, site_2: Index = 1, site_3: Index = 2, fold: bool = True, apart: float = 0.0) -> DataFrame:
    """(seq, site_1, site_2, site_3, angle): angle in degrees at site_1 between the nearest images of the others; null where two sites coincide.

    With `apart`, folded angles for which the second nearest image of one of the others is less than that farther than its nearest, so that either could be meant, have no row.
    """
    return _run(structures, [site_1, site_2, site_3], fold, "angle", apart)


def site_dihedrals(structures: DataFrame, site_1: Index = 0, site_2: Index = 1, site_3: Index = 2, site_4: Index = 3, fold: bool = True) -> DataFrame:
    """(seq, site_1 … site_4, dihedral): unsigned angle in degrees between the planes of the first and last three sites; null if three lie on a line."""
    return _run(structures, [site_1, site_2, site_3, site_4], fold, "dihedral")
