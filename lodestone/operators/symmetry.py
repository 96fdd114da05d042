"""Point groups of molecules: all rotations and reflections that bring a molecule onto itself, and the group they form.

Two sites that don't lie on a line with the centre fix a rotation: they are laid on every pair of like sites at like distances, with and without a reflection
in their plane. What brings every site to within the tolerance of a like one is kept after a fit to all sites. Few pairs are tried, those of the rarest kind of site.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.elements import MASSES
from lodestone.operators.crystals import Sites


def centred(z: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions about the centre of mass."""
    m = np.array([MASSES[k - 1] if k else 1.0 for k in z])
    return x - (m[:, None] * x).sum(0) / m.sum()


def equivalent_atoms(z: np.ndarray, x: np.ndarray, tol: float) -> np.ndarray:
    """Class of each site: sites of one element whose sorted distances to all sites agree."""
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)
    label = np.full(len(z), -1)
    for i in range(len(z)):
        same = [j for j in range(i) if z[j] == z[i] and np.abs(d[i] - d[j]).max() <= tol]
        label[i] = label[same[0]] if same else label.max(initial=-1) + 1
    return label


def inertia(z: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Principal moments and axes (as rows)."""
    m = np.array([MASSES[k - 1] if k else 1.0 for k in z])
    c = centred(z, x)
    t = (m[:, None, None] * ((c**2).sum(1)[:, None, None] * np.eye(3) - c[:, :, None] * c[:, None, :])).sum(0)
    v, e = np.linalg.eigh(t)
    return v, e.T


def _frame(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    u = a / np.linalg.norm(a)
    w = np.cross(a, b)
    w /= np.linalg.norm(w)
    return np.stack([u, np.cross(w, u), w])


def _maps(op: np.ndarray, z: np.ndarray, x: np.ndarray, tol: float) -> np.ndarray | None:
    """Which site each site falls on, or None if one falls on none."""
    d = np.sqrt((((x @ op.T)[:, None] - x[None]) ** 2).sum(2)) + np.where(z[:, None] == z[None], 0.0, 1e9)
    to = d.argmin(1)
    return to if d[np.arange(len(z)), to].max() <= tol and len(set(to.tolist())) == len(z) else None


def operations(z: np.ndarray, x: np.ndarray, tol: float = 0.1) -> list[np.ndarray] | None:
    """Matrices of all operations about the centre; None for molecules whose sites lie on a line (and single atoms)."""
    x = centred(z, x)
    r = np.linalg.norm(x, axis=1)
    off = np.flatnonzero(r > tol)
    if not len(off) or np.linalg.svd(x[off])[1][1:].max(initial=0.0) <= tol:
        return None
    label = equivalent_atoms(z, x, 2 * tol)
    size = np.bincount(label)[label]
    a = min(off, key=lambda k: (size[k], -r[k]))
    sine = np.linalg.norm(np.cross(x[a], x), axis=1) / r[a]
    b = min((k for k in off if sine[k] > max(tol, 0.3 * sine.max())), key=lambda k: (size[k], -sine[k]))
    base, mirror = _frame(x[a], x[b]), np.diag([1.0, 1.0, -1.0])
    out: list[np.ndarray] = []
    d = np.linalg.norm(x[a] - x[b])
    for p in np.flatnonzero((label == label[a]) & (np.abs(r - r[a]) <= 2 * tol)):
        for q in np.flatnonzero((label == label[b]) & (np.abs(r - r[b]) <= 2 * tol) & (np.abs(np.linalg.norm(x - x[p], axis=1) - d) <= 2 * tol)):
            if q == p or np.linalg.norm(np.cross(x[p], x[q])) < 1e-6:
                continue
            for flip in (np.eye(3), mirror):
                op = _frame(x[p], x[q]).T @ flip @ base
                to = _maps(op, z, x, 3 * tol)
                if to is None:
                    continue
                u, _, vt = np.linalg.svd(x[to].T @ x)  # the nearest orthogonal matrix to what brings sites onto their partners
                sign = np.sign(np.linalg.det(op))
                fit = u @ np.diag([1.0, 1.0, sign * np.sign(np.linalg.det(u @ vt))]) @ vt
                if _maps(fit, z, x, tol) is not None and not any(np.abs(fit - o).max() < 0.1 for o in out):
                    out.append(fit)
    return out


def _order(rotation: np.ndarray) -> int:
    """n of a rotation by a multiple of 360 / n degrees."""
    angle = np.arccos(np.clip((np.trace(rotation) - 1) / 2, -1, 1))
    return next((n for n in range(1, 25) if abs(angle * n / (2 * np.pi) - round(angle * n / (2 * np.pi))) < 0.02 * n), 1) if angle > 0.05 else 1


def _axis(rotation: np.ndarray) -> np.ndarray:
    v, e = np.linalg.eig(rotation)
    return np.real(e[:, np.argmin(np.abs(v - 1))])


def group_name(ops: list[np.ndarray]) -> str:
    """Schoenflies symbol of a finite group of matrices."""
    turns = [(o, _order(o)) for o in ops if np.linalg.det(o) > 0]
    improper = [o for o in ops if np.linalg.det(o) < 0]
    inverted = any(np.abs(o + np.eye(3)).max() < 0.2 for o in improper)
    mirrors = [_axis(-o) for o in improper if np.trace(o) > 0.8]
    top = max(n for _, n in turns)
    if len(turns) >= 12 and sum(n == 3 for _, n in turns) >= 8:
        if len(turns) >= 60:
            return "Ih" if improper else "I"
        if len(turns) >= 24:
            return "Oh" if improper else "O"
        return "Th" if inverted else "Td" if improper else "T"
    if top == 1:
        return "Cs" if mirrors else "Ci" if inverted else "C1"
    cyclic = len(turns) == top
    main = next(_axis(o) for o, n in turns if n == top)
    if not cyclic and top == 2:  # three axes of order two: the one that tells Dnh from Dnd is the one of the improper operations
        main = next((_axis(-o) for o in improper if abs(np.trace(o) + 1) < 0.2), main)
    horizontal = any(abs(m @ main) > 0.95 for m in mirrors)
    if cyclic:
        if horizontal:
            return f"C{top}h"
        if mirrors:
            return f"C{top}v"
        return f"S{2 * top}" if improper else f"C{top}"
    if horizontal or (top == 2 and len(mirrors) == 3):
        return f"D{top}h"
    return f"D{top}d" if improper else f"D{top}"


def point_group(z: np.ndarray, x: np.ndarray, tol: float = 0.1) -> tuple[str, int]:
    """(symbol, number of operations); linear molecules have no finite number: 0."""
    ops = operations(z, x, tol)
    if ops is None:
        if len(z) == 1:
            return "Kh", 0
        return ("Dinfh" if _maps(-np.eye(3), z, centred(z, x), tol) is not None else "Cinfv"), 0
    return group_name(ops or [np.eye(3)]), len(ops or [0])


def point_groups(structures: DataFrame, tol: float = 0.1) -> DataFrame:
    """(seq, point_group, operations) of molecules; crystals and rows that can't be read have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, ids, out = Sites(b.column(1), b.column(2), b.column(3)), b.column(0).to_pylist(), []
            for r in np.flatnonzero((s.n > 0) & ~s.crystal):
                out.append((ids[r], *point_group(s.z[s.off[r] : s.off[r + 1]], s.xyz[s.off[r] : s.off[r + 1]], tol)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32())], names=["seq", "point_group", "operations"])

    d = structures.select(F.col("seq").cast("long").alias("seq"), "elements", "positions", "cell").where("seq is not null and elements is not null and positions is not null")
    return d.mapInArrow(run, "seq long, point_group string, operations int")
