"""Numeric kernels on sites: reading Arrow batches of structures, cell parameters, and the coincidence of site sets.

All functions work on whole batches; offsets of the Arrow lists stand in for per-row loops.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chemical symbols in order of atomic number, from hydrogen.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag "
    "Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa "
    "U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER = {s: i + 1 for i, s in enumerate(SYMBOLS)} | {"D": 1, "T": 1}

#: Positions of a crystal count as fractions of the cell if no coordinate is larger than this. Fractions may be written up to a
#: whole cell outside; in angstrom, sites that fill a cell of at least 3 angstrom with distances over 1 angstrom reach farther.
FRACTION_LIMIT = 2.0


def atomic_number(symbol: str | None) -> int:
    """'Te', ' te', 'TE', 'Te3', 'Te2-' are 52; 0 for what is no element."""
    m = re.match(r"\s*([A-Za-z]{1,3})[0-9]*[+-]?[0-9]*\s*$", symbol or "")
    return NUMBER.get(m[1].capitalize(), 0) if m else 0


class Sites:
    """Sites of a batch of structures: row i has the sites off[i]:off[i+1]; rows that can't be read have no sites.

    z: atomic numbers; xyz: coordinates as written; cells: (rows, 3, 3), NaN without a cell.
    """

    def __init__(self, elements: pa.Array, positions: pa.Array, cell: pa.Array | None):
        m = len(elements)
        n_el = np.asarray(pc.fill_null(pc.list_value_length(elements), 0), np.int64)
        n_pos = np.asarray(pc.fill_null(pc.list_value_length(positions), 0), np.int64)
        flat_el, flat_pos = pc.list_flatten(elements), pc.list_flatten(positions)
        ok = (n_el == n_pos) & (n_el > 0)
        codes = flat_el.dictionary_encode() if not pa.types.is_dictionary(flat_el.type) else flat_el
        lookup = np.array([atomic_number(s) for s in codes.dictionary.to_pylist()] + [0], np.int16)
        z = lookup[np.asarray(pc.fill_null(codes.indices, len(lookup) - 1), np.int64)]
        triple = np.asarray(pc.fill_null(pc.list_value_length(flat_pos), 0), np.int64)
        values = pc.list_flatten(flat_pos)
        values = np.asarray(pc.fill_null(values, float("nan")), np.float64) if values.null_count else np.asarray(values, np.float64)
        row_of = np.repeat(np.arange(m), n_pos)
        if len(triple) and (triple != 3).any():
            bad = np.bincount(row_of, triple != 3, m) > 0
            ok &= ~bad
            start = np.concatenate([[0], np.cumsum(triple)])[:-1]
            good = triple == 3
            xyz = np.full((len(triple), 3), np.nan)
            xyz[good] = values[start[good][:, None] + np.arange(3)]
        else:
            xyz = values.reshape(-1, 3)
        if len(row_of):
            ok &= ~(np.bincount(row_of, ~np.isfinite(xyz).all(1), m) > 0)
        el_row = np.repeat(np.arange(m), n_el)
        z, xyz = z[ok[el_row]], xyz[ok[row_of]]
        self.n = np.where(ok, n_el, 0)
        self.off = np.concatenate([[0], np.cumsum(self.n)])
        self.z, self.xyz, self.row = z, xyz, np.repeat(np.arange(m), self.n)
        self.ok = ok
        self.cells = np.full((m, 3, 3), np.nan)
        if cell is not None and m:
            n_rows = np.asarray(pc.fill_null(pc.list_value_length(cell), 0), np.int64)
            flat = pc.list_flatten(cell)
            width = np.asarray(pc.fill_null(pc.list_value_length(flat), 0), np.int64)
            owner = np.repeat(np.arange(m), n_rows)
            fine = (n_rows == 3) & ~(np.bincount(owner, width != 3, m) > 0 if len(owner) else np.zeros(m, bool))
            numbers = np.asarray(pc.fill_null(pc.list_flatten(flat), float("nan")), np.float64)
            keep = np.repeat(fine[owner], width) if len(owner) else np.zeros(0, bool)
            self.cells[fine] = numbers[keep].reshape(-1, 3, 3)
            det = np.abs(np.linalg.det(np.nan_to_num(self.cells)))
            self.cells[~(det > 1e-6)] = np.nan
        self.crystal = np.isfinite(self.cells).all((1, 2))

    def reach(self) -> np.ndarray:
        """The largest coordinate of each row, as written."""
        out = np.zeros(len(self.n))
        np.maximum.at(out, self.row, np.abs(self.xyz).max(1) if len(self.xyz) else np.zeros(0))
        return out

    def fractional(self) -> np.ndarray:
        """Which rows give fractions of the cell, from the numbers alone: the flag of a record isn't trusted."""
        return self.crystal & self.ok & (self.reach() <= FRACTION_LIMIT)

    def fractions(self) -> np.ndarray:
        """Fractions of the cell for crystals, angstrom for molecules."""
        to = np.tile(np.eye(3), (len(self.n), 1, 1))
        change = self.crystal & ~self.fractional()
        if change.any():
            to[change] = np.linalg.inv(self.cells[change])
        return np.einsum("si,sij->sj", self.xyz, to[self.row])

    def parameters(self) -> np.ndarray:
        """(rows, 6): a, b, c in angstrom and alpha, beta, gamma in degrees; NaN without a cell."""
        v = self.cells
        length = np.sqrt((v**2).sum(2))
        with np.errstate(invalid="ignore", divide="ignore"):
            cos = np.stack([(v[:, (i + 1) % 3] * v[:, (i + 2) % 3]).sum(1) / (length[:, (i + 1) % 3] * length[:, (i + 2) % 3]) for i in range(3)], 1)
            return np.concatenate([length, np.degrees(np.arccos(np.clip(cos, -1, 1)))], 1)


def metric(par: np.ndarray) -> np.ndarray:
    """Metric tensors (rows, 3, 3) from (rows, 6) cell parameters."""
    a, ang = par[:, :3], np.cos(np.radians(par[:, 3:]))
    g = a[:, :, None] * a[:, None, :]
    for i, j, k in ((1, 2, 0), (0, 2, 1), (0, 1, 2)):
        g[:, i, j] *= ang[:, k]
        g[:, j, i] *= ang[:, k]
    return g


def cells_agree(p: np.ndarray, q: np.ndarray, length_tol: float, angle_tol: float) -> np.ndarray:
    """(pairs, 3): whether the parameters p and q agree when the axes of q are renamed in turn 0, 1 or 2 times."""
    out = []
    for r in range(3):
        q2 = np.concatenate([np.roll(q[:, :3], -r, 1), np.roll(q[:, 3:], -r, 1)], 1)
        near = np.abs(p[:, :3] - q2[:, :3]) <= length_tol * np.maximum(p[:, :3], q2[:, :3]) + 1e-9
        out.append(near.all(1) & (np.abs(p[:, 3:] - q2[:, 3:]) <= angle_tol + 1e-6).all(1))
    return np.stack(out, 1)


class SiteTable:
    """Padded site arrays for pair work: z (rows, width) and x (rows, width, 3); unused places have z = 0 on the side that searches."""

    def __init__(self, n: np.ndarray, z: list[np.ndarray] | np.ndarray, x: np.ndarray):
        width = int(n.max()) if len(n) else 0
        place = np.arange(width)[None] < n[:, None]
        self.n, self.z, self.x = n, np.zeros((len(n), width), np.int16), np.zeros((len(n), width, 3), np.float32)
        self.z[place], self.x[place] = z, x


def coincide(a: SiteTable, b: SiteTable, ia: np.ndarray, ib: np.ndarray, turn: np.ndarray, g: np.ndarray, need: np.ndarray, tol: float, chunk: int = 1 << 21) -> np.ndarray:
    """For each pair (ia[k], ib[k]): do at least need[k] sites of a coincide with sites of the same element of b within tol, for some origin?

    x are fractions of the cell; turn: how often the axes of b are renamed; g: the metric tensor of a. Origins are tried that lay
    one of n - need + 1 sites of a, rarest elements first, on each like site of b: one of them must be among the coinciding ones.
    An origin that brings need sites to within 2 tol is then decided exactly, to within SLACK: see `_origin_exists`.
    """
    good = np.zeros(len(ia), bool)
    if not len(ia):
        return good
    # rarity of each site of a: how many like sites b has
    order = np.argsort(a.n[ia], kind="stable")
    lo = 0
    while lo < len(order):
        wa = int(a.n[ia[order[min(lo + 4096, len(order)) - 1]]])
        sel = order[lo : lo + 4096]
        lo += len(sel)
        A, B = ia[sel], ib[sel]
        wb = int(b.n[B].max())
        za, zb = a.z[A, :wa], b.z[B, :wb]
        used = np.arange(wb)[None] < b.n[B][:, None]
        like = (za[:, :, None] == zb[:, None, :]) & (za > 0)[:, :, None] & used[:, None, :]
        rare = like.sum(2)
        possible = (rare > 0).sum(1) >= need[sel]
        mine = np.arange(wa)[None] < a.n[A][:, None]
        rank = np.argsort(np.where(mine, np.where(rare > 0, rare, 0), 10_000), 1, kind="stable")
        tries = (a.n[A] - need[sel] + 1).clip(1)
        xb = b.x[B, :wb]
        xb = np.where((turn[sel] == 1)[:, None, None], np.roll(xb, -1, 2), np.where((turn[sel] == 2)[:, None, None], np.roll(xb, -2, 2), xb))
        xa = a.x[A, :wa]
        for t in range(int(tries.max())):
            todo = np.flatnonzero(possible & (tries > t) & ~good[sel])
            if not len(todo):
                continue
            site = rank[todo, t]
            hyp, to = np.nonzero(like[todo, site])
            h, s = todo[hyp], site[hyp]
            shift = xb[h, to] - xa[h, s]
            step = max(1, chunk // (wa * wb))
            for k in range(0, len(h), step):
                q = slice(k, k + step)
                live = h[q]
                enough = _touched(xa[live], xb[live], shift[q], g[sel[live]], like[live], (2 * tol) ** 2) >= need[sel[live]]
                if not enough.any():
                    continue
                live, sh = live[enough], shift[q][enough]
                for at in range(0, len(live), 256):
                    o = slice(at, at + 256)
                    good[sel[live[o]]] |= _origin_exists(xa[live[o]], xb[live[o]], sh[o], g[sel[live[o]]], like[live[o]], need[sel[live[o]]], tol)
    return good


def _touched(xa: np.ndarray, xb: np.ndarray, shift: np.ndarray, g: np.ndarray, like: np.ndarray, r2: float) -> np.ndarray:
    """How many sites of a have a like site of b within r, after the shift."""
    h, i, j = np.nonzero(like)
    d = xb[h, j] - xa[h, i] - shift[h]
    d -= np.rint(d)
    near = _quadratic(d, g.astype(np.float32), h) <= r2
    key = h[near] * xa.shape[1] + i[near]
    return np.bincount(np.unique(key) // xa.shape[1], minlength=len(xa))


def _quadratic(d: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """d' g d for each row, with the metric tensor of its pair."""
    x, y, z = d.T
    g = g.reshape(len(g), 9)
    return x * x * g[h, 0] + y * y * g[h, 4] + z * z * g[h, 8] + 2 * (x * y * g[h, 1] + x * z * g[h, 2] + y * z * g[h, 5])


#: Angstrom by which a site may miss the tolerance, so that ties and rounding don't decide.
SLACK = 1e-4


class _Steps:
    """For each trial origin, the steps (in angstrom) that would lay a site of a on a like site of b: those within reach, padded with far ones."""

    def __init__(self, xa: np.ndarray, xb: np.ndarray, shift: np.ndarray, g: np.ndarray, like: np.ndarray, reach: float):
        h, i, j = np.nonzero(like)
        d = (xb[h, j] - xa[h, i] - shift[h]).astype(float)
        d -= np.rint(d)
        near = _quadratic(d, g, h) <= reach**2
        h, i, j = h[near], i[near], j[near]
        v = np.einsum("si,sij->sj", d[near], np.linalg.cholesky(g)[h])
        per = np.bincount(h, minlength=len(xa))
        k = np.arange(len(h)) - np.repeat(np.cumsum(per) - per, per)
        width = int(per.max(initial=1))
        self.at = np.full((len(xa), width, 3), 1e3)
        self.i, self.j = np.full((len(xa), width), -1), np.full((len(xa), width), -1)
        self.at[h, k], self.i[h, k], self.j[h, k] = v, i, j
        repeats = lambda x: len(np.unique(h * 1_000_000 + x)) < len(h)
        self.single = not (repeats(i) or repeats(j))

    def count(self, h: np.ndarray, origin: np.ndarray, r: float) -> np.ndarray:
        """How many sites coincide to within r if the origin of h moves there: sites of a and of b count once."""
        hit = ((self.at[h] - origin[:, None]) ** 2).sum(2) <= r * r
        if self.single:
            return hit.sum(1)
        row, k = np.nonzero(hit)
        once = lambda x: np.bincount(np.unique(row * 1_000_000 + x[h[row], k]) // 1_000_000, minlength=len(h))
        return np.minimum(once(self.i), once(self.j))


def _origin_exists(xa: np.ndarray, xb: np.ndarray, shift: np.ndarray, g: np.ndarray, like: np.ndarray, need: np.ndarray, tol: float) -> np.ndarray:
    """Whether some origin near each shift brings at least `need` sites to within tol.

    Such an origin lies in the balls of radius tol about `need` of the steps. The middle of the steps is tried first; what that leaves open is decided by
    halving cubes: a cube is given up when too few balls reach it, and settles the question when its middle lies in enough of them.
    """
    s = _Steps(xa, xb, shift, g, like, 2 * tol + SLACK)
    done, every = np.zeros(len(xa), bool), np.arange(len(xa))
    middle = np.zeros((len(xa), 3))
    for r in (2 * tol, 1.5 * tol, 1.5 * tol):
        hit = (((s.at - middle[:, None]) ** 2).sum(2) <= (r + SLACK) ** 2)[..., None]
        middle = np.where(hit, s.at, 0).sum(1) / np.maximum(hit.sum(1), 1)
        done |= s.count(every, middle, tol + SLACK) >= need
    h = np.flatnonzero(~done)
    origin, half = np.zeros((len(h), 3)), tol
    corner = np.array(np.meshgrid([-0.5, 0.5], [-0.5, 0.5], [-0.5, 0.5])).reshape(3, 8).T
    while len(h):
        wide = half * np.sqrt(3)
        open_ = s.count(h, origin, tol + wide) >= need[h]
        h, origin = h[open_], origin[open_]
        done[h[s.count(h, origin, tol + SLACK) >= need[h]]] = True
        if wide <= SLACK:
            break
        left = ~done[h]
        h, origin = np.repeat(h[left], 8), (origin[left][:, None] + corner * half).reshape(-1, 3)
        half /= 2
    return done


def rigid_match(za: np.ndarray, xa: np.ndarray, zb: np.ndarray, xb: np.ndarray, need: int, tol: float) -> bool:
    """Do at least `need` sites of a coincide with sites of the same element of b within tol, after some rotation and shift?

    Triples of sites of a are laid on triples of b with like elements and distances; whichever sites are missing, one triple has none of them
    (`covering_triples`). A triple fixes the rotation only as well as it is wide, so each is as wide as its sites allow. What it brings near is then decided by
    the smallest largest distance that any rotation and shift leaves (`_within`).
    """
    like = za[:, None] == zb[None]
    usable = np.flatnonzero(like.any(1))
    if len(usable) < need:
        return False
    da, db = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) for x in (xa, xb))
    for tri in covering_triples(da, usable.tolist(), len(usable) - need):
        cand = np.flatnonzero(like[tri[0]])[:, None]
        for q in range(1, len(tri)):
            near = like[tri[q]][None] & np.logical_and.reduce([np.abs(db[cand[:, w]] - da[tri[q], tri[w]]) <= 2 * tol + 1e-3 for w in range(q)])
            near[np.arange(len(cand))[:, None], cand] = False
            at, b = np.nonzero(near)
            cand = np.column_stack([cand[at], b])
        if any(_lies_on(xa, xb, like, tri, list(c), need, tol) for c in cand):
            return True
    return False


def covering_triples(d: np.ndarray, usable: list[int], miss: int):
    """Triples of the usable sites of which one is whole whichever `miss` sites are missing; d: distances between sites.

    Few missing sites: the widest triple, then the widest ones without one of its sites, and so on. Many: disjoint triples.
    """
    seen: set[tuple[int, ...]] = set()
    if miss > 2 and len(usable) >= 3 * (miss + 1):
        left = list(usable)
        for _ in range(miss + 1):
            t = widest(d, left)
            left = [s for s in left if s not in t]
            yield t
        return
    level: set[frozenset[int]] = {frozenset()}
    for _ in range(miss + 1):
        after = set()
        for gone in sorted(level, key=sorted):
            t = widest(d, [s for s in usable if s not in gone])
            after |= {gone | {s} for s in t}
            if t and tuple(t) not in seen:
                seen.add(tuple(t))
                yield t
        level = after


def widest(d: np.ndarray, left: list[int]) -> list[int]:
    """The two sites farthest apart and the one farthest from their line; fewer if there are fewer. d: distances."""
    if len(left) < 2:
        return list(left)
    at = np.array(left)
    sub = d[np.ix_(at, at)]
    p, q = divmod(int(sub.argmax()), len(at))
    if p == q:
        p, q = 0, 1
    if len(left) == 2:
        return [left[p], left[q]]
    base = max(sub[p, q], 1e-12)
    along = (base**2 + sub[p] ** 2 - sub[q] ** 2) / (2 * base)
    off = sub[p] ** 2 - along**2
    off[[p, q]] = -1.0
    return [left[p], left[q], left[int(off.argmax())]]


def _lies_on(xa: np.ndarray, xb: np.ndarray, like: np.ndarray, tri: list[int], on: list[int], need: int, tol: float) -> bool:
    """Does a rotation and shift near the one that lays the triple `tri` of a on `on` bring enough sites together?"""
    every = np.arange(len(xa))
    rot, off = fit_rigid(xa[tri], xb[on])
    pairs = None
    for radius in (8 * tol, 4 * tol, 3 * tol):
        d = np.where(like, np.sqrt((((xa @ rot + off)[:, None] - xb[None]) ** 2).sum(2)), 1e9)
        at = d.argmin(1)
        near, mutual = d[every, at], d.argmin(0)[at] == every
        if ((near <= tol + SLACK) & mutual).sum() >= need:
            return True
        hit = (near <= radius) & mutual
        if hit.sum() >= need:
            pairs = every[hit], at[hit]
        elif pairs is None:
            return False
        rot, off = fit_rigid(xa[pairs[0]], xb[pairs[1]])
    return _within(xa[pairs[0]], xb[pairs[1]], len(pairs[0]) - need, tol + SLACK)


def _within(a: np.ndarray, b: np.ndarray, drop: int, tol: float, rounds: int = 200) -> bool:
    """Is there a rotation and shift that brings all sites but `drop` to within tol of their partners?

    Weighted fits whose weights follow the distances they leave close in on the smallest largest distance: its value lies between the weighted mean
    square of a fit (below) and the largest distance (above). If all sites can't come that near, at least one of the sites that show it must be dropped.
    """
    n = len(a)
    w = np.full(n, 1.0 / n)
    for _ in range(rounds):
        rot, off = fit_rigid(a, b, w)
        r = np.sqrt((((a @ rot + off) - b) ** 2).sum(1))
        if (r <= tol).sum() >= n - drop:
            return True
        if (w * r * r).sum() > tol * tol:
            break
        w = w * r / (w * r).sum()
    if not drop or n < 2:
        return False
    order = np.argsort(-w)
    for k in range(2, n + 1):
        few = order[:k]
        share = w[few] / w[few].sum()
        rot, off = fit_rigid(a[few], b[few], share)
        if (share * (((a[few] @ rot + off) - b[few]) ** 2).sum(1)).sum() > tol * tol:
            order = few
            break
    return any(_within(np.delete(a, p, 0), np.delete(b, p, 0), drop - 1, tol, rounds) for p in order)


def fit_rigid(a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Proper rotation and shift with the least weighted squares between a and b."""
    w = np.full(len(a), 1.0 / len(a)) if w is None else w
    ca, cb = w @ a, w @ b
    u, _, vt = np.linalg.svd((a - ca).T @ ((b - cb) * w[:, None]))
    d = np.sign(np.linalg.det(u @ vt))
    rot = u @ np.diag([1, 1, d if d else 1]) @ vt
    return rot, cb - ca @ rot
