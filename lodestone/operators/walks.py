"""Voronoi neighbours of many crystals at a time, and self-avoiding walks of up to three steps over them.

A cell is final once no vertex is farther from its site than half the radius within which neighbours were searched: a farther neighbour can't cut it. So the search starts
with the radius that holds some sixty neighbours and is widened for the crystals that need it.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np

from lodestone.operators.crystals import Sites
from lodestone.operators.voronoi import FLAT

NEAR = 2.3  # first radius, in edges of the cube that a site has on average
WIDER = 1.4
CELLS = 1_000  # cells that are cut at a time
SEARCHED = 300_000  # distances at a time
FILTER = 16  # planes after which the others are tried at once
TABLE = 1_000_000  # entries of the table of bonds at a time; a crystal that needs more has its bonds sorted instead
STEPS = 50_000  # bonds whose next steps are held at a time


class Bonds(NamedTuple):
    """Faces of Voronoi cells, sorted by i: sites i and j of the batch, the image of j and the face's area."""

    i: np.ndarray
    j: np.ndarray
    image: np.ndarray
    area: np.ndarray


def _expand(count: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, start[owner], start[owner] + 1, ... for count[owner] entries)."""
    owner = np.repeat(np.arange(len(count), dtype=np.int32), count)
    before = np.cumsum(count) - count
    return owner, np.arange(len(owner)) + (start - before)[owner]


def near(s: Sites, cart: np.ndarray, rows: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sites, first, j, image, step): the neighbours of sites[c] are first[c]:first[c + 1], nearest first: all within the radius of each of the crystals `rows`, and some
    beyond it by less than rounding. Crystals with as many sites and images are searched at a time."""
    n = s.n[rows]
    reach = np.ceil(radius[:, None] * np.sqrt((np.linalg.inv(s.cells[rows]) ** 2).sum(1))).astype(int)
    kind, which = np.unique(np.column_stack([n, reach]), axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.argsort(which, kind="stable")
    parts = []
    for (sites, *r), members in zip(kind.tolist(), np.split(order, np.cumsum(np.bincount(which))[:-1])):
        grid = np.stack(np.meshgrid(*[np.arange(-k, k + 1, dtype=np.int32) for k in r], indexing="ij"), -1).reshape(-1, 3)
        home, count = len(grid) // 2, sites * len(grid)
        for lo in range(0, len(members), size := max(1, SEARCHED // (sites * count))):
            m = members[lo : lo + size]
            every = s.off[rows[m]][:, None] + np.arange(sites)
            to = ((grid @ s.cells[rows[m]])[:, :, None] + cart[every][:, None]).reshape(len(m), -1, 3)
            far = np.einsum("mix,mix->mi", to, to)[:, None]
            limit = radius[m] ** 2
            for a in range(0, sites, part := sites if len(m) > 1 else max(1, SEARCHED // count)):
                own = every[:, a : a + part]
                x, at = cart[own], np.arange(own.shape[1])
                square = np.matmul(x * -2.0, to.transpose(0, 2, 1))
                square += np.einsum("mix,mix->mi", x, x)[:, :, None]
                square += far
                ok = square <= (limit * (1 + 1e-6) + 1e-6)[:, None, None]
                ok[:, at, home * sites + a + at] = False
                cell, t = np.divmod(np.flatnonzero(ok), count)
                c = cell // len(at)
                d = to.reshape(-1, 3)[c * count + t] - x.reshape(-1, 3)[cell]
                by = np.argsort(cell * (4 * limit.max() + 4) + np.einsum("ij,ij->i", d, d))
                k, j = np.divmod(t[by], sites)
                parts.append((own.reshape(-1), np.bincount(cell, minlength=own.size), every[c[by], j], grid[k], d[by]))
    sites, count, j, image, d = (np.concatenate(p) for p in zip(*parts))
    return sites, np.append(0, np.cumsum(count)), j, image, d


def _cutting(x: np.ndarray, own: np.ndarray, step: np.ndarray, square: np.ndarray, first: np.ndarray, many: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the planes k to many of each cell cut off any of the vertices x, sorted by cell, and how many of each cell."""
    n = len(many)
    live = np.bincount(own, minlength=n)
    corners = np.zeros((n, int(live.max()), 3))
    corners[own, np.arange(len(own)) - (np.cumsum(live) - live)[own]] = x
    rest = np.maximum(many - k, 0)
    c = np.repeat(np.arange(n), rest)
    col = np.arange(len(c)) - (np.cumsum(rest) - rest)[c]
    at = first[:-1][c] + k + col
    planes = np.zeros((n, int(rest.max(initial=0)), 3))
    planes[c, col] = step[at]
    high = np.matmul(corners, planes.transpose(0, 2, 1)).max(1)[c, col]
    limit = square[at] / 2
    use = high > limit + 0.5e-9 * np.maximum(limit, 1.0)
    return at[use], np.bincount(c[use], minlength=n)


def cut(step: np.ndarray, first: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `voronoi.cut_cells`, which it follows plane by plane, but with half-edges instead of a table of edges: half-edge 3 v + w leaves vertex v between its planes w and w + 1,
    `twin` is the one that comes back. After FILTER planes the others are tried against all vertices at once, and those that cut nothing are left out."""
    n, count = len(box), np.diff(first)
    wide = 6 + int(count.max(initial=0))
    side = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)])
    corner = side + [0, 2, 4]
    corner = np.where((side.sum(1) % 2 == 1)[:, None], corner, corner[:, [0, 2, 1]])
    ends = {(p[w], p[(w + 1) % 3]): 3 * v + w for v, p in enumerate(corner.tolist()) for w in range(3)}
    back = np.array([ends[p[(w + 1) % 3], p[w]] for p in corner.tolist() for w in range(3)])
    used = 8 * n
    room = 6 * used
    place, cell, height, beyond = np.empty((3, room)), np.empty(room, np.int64), np.empty(room), np.zeros(room, bool)
    plane, twin = np.empty(3 * room, np.int64), np.empty(3 * room, np.int64)
    place[:, :used] = np.tile(2.0 * side.T - 1, n) * np.repeat(box, 8)
    cell[:used] = np.repeat(np.arange(n), 8)
    plane[: 3 * used] = np.tile(corner.reshape(-1), n)
    twin[: 3 * used] = (24 * np.arange(n)[:, None] + back).reshape(-1)
    live, own = np.arange(used), cell[:used].copy()
    left, right = np.empty(n * wide, np.int64), np.empty(n * wide, np.int64)
    square = np.einsum("ij,ij->i", step, step)
    owner = np.repeat(np.arange(n), count)
    todo, start, many = np.arange(len(step)), first[:-1].copy(), count.copy()
    reach = 3 * box**2  # squared
    steps = np.ascontiguousarray(step.T)
    k = 0
    while True:
        busy = many > k
        at = todo[np.where(busy, start + k, 0)] if len(todo) else np.zeros(n, np.int64)
        busy &= square[at] / 4 <= reach if len(square) else False
        many[~busy] = 0
        if not busy.any():
            break
        use = busy[own] if not busy.all() else slice(None)
        some, c = live[use], own[use]
        limit = square[at] / 2
        off = limit.take(c)
        np.negative(off, off)
        for x, to in zip(place, steps):
            off += x.take(some) * to.take(at).take(c)
        gone = off > (1e-9 * np.maximum(limit, 1.0))[c]
        k += 1
        if gone.any():
            height[some] = off
            dead = some[gone]
            beyond[dead] = True
            h = (3 * dead[:, None] + np.arange(3)).reshape(-1)
            t = twin[h]
            v = t // 3
            ok = np.flatnonzero(~beyond[v])
            h, t, v, d = h[ok], t[ok], v[ok], dead[ok // 3]
            m = len(h)
            if used + m > room:
                room = 2 * (used + m)
                place = np.concatenate([place, np.empty((3, room - place.shape[1]))], 1)
                cell, height, beyond = (np.resize(x, room) for x in (cell, height, beyond))
                plane, twin = np.resize(plane, 3 * room), np.resize(twin, 3 * room)
                beyond[used:] = False
            a, b, e = plane[h], plane[t], cell[d]
            part = height[d] / (height[d] - height[v])
            ids = np.arange(used, used + m)
            for x in place:
                y = x.take(d)
                x[used : used + m] = y + (x.take(v) - y) * part
            cell[used : used + m] = e
            on_a, on_b = e * wide + a, e * wide + b
            left[on_a] = right[on_b] = twin[t] = 3 * ids
            new = twin[3 * used : 3 * (used + m)].reshape(-1, 3)
            new[:, 0], new[:, 1], new[:, 2] = t, left[on_b] + 2, right[on_a] + 1
            new = plane[3 * used : 3 * (used + m)].reshape(-1, 3)
            new[:, 0], new[:, 1], new[:, 2] = a, b, (6 + at - first[:-1])[e]
            used += m
            keep = ~beyond[live]
            live, own = np.concatenate([live[keep], ids]), np.concatenate([own[keep], e])
        if k % 4 == 0 and k >= FILTER - 4 or k == FILTER:
            reach = np.zeros(n)
            np.maximum.at(reach, own, sum(x.take(live) ** 2 for x in place))
        if k == FILTER:
            order = np.argsort(own, kind="stable")
            many = np.minimum(many, np.bincount(owner, square / 4 <= reach[owner], n).astype(np.int64))
            todo, most = _cutting(place[:, live[order]].T, own[order], step, square, first, many, k)
            start, many = np.cumsum(most) - most - k, np.where(most > 0, most + k, 0)
    ids = np.sort(live)
    short = np.zeros(used, np.int64)
    short[ids] = np.arange(len(ids))
    h = 3 * ids[:, None]
    return cell[ids], plane[(h + np.arange(3))], place[:, ids], short[twin[h + [2, 0, 1]] // 3]


def areas(step: np.ndarray, first: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(area of the face towards each neighbour, distance of each cell's farthest vertex)."""
    out, far = np.zeros(len(step)), np.zeros(len(box))
    for lo in range(0, len(box), CELLS):
        hi = min(lo + CELLS, len(box))
        a, b = first[lo], first[hi]
        cell, plane, place, follow = cut(step[a:b], first[lo : hi + 1] - a, box[lo:hi])
        np.maximum.at(far[lo:hi], cell, (place**2).sum(0))
        at = np.flatnonzero(plane >= 6)
        row = at // 3
        to = first[lo + cell[row]] - a + plane.reshape(-1)[at] - 6
        (x, y, z), (u, v, w) = place[:, row], place[:, follow.reshape(-1)[at]]
        out[a:b] = np.sqrt(sum(np.bincount(to, turn, b - a) ** 2 for turn in (y * w - z * v, z * u - x * w, x * v - y * u))) / 2
    return out, np.sqrt(far)


def voronoi_bonds(s: Sites, rows: np.ndarray, r_max: float) -> tuple[Bonds, np.ndarray]:
    """Faces of the cells of crystals `rows`, and which of these crystals have a cell that neighbours within r_max don't close for certain; those have no faces."""
    frac = s.fractions()
    cart = np.einsum("si,sij->sj", frac - np.floor(frac), np.nan_to_num(s.cells)[s.row])
    volume = np.abs(np.linalg.det(s.cells[rows]))
    radius = np.minimum(NEAR * np.cbrt(volume / s.n[rows]), r_max)
    parts, left, place = [], np.arange(len(rows)), np.zeros(len(s.n), np.int64)
    while len(left):
        own, first, j, image, step = near(s, cart, rows[left], radius[left])
        place[rows[left]] = np.arange(len(left))
        at = place[s.row[own]]
        face, far = areas(step, first, radius[left][at])
        most = np.zeros(len(left))
        np.maximum.at(most, at, far)
        most *= 2 * (1 + 1e-9)
        done = most <= radius[left]
        use = np.flatnonzero((face > FLAT) & np.repeat(done[at], np.diff(first)))
        parts.append((own[np.searchsorted(first, use, "right") - 1], j[use], image[use].astype(np.int64), face[use]))
        go = ~done & (radius[left] < r_max)
        radius[left[go]] = np.minimum(np.minimum(most[go], WIDER * radius[left[go]]), r_max)
        open_ = left[~done & ~go]
        radius[open_] = np.inf
        left = left[go]
    i, j, image, face = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(i, kind="stable")
    return Bonds(i[order], j[order], image[order], face[order]), np.isinf(radius)


def _look(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], 0.0)


def _reverse(s: Sites, rows: np.ndarray, b: Bonds) -> tuple[np.ndarray, np.ndarray]:
    """(area of the face from j back to i, sum over walks of three steps from i over j that end at i) of each bond, without closing walks that use an image twice.

    A table holds the area of each bond c -> a under the image that two steps from a to c add up to, so the sum of their places is the place of the bond that closes the walk.
    """
    row, local, n = s.row, np.arange(len(s.z)) - s.off[s.row], s.n
    most = np.zeros((len(n), 3), np.int64)  # farthest image along each axis
    np.maximum.at(most, row[b.i], np.abs(b.image))
    wide = 4 * most + 1
    size = wide.prod(1)
    need = n * n * size
    line = lambda r, g: (g[:, 0] * wide[r, 1] + g[:, 1]) * wide[r, 2] + g[:, 2]
    first = np.searchsorted(b.i, np.arange(len(s.z) + 1))
    count = np.diff(first)
    back, closed = np.zeros(len(b.i)), np.zeros(len(b.i))
    table = np.zeros(TABLE)
    lo = 0
    while lo < len(rows):
        total = np.cumsum(need[rows[lo:]])
        hi = lo + max(1, int(np.searchsorted(total, TABLE, "right")))
        base = np.zeros(len(n), np.int64)
        base[rows[lo:hi]] = total[: hi - lo] - need[rows[lo:hi]]
        own = slice(first[s.off[rows[lo]]], first[s.off[rows[hi - 1] + 1]])
        i, j, w = b.i[own], b.j[own], b.area[own]
        r = row[i]
        shift = line(r, b.image[own])
        middle = base[r] + line(r, 2 * most[r])
        put = middle + (local[i] * n[r] + local[j]) * size[r] - shift
        head, tail = middle + local[i] * size[r] + shift, local[j] * n[r] * size[r]
        dense = total[hi - lo - 1] <= TABLE
        if dense:
            table[put] = w
            look = table.__getitem__
        else:
            order = np.argsort(put)
            look = partial(_look, put[order], w[order])
        back[own] = look(head + tail)
        tail += shift
        for x in range(0, len(i), STEPS):
            y = min(x + STEPS, len(i))
            e, f = _expand(count[j[x:y]], first[j[x:y]] - own.start)
            closed[own.start + x : own.start + y] = w[x:y] * np.bincount(e, look(head[x + e] + tail[f]) * w[f], y - x)
        if dense:
            table[put] = 0.0
        lo = hi
    return back, closed


def order_parameters(s: Sites, max_shells: int, r_max: float) -> tuple[np.ndarray, np.ndarray]:
    """(site, shell): 1 - p / c as in `neighbours.warren_cowley`, for up to three shells, and which rows are not settled here: molecules and crystals with an open cell.

    A walk of two or three steps is one that may meet itself, less those that do: back to the first site, back to the second, or round a triangle to the first.
    """
    value = np.zeros((len(s.z), max_shells))
    new = np.ones(len(s.z), bool)
    order = np.lexsort((s.z, s.row))
    new[1:] = (s.z[order][1:] != s.z[order][:-1]) | (s.row[order][1:] != s.row[order][:-1])
    number = np.cumsum(new) - 1
    first = np.searchsorted(s.row[order], np.arange(len(s.n)))
    kind = np.zeros(len(s.z), np.int64)
    kind[order] = number - number[np.minimum(first, len(number) - 1)][s.row[order]] if len(number) else 0
    kinds = int(kind.max(initial=0)) + 1
    mixed = np.bincount(s.row, kind, len(s.n)) > 0
    left = (s.n > 0) & mixed
    rows = np.flatnonzero(left & s.crystal)
    if not len(rows):
        return value, left
    b, is_open = voronoi_bonds(s, rows, r_max)
    left[rows[~is_open]] = False
    rows = rows[~is_open]
    i, j, w, n = b.i, b.j, b.area, len(s.z)
    to = lambda v: np.bincount(i, v, n)
    every, own = kind[i], kind[i] == kind[j]
    step = np.bincount(i * kinds + kind[j], w, n * kinds).reshape(n, kinds)
    found = [(step.sum(1), step[np.arange(n), kind])]
    if max_shells > 1:
        back, closed = _reverse(s, rows, b)
        two = np.stack([to(w * (step[j, k] - np.where(every == k, back, 0.0))) for k in range(kinds)], 1)
        found.append((two.sum(1), two[np.arange(n), kind]))
    if max_shells > 2:
        all_, mine = to(w * two.sum(1)[j]), to(w * two[j, every])
        again = w * back
        all_ -= to(again * (step.sum(1)[i] - w) + closed)
        mine -= to(again * (step[i, every] - np.where(own, w, 0.0)) + closed)
        found.append((all_, mine))
    share = np.bincount(s.row * kinds + kind, minlength=len(s.n) * kinds)[s.row * kinds + kind] / s.n[s.row]
    settled = np.zeros(len(s.n), bool)
    settled[rows] = True
    settled = settled[s.row]
    for k, (total, mine) in enumerate(found[:max_shells]):
        value[settled, k] = (1 - mine / np.where(total > 0, total, np.nan) / share)[settled]
    return value, left
