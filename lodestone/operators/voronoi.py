"""Voronoi cells of sites by cutting a box with the planes halfway to each neighbour, nearest first; `voronoi_faces` one cell, `cut_cells` many at once."""

from __future__ import annotations

import numpy as np

FLAT = 1e-7  # square angstrom: faces smaller than that only touch


def _polygon(points: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Points of a convex face in order around it."""
    mid = points.mean(0)
    u = points[0] - mid
    v = np.cross(normal, u)
    return points[np.argsort(np.arctan2((points - mid) @ v, (points - mid) @ u))]


def area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    q = p[1:] - p[0]
    return float(np.linalg.norm(np.cross(q[:-1], q[1:]).sum(0)) / 2)


def solid_angle(p: np.ndarray) -> float:
    """Of a face seen from the origin."""
    if len(p) < 3:
        return 0.0
    r = np.linalg.norm(p, axis=1)
    a, b, c = p[0], p[1:-1], p[2:]
    top = np.abs(np.cross(b, c) @ a)
    below = r[0] * r[1:-1] * r[2:] + (b @ a) * r[2:] + (c @ a) * r[1:-1] + (b * c).sum(1) * r[0]
    return float(2 * np.arctan2(top, below).sum())


def voronoi_faces(steps: np.ndarray, box: float) -> dict[int, np.ndarray]:
    """Faces of the cell about the origin: place of the neighbour in `steps` (sorted by length) to the vertices of the face, in order. Neighbours that
    only touch the cell have none; faces on the box, where neighbours are missing, are left out."""
    half = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * box
    faces: dict[int, np.ndarray] = {}
    for axis in range(3):
        for side in (-1, 1):
            p = np.insert(half, axis, side * box, 1)
            faces[-1 - len(faces)] = p.astype(float)
    reach = box * np.sqrt(3)
    for k, s in enumerate(steps):
        limit = s @ s / 2
        length = np.sqrt(2 * limit)
        if length / 2 > reach:
            break
        cut, kept, changed = [], {}, False
        for f, p in faces.items():
            side = p @ s - limit
            out = side > 1e-9 * max(limit, 1.0)
            if not out.any():
                kept[f] = p
                on = np.abs(side) <= 1e-9 * max(limit, 1.0)
                cut += list(p[on])
                continue
            changed = True
            ring = []
            for a in range(len(p)):
                b = (a + 1) % len(p)
                if not out[a]:
                    ring.append(p[a])
                if out[a] != out[b]:
                    x = p[a] + (p[b] - p[a]) * side[a] / (side[a] - side[b])
                    ring.append(x)
                    cut.append(x)
            if len(ring) >= 3:
                kept[f] = np.array(ring)
        if not changed:
            continue
        faces = kept
        if len(cut) >= 3:
            points = np.array(cut)
            _, one = np.unique(np.round(points, 9), axis=0, return_index=True)
            if len(one) >= 3:
                faces[k] = _polygon(points[np.sort(one)], s / length)
        reach = max((np.sqrt((p**2).sum(1).max()) for p in faces.values()), default=0.0)
    return {k: p for k, p in faces.items() if k >= 0 and area(p) > FLAT}


def cut_cells(step: np.ndarray, first: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, planes, place, next) of all vertices of many cells about the origin. step: neighbours of cell c at first[c]:first[c + 1], nearest first; planes: the three
    planes of a vertex, 0 to 5 for the box and 6 + k for the k-th neighbour; next: the vertex that follows on the face of each of these.

    All cells are cut by their k-th plane at once. Each edge of a cell lies between two planes, so (cell, a, b) and (cell, b, a) name its two ends: `owner` has the vertex of each.
    """
    n, count = len(box), np.diff(first)
    wide = 6 + int(count.max(initial=0))
    side = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)])
    corner = side + [0, 2, 4]
    corner = np.where((side.sum(1) % 2 == 1)[:, None], corner, corner[:, [0, 2, 1]])
    cell, plane = np.repeat(np.arange(n), 8), np.tile(corner, (n, 1))
    place = np.tile(2.0 * side - 1, (n, 1)) * np.repeat(box, 8)[:, None]
    owner = np.zeros(n * wide * wide, np.int32)
    edge = lambda c, a, b: (c[:, None] * wide + a) * wide + b
    after = [1, 2, 0]
    owner[edge(cell, plane, plane[:, after])] = np.arange(len(cell))[:, None]
    live, used = np.arange(len(cell)), len(cell)
    room = 16 * used
    cell, plane, place, alive, height = (np.resize(t, (room, *t.shape[1:])) for t in (cell.astype(np.int32), plane.astype(np.int32), place, np.ones(used, bool), np.zeros(used)))
    beyond = np.zeros(room, bool)
    length = np.sqrt(np.einsum("ij,ij->i", step, step))
    busy = count > 0
    reach = box * np.sqrt(3)
    for k in range(int(count.max(initial=0))):
        busy &= count > k
        at = np.where(busy, first[:-1] + k, 0)
        busy &= length[at] / 2 <= reach
        live = live[busy[cell[live]]]
        if not len(live):
            break
        s, c = step[at], cell[live]
        limit = length[at] ** 2 / 2
        off = np.einsum("ij,ij->i", place[live], s[c]) - limit[c]
        gone = off > 1e-9 * np.maximum(limit, 1.0)[c]
        if not gone.any():
            continue
        height[live] = off
        dead = live[gone]
        beyond[dead] = True
        alive[dead] = False
        a, b = plane[dead], plane[dead][:, after]
        other = owner[edge(cell[dead], b, a)]
        row, way = np.nonzero(~beyond[other])
        other, a, b, dead = other[row, way], a[row, way], b[row, way], dead[row]
        part = height[dead] / (height[dead] - height[other])
        new_place = place[dead] + (place[other] - place[dead]) * part[:, None]
        new_cell, new_plane = cell[dead], np.stack([a, b, np.full(len(a), 6 + k)], 1)
        ids = np.arange(used, used + len(a))
        owner[edge(new_cell, new_plane, new_plane[:, after])] = ids[:, None]
        used += len(a)
        if used > room:
            room = 2 * used
            cell, plane, place, alive, height, beyond = (np.resize(t, (room, *t.shape[1:])) for t in (cell, plane, place, alive, height, beyond))
        cell[ids], plane[ids], place[ids], alive[ids], beyond[ids] = new_cell, new_plane, new_place, True, False
        live = np.concatenate([live[~gone], ids])
        cut = np.zeros(n, bool)
        cut[new_cell] = True
        some = live[cut[cell[live]]]
        far = np.zeros(n)
        np.maximum.at(far, cell[some], np.einsum("ij,ij->i", place[some], place[some]))
        reach = np.where(cut, np.sqrt(far), reach)
    ids = np.flatnonzero(alive[:used])
    short = np.zeros(used, np.int32)
    short[ids] = np.arange(len(ids))
    return cell[ids], plane[ids], place[ids], short[owner[edge(cell[ids], plane[ids], plane[ids][:, [2, 0, 1]])]]


def _measures(step: np.ndarray, first: np.ndarray, box: np.ndarray, solid: bool) -> tuple[np.ndarray, np.ndarray]:
    """(area, solid angle seen from the origin) of the face towards each neighbour, 0 where there is none; solid angles are only taken if asked for."""
    cell, plane, place, follow = cut_cells(step, first, box)
    row, which = np.nonzero(plane >= 6)
    to = first[cell[row]] + plane[row, which] - 6
    p, q = place[row], place[follow[row, which]]
    turn = np.cross(p, q)
    areas = np.sqrt(sum(np.bincount(to, turn[:, i], len(step)) ** 2 for i in range(3))) / 2
    angles = np.zeros(len(step))
    if solid:  # signed triangles with the foot of the plane, halfway to the neighbour
        dot = lambda s, t: np.einsum("ij,ij->i", s, t)
        foot = step[to] / 2
        x, y, z = (np.sqrt(dot(t, t)) for t in (foot, p, q))
        below = x * (y * z + x * (y + z) + dot(p, q))
        angles = np.abs(np.bincount(to, 2 * np.arctan2(dot(turn, foot), below), len(step)))
    return areas, angles


BLOCK = 8_000_000  # entries of cut_cells' table of edges, unless a single cell needs more


def cells_of(shells: list, weight_type: str | None, radii: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weight, whether it is a Voronoi neighbour) of each pair of each `neighbours.Shell`. Types: area, solid_angle, covalent_atomic_radius and vdw_atomic_radius
    (sum of radii less the distance), each also with 'rel_' for a share of the site's largest."""
    kind = (weight_type or "none").removeprefix("rel_")
    table = radii["covalent" if kind.startswith("covalent") else "vdw"]
    if not shells:
        return []
    before = np.concatenate([[0], np.cumsum([len(x.i) for x in shells])])
    first = np.concatenate([[0], *[x.first[1:] + b for x, b in zip(shells, before)]])
    dist, step = np.concatenate([x.dist for x in shells]), np.concatenate([x.step for x in shells])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((dist, owner))
    box = np.ones(len(first) - 1)
    np.maximum.at(box, owner, dist)
    areas, angles, lo = np.zeros(len(dist)), np.zeros(len(dist)), 0
    count = np.diff(first)
    while lo < len(count):
        hi, most = lo, 0
        while hi < len(count) and (hi == lo or (hi - lo + 1) * (max(most, int(count[hi])) + 6) ** 2 <= BLOCK):
            most, hi = max(most, int(count[hi])), hi + 1
        at = order[first[lo] : first[hi]]
        areas[at], angles[at] = _measures(step[at], first[lo : hi + 1] - first[lo], box[lo:hi], kind == "solid_angle")
        lo = hi
    face = areas > FLAT
    out = []
    for x, a, b in zip(shells, before[:-1], before[1:]):
        f, weight = face[a:b], np.zeros(b - a)
        if kind == "area":
            weight = np.where(f, areas[a:b], 0.0)
        elif kind == "solid_angle":
            weight = np.where(f, angles[a:b], 0.0)
        elif kind != "none":
            r = np.array([np.nan, *[np.nan if t is None else t for t in table]])[x.z]
            weight = np.where(f, r[x.i] + r[x.j] - x.dist, 0.0)
        out.append((np.nan_to_num(weight), f))
    return out
