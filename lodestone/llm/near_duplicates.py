"""Groups of structures that are the same crystal or molecule up to small edits.

Every structure gets a binary fingerprint in which near-duplicates differ by few bits by construction:

* composition word (64 bits): one hashed bit for each atom "element, k-th of its kind"; two structures that share all but d
  atoms differ in at most d bits;
* cell word (60 bits): each of the three sorted logarithmic cell lengths as a cyclic unary code (a Gray code: neighbouring
  levels differ in one bit), so a length that differs by 2 % changes at most 6 bits.

The index is hierarchical. Its top is a node of coarse bins (sorted lengths, sorted angles, number of sites); a record lives in
one node and visits the later nodes that its tolerances reach, so that each pair meets exactly once. Nodes are the shuffle key.
Within a node the records are sorted by the Gray rank of their words; equal composition words, then equal masked cell words, are
factored into upper nodes, and whole groups are pruned as soon as the differences accumulated on the way down exceed what the
numbers of sites and the tolerances allow. What remains is compared exactly (`crystals.coincide`; molecules: `crystals.rigid_match`).
Records that a node's earlier pairs already brought into one class aren't compared again: only links that join classes come out.
Nodes beyond `node_limit` rows are cut into tiles, so that no task holds an unbounded node; no candidate is dropped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.components import connected_components
from lodestone.operators.crystals import Sites, SiteTable, cells_agree, coincide, metric, rigid_match, widest
from lodestone.session import Scratch

#: Bins of the top level: width and reach (tolerance with a little room) for log lengths, angles and log number of sites.
LEN_BIN, ANGLE_BIN, N_BIN = 0.1, 6.0, 0.5
LEVEL = 0.004  # one level of the unary code, in log length
CELL_BITS = 20  # bits of each length
COARSE = np.uint64(sum(1 << b for b in range(0, 3 * CELL_BITS, 4)))  # the masked pattern of the middle level
HALF_WORDS = (1, 2, 4, 8, 16, 32)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def gray_rank(w: np.ndarray) -> np.ndarray:
    """The place of a word in the reflected Gray order: neighbours in that order differ by one bit."""
    out = w.copy()
    for s in HALF_WORDS:
        out ^= out >> np.uint64(s)
    return out


def cell_word(lengths: np.ndarray) -> np.ndarray:
    """Cyclic unary codes of (rows, 3) sorted lengths in one 60-bit word; 0 without a cell."""
    with np.errstate(invalid="ignore"):
        level = np.nan_to_num(np.round(np.log(lengths) / LEVEL)).astype(np.int64) % (2 * CELL_BITS)
    bits = np.where(level <= CELL_BITS, (1 << level.clip(0, CELL_BITS)) - 1, ((1 << CELL_BITS) - 1) ^ ((1 << (level - CELL_BITS).clip(0)) - 1))
    word = bits[:, 0] | bits[:, 1] << CELL_BITS | bits[:, 2] << (2 * CELL_BITS)
    return np.where(np.isfinite(lengths).all(1), word, 0).astype(np.uint64)


def composition_word(z: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """One hashed bit for each (element, k): set if the structure has at least k atoms of the element."""
    order = np.lexsort((z, row))
    zs, rs = z[order].astype(np.int64), row[order]
    new = np.ones(len(zs), bool)
    new[1:] = (zs[1:] != zs[:-1]) | (rs[1:] != rs[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(zs)), 0))
    k = np.arange(len(zs)) - first
    bit = ((zs * 64 + k) * 0x9E3779B1 & 0xFFFFFFFF) >> 26
    out = np.zeros(rows, np.uint64)
    np.bitwise_or.at(out, rs, np.uint64(1) << bit.astype(np.uint64))
    return out


def bins_in_reach(values: list[tuple[np.ndarray, float, float]], later_only: bool = True) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Home node of each row, and (row, node) of the other nodes within reach, or of the later ones. values: (numbers, bin width, reach)."""
    home, low, high = [], [], []
    for v, width, tol in values:
        home.append(np.floor(v / width).astype(np.int64))
        low.append(np.floor((v - tol) / width).astype(np.int64))
        high.append(np.floor((v + tol) / width).astype(np.int64))
    pack = lambda parts: sum((p + 8 & 0xFF) << (8 * i) for i, p in enumerate(parts))
    base, visits = pack(home), []
    # per dimension at most one other bin is in reach, as reach is below half a bin
    other = [np.where(lo < h, lo, hi) for h, lo, hi in zip(home, low, high)]
    can = [o != h for o, h in zip(other, home)]
    for mask in itertools.product((0, 1), repeat=len(values)):
        if any(mask):
            rows = np.flatnonzero(np.logical_and.reduce([c for c, m in zip(can, mask) if m]))
            if len(rows):
                node = pack([(o if m else h)[rows] for o, h, m in zip(other, home, mask)])
                later = node > base[rows] if later_only else slice(None)
                visits.append((rows[later], node[later]))
    return base, visits


ROW = pa.schema([("node", pa.int64()), ("tile", pa.int32()), ("visit", pa.bool_()), ("id", pa.int64()), ("twin", pa.int64()), ("sites", pa.binary())])
ROW_DDL = "node long, tile int, visit boolean, id long, twin long, sites binary"


def _prepare(similarity: float, length_tol: float, angle_tol: float):
    """Arrow batches (id, elements, positions, cell) to index rows. Repeats within a task become rows with `twin`, their first copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            s = Sites(batch.column(1), batch.column(2), batch.column(3))
            par, x = s.parameters(), s.fractions()
            x = np.where(s.crystal[s.row][:, None], x - np.floor(x), x).astype(np.float32)
            order = np.lexsort((x[:, 2], x[:, 1], x[:, 0], s.z, s.row))
            z, x = s.z[order].astype(np.uint8), x[order]
            zb, xb, pb = z.tobytes(), x.tobytes(), par.astype(np.float32)
            body = [pb[i].tobytes() + zb[a:b] + xb[12 * a : 12 * b] for i, (a, b) in enumerate(zip(s.off[:-1], s.off[1:]))]
            twin = np.full(len(ids), -1, np.int64)
            for i in np.flatnonzero(s.n > 0):
                first = seen.setdefault(body[i], int(ids[i]))
                if first != ids[i]:
                    twin[i] = first
            keep = np.flatnonzero((s.n > 0) & (twin < 0))
            rows = [np.flatnonzero(twin >= 0)]
            nodes = [ids[rows[0]] & 0xFFFF | 1 << 62]  # twins only pass through; any spread will do
            visit = [np.zeros(len(rows[0]), bool)]
            lengths, angles = np.sort(par[:, :3], 1), np.sort(par[:, 3:], 1)
            logn = np.log(s.n.clip(1))
            n_reach = -np.log(similarity) + 1e-6
            small = _small_limit(similarity)
            mol = keep[~s.crystal[keep] & (s.n[keep] <= small)]
            own = [_shared_keys(s.z[s.off[i] : s.off[i + 1]], similarity) for i in mol]
            rows.append(np.repeat(mol, [len(o) for o in own]))
            nodes.append(np.array([x for o in own for x in o], np.int64))
            visit.append(np.zeros(len(rows[-1]), bool))
            for kind in (True, False):
                k = keep[s.crystal[keep] == kind]
                if not kind:  # partners of larger molecules; pairs of small ones meet by their shared atoms
                    k = k[s.n[k] >= np.ceil(similarity * (small + 1) - 1e-9)]
                if kind:
                    dims = [(np.log(lengths[k, d]), LEN_BIN, -np.log(1 - length_tol) + 1e-4) for d in range(3)]
                    dims += [(angles[k, d] + ANGLE_BIN / 2, ANGLE_BIN, angle_tol + 1e-4) for d in range(3)]
                    dims.append((logn[k], N_BIN, n_reach))
                else:
                    dims = [(logn[k], N_BIN, n_reach)]
                home, visits = bins_in_reach(dims)
                mark = 0 if kind else 1 << 60
                for r, n, v in [(np.arange(len(k)), home, False), *[(r, n, True) for r, n in visits]]:
                    rows.append(k[r])
                    nodes.append(n | mark)
                    visit.append(np.full(len(r), v))
            rows_, body_ = np.concatenate(rows), pa.array(body, pa.binary())
            t = twin[rows_]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(nodes).astype(np.int64)), pa.array(np.zeros(len(rows_), np.int32)), pa.array(np.concatenate(visit)), pa.array(ids[rows_]),
                 pa.array(t, mask=t < 0), pc.if_else(pa.array(t < 0), body_.take(pa.array(rows_)), pa.scalar(None, pa.binary()))],
                schema=ROW,
            )

    return run


_ATOM = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_ATOM = ((_ATOM ^ (_ATOM >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(8)
_KEY_MASK, _KEY_MARK = (1 << 59) - 1, 1 << 61


def _small_limit(similarity: float) -> int:
    """Largest number of sites of which at most two may be missing."""
    return max(n for n in range(1, 1000) if n - int(np.ceil(similarity * n - 1e-9)) <= 2)


def atoms_key(counts: np.ndarray) -> int:
    """Node of molecules that share exactly these atoms (counts by atomic number)."""
    return int((counts.astype(np.uint64) * _ATOM[: len(counts)]).sum() & np.uint64(_KEY_MASK)) | _KEY_MARK


def _shared_keys(z: np.ndarray, similarity: float) -> list[int]:
    """Nodes of a molecule: of all its atoms, and of what is left when any one or two that may be missing are taken away."""
    counts = np.bincount(z, minlength=128)
    miss = len(z) - int(np.ceil(similarity * len(z) - 1e-9))
    kinds = np.flatnonzero(counts)
    keys = []
    for m in range(miss + 1):
        for gone in itertools.combinations_with_replacement(kinds, m):
            left = counts.copy()
            np.subtract.at(left, list(gone), 1)
            if left.min() >= 0 and left.sum():
                keys.append(atoms_key(left))
    return keys


class _Members:
    """Decoded rows of one or more whole nodes, sorted by node, composition word and cell word in Gray order."""

    def __init__(self, batch: pa.Table):
        get = lambda c: batch.column(c).combine_chunks()
        body = get("sites")
        if isinstance(body, pa.ChunkedArray):
            body = pa.concat_arrays(body.chunks)
        off = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
        raw = np.frombuffer(body.buffers()[2], np.uint8) if body.buffers()[2] else np.zeros(0, np.uint8)
        n = (np.diff(off) - 24) // 13
        take = lambda start, width: raw[np.repeat(start, width) + _arange(width)]
        par = take(off[:-1], np.full(len(n), 24)).view(np.float32).reshape(-1, 6).astype(np.float64)
        z = take(off[:-1] + 24, n)
        x = take(off[:-1] + 24 + n, 12 * n).view(np.float32).reshape(-1, 3)
        row = np.repeat(np.arange(len(n)), n)
        comp, cell = composition_word(z.astype(np.int64), row, len(n)), cell_word(np.sort(par[:, :3], 1))
        node, tile = np.asarray(get("node")), np.asarray(get("tile"))
        top = node * 4096 + tile if len(node) == 0 else pd.factorize(pd.MultiIndex.from_arrays([node, tile]))[0]
        order = np.lexsort((gray_rank(cell), gray_rank(cell & COARSE), gray_rank(comp), top))
        self.order = order
        self.top, self.comp, self.cell, self.n, self.par = top[order], comp[order], cell[order], n[order], par[order]
        self.node = node[order]
        self.id, self.visit = np.asarray(get("id"))[order], np.asarray(get("visit"))[order]
        self.crystal = np.isfinite(self.par).all(1)
        pos = np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1][order], self.n) + _arange(self.n)
        self.sites = SiteTable(self.n, z[pos].astype(np.int16), x[pos])

    def molecule(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.sites.z[k, : self.n[k]], self.sites.x[k, : self.n[k]].astype(float)


class _Classes:
    """Which members links found so far bring together."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take in the links (a, b); returns those that joined two classes."""
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        used = []
        for k, (x, y) in enumerate(zip(self.root[a].tolist(), self.root[b].tolist())):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                used.append(k)
        if up:
            to = np.arange(len(self.root))
            for x in up:
                to[x] = top(x)
            self.root = to[self.root]
        return a[used], b[used]


def _arange(width: np.ndarray) -> np.ndarray:
    """0..w-1 for each w, joined."""
    total = int(width.sum())
    return np.arange(total) - np.repeat(np.cumsum(width) - width, width)


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _descend(m: _Members, similarity: float, cell_reach: int, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (i, j) of members: pairs of groups go down the levels of the index while the differences allow it.

    Levels: node, composition word, masked cell word, member. Every group is a range of members; its children are a range of the next level.
    """
    last = 3
    levels = [_starts(m.top), _starts(m.top, m.comp, m.n), _starts(m.top, m.comp, m.n, m.cell & COARSE), np.arange(len(m.n))]
    ends = [np.append(s[1:], len(m.n)) for s in levels]
    child = [(np.searchsorted(levels[i + 1], levels[i]), np.searchsorted(levels[i + 1], ends[i])) for i in range(last)]
    field = [np.uint64(((1 << CELL_BITS) - 1) << (d * CELL_BITS)) for d in range(3)]

    def keep(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        i, j = levels[level][a], levels[level][b]
        if level == 1:
            big, small = np.maximum(m.n[i], m.n[j]), np.minimum(m.n[i], m.n[j])
            need = np.ceil(similarity * big - 1e-9).astype(np.int64)
            return (small >= need) & (popcount(m.comp[i] ^ m.comp[j]) <= big + small - 2 * need) & ((a != b) | (ends[1][a] - i > 1))
        if level == 2:
            # the mask sees one bit in four: d levels change at most d / 4 + 1 of them, for each length
            return (popcount((m.cell[i] ^ m.cell[j]) & COARSE) <= 3 * (cell_reach // 4 + 1)) & ((a != b) | (ends[2][a] - i > 1))
        diff, ok = m.cell[i] ^ m.cell[j], ~(m.visit[i] & m.visit[j])
        for f in field:
            ok &= popcount(diff & f) <= cell_reach
        return ok

    def down(level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if level == last:
            yield a, b
            return
        lo, hi = child[level]
        size = (hi[a] - lo[a]) * (hi[b] - lo[b])
        at = np.concatenate([[0], np.cumsum(size)])
        k = 0
        while k < len(a):
            e = max(k + 1, int(np.searchsorted(at, at[k] + chunk, "right")) - 1)
            wide = hi[b[k]] - lo[b[k]]
            strips = [(lo[a[k]], hi[a[k]])]
            if size[k] > chunk:  # two large groups: in strips
                step = max(1, chunk // wide)
                strips = [(x, min(x + step, hi[a[k]])) for x in range(lo[a[k]], hi[a[k]], step)]
            for x, y in strips:
                if e > k + 1:
                    w = np.repeat(np.arange(k, e), size[k:e])
                    within = _arange(size[k:e])
                    width = hi[b[w]] - lo[b[w]]
                    ca, cb = lo[a[w]] + within // width, lo[b[w]] + within % width
                    own = a[w] == b[w]
                else:
                    ca, cb = np.repeat(np.arange(x, y), wide), np.tile(np.arange(lo[b[k]], hi[b[k]]), y - x)
                    own = np.full(len(ca), a[k] == b[k])
                # within one group each pair once; a group is paired with itself for the pairs inside it
                once = ~own | (ca < cb) | ((ca == cb) & (level + 1 < last))
                ca, cb = ca[once], cb[once]
                ok = keep(level + 1, ca, cb)
                if ok.any():
                    yield from down(level + 1, ca[ok], cb[ok])
            k = e

    top = np.arange(len(levels[0]))
    many = ends[0] - levels[0] > 1
    yield from down(0, top[many], top[many])


def _batched(pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for p in pairs:
        held.append(p)
        if sum(len(x[0]) for x in held) >= size:
            yield tuple(map(np.concatenate, zip(*held)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _meet_here(m: _Members, i: np.ndarray, j: np.ndarray, small: int) -> np.ndarray:
    """Molecules share several nodes: they are compared in that of all their common atoms, or in the coarse one if either is large."""
    by_atoms = (m.node[i] & _KEY_MARK) != 0
    key = np.zeros(len(i), np.uint64)
    for z in np.unique(m.sites.z[np.unique(np.concatenate([i, j]))]):
        if z:
            counts = (m.sites.z == z).sum(1)
            key += np.minimum(counts[i], counts[j]).astype(np.uint64) * _ATOM[z]
    here = ((key & np.uint64(_KEY_MASK)) | np.uint64(_KEY_MARK)).astype(np.int64) == m.node[i]
    return np.where(np.maximum(m.n[i], m.n[j]) > small, ~by_atoms, by_atoms & here)


def _triples_fit(s: SiteTable, i: np.ndarray, j: np.ndarray, miss: np.ndarray, tol: float, chunk: int = 2048) -> np.ndarray:
    """Which pairs of molecules can coincide: of miss + 1 disjoint triples of sites of i one must be whole among the coinciding sites, so j must have
    sites of the same elements at the same distances to within 2 tol. Pairs with too few sites for the triples pass."""
    ok = s.n[i] < 3 * (miss + 1)
    plans: dict[int, list[list[int]]] = {}
    for k in np.unique(i[~ok]):
        n = int(s.n[k])
        x = s.x[k, :n].astype(float)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        left = list(range(n))
        plans[int(k)] = []
        while len(left) >= 3:
            t = widest(d, left)
            plans[int(k)].append(t)
            left = [q for q in left if q not in t]
    for t in range(int(miss.max(initial=-1)) + 1):
        todo = np.flatnonzero(~ok & (miss >= t))
        for k in range(0, len(todo), chunk):
            at = todo[k : k + chunk]
            width = int(s.n[j[at]].max())
            xb, zb = s.x[j[at], :width], s.z[j[at], :width]
            db = np.sqrt(((xb[:, :, None] - xb[:, None]) ** 2).sum(3))
            site = np.array([plans[int(q)][t] for q in i[at]])
            xa, za = s.x[i[at][:, None], site], s.z[i[at][:, None], site]
            da = np.sqrt(((xa[:, :, None] - xa[:, None]) ** 2).sum(3))
            like = [zb == za[:, q][:, None] for q in range(3)]
            fit = lambda p, q: (like[p][:, :, None] & like[q][:, None] & (np.abs(db - da[:, p, q][:, None, None]) <= 2 * tol + 1e-3)).astype(np.float32)  # noqa: E731, B023
            ok[at] |= ((np.matmul(fit(1, 0), fit(0, 2)) > 0) & (fit(1, 2) > 0)).any((1, 2))
    return ok


def _links(similarity: float, site_tol: float, length_tol: float, angle_tol: float):
    """Sorted index rows of a partition to links; holds the rows of one node tile, or of several small ones, at a time."""
    cell_reach, small = int(np.ceil(-np.log(1 - length_tol) / LEVEL)) + 1, _small_limit(similarity)
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        m = _Members(t)
        classes = _Classes(len(m.n))
        near = np.flatnonzero((m.top[1:] == m.top[:-1]) & ~(m.visit[1:] & m.visit[:-1]))  # neighbours in Gray order first: most classes form here
        for i, j in itertools.chain([(near, near + 1)], _batched(_descend(m, similarity, cell_reach))):
            apart = classes.root[i] != classes.root[j]
            i, j = i[apart], j[apart]
            need = np.ceil(similarity * np.maximum(m.n[i], m.n[j]) - 1e-9).astype(np.int64)
            enough = np.minimum(m.n[i], m.n[j]) >= need
            i, j, need = i[enough], j[enough], need[enough]
            swap = m.n[j] > m.n[i]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            kind = m.crystal[i] & m.crystal[j]
            agree = cells_agree(m.par[i[kind]], m.par[j[kind]], length_tol, angle_tol)
            pair, turn = np.nonzero(agree)
            ci, cj = i[kind][pair], j[kind][pair]
            ok = coincide(m.sites, m.sites, ci, cj, turn, metric(m.par[ci]), need[kind][pair], site_tol)
            mol = np.flatnonzero(~m.crystal[i] & ~m.crystal[j])
            mol = mol[_meet_here(m, i[mol], j[mol], small)]
            mol = mol[_triples_fit(m.sites, i[mol], j[mol], m.n[i[mol]] - need[mol], site_tol)]
            hit = [k for k in mol if classes.root[i[k]] != classes.root[j[k]] and rigid_match(*m.molecule(i[k]), *m.molecule(j[k]), int(need[k]), site_tol)]
            a, b = classes.join(np.concatenate([ci[ok], i[hit]]).astype(np.int64), np.concatenate([cj[ok], j[hit]]).astype(np.int64))
            if len(a):
                a, b = m.id[a], m.id[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            twins = t.filter(pc.is_valid(t["twin"]))
            if len(twins):
                a, b = np.asarray(twins["id"].combine_chunks()), np.asarray(twins["twin"].combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=out)
                t = t.filter(pc.is_null(t["twin"]))
            if not len(t):
                continue
            held.append(t)
            rows += len(t)
            if rows >= 40_000:
                every = pa.concat_tables(held).combine_chunks()
                node, tile = np.asarray(every["node"].combine_chunks()), np.asarray(every["tile"].combine_chunks())
                last = int(_starts(node, tile)[-1])  # the last tile may go on in the next batch
                if last:
                    yield from solve(every.slice(0, last).combine_chunks())
                held, rows = [every.slice(last)], len(every) - last
        if rows:
            yield from solve(pa.concat_tables(held).combine_chunks())

    return run


def duplicate_links(structures: DataFrame, id_col: str = "seq", similarity: float = 0.85, site_tol: float = 0.1, length_tol: float = 0.02, angle_tol: float = 1.0, node_limit: int = 20_000, scratch: Scratch | None = None) -> DataFrame:
    """Links (a, b), a < b, between near-duplicate structures; an exact copy is linked to one earlier copy only, not to all.

    Needs id_col (unique, bigint), elements, positions, cell; other columns are ignored, whatever their names. Rows with null, empty or
    uneven elements and positions, or non-finite coordinates, link to nothing. A null or singular cell makes a molecule, compared
    up to rotation. An empty table gives no links. The classes that links form depend on neither partitioning nor order; which links join a class may. `scratch` holds the
    index rows; the caller may clear it once the links are kept.
    """
    spark = structures.sparkSession
    scratch = scratch or Scratch(spark, "near-duplicates")
    rows = structures.select(F.col(id_col).cast("long").alias("id"), "elements", "positions", "cell").where("id is not null")
    rows = scratch.keep(rows.mapInArrow(_prepare(similarity, length_tol, angle_tol), ROW_DDL))
    # nodes over the limit are cut into tiles: home rows go to one tile of each pair of tiles, so that each pair still meets once
    hot = rows.where("twin is null").groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > node_limit)
    if hot.limit(1).count():
        hot = hot.select("node", F.ceil(F.col("n") / F.lit(node_limit / 2)).cast("int").alias("tiles"))
        rows = rows.drop("tile").join(hot, "node", "left")
        part = F.when(F.col("tiles").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("sites"), F.col("tiles")).cast("int"))
        rows = rows.withColumn("part", part)
        # a row of part p takes part in the tiles {p, q} for every q; pairs within p are found in tile {p, p} alone
        pairs = F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda q: F.least(q, F.col("part")) * F.col("tiles") + F.greatest(q, F.col("part")))
        )
        rows = rows.withColumn("tile", F.explode(pairs)).select("node", "tile", "visit", "id", "twin", "sites")
    parted = rows.repartition("node", "tile").sortWithinPartitions("node", "tile")
    return parted.mapInArrow(_links(similarity, site_tol, length_tol, angle_tol), "a long, b long")


def link_counts(links: DataFrame) -> DataFrame:
    """(node, links): how many of the links that join the classes each record is an end of."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("links"))


def duplicate_groups(structures: DataFrame, id_col: str = "seq", **how) -> DataFrame:
    """(id, group): one row for each record that has a near-duplicate; group is the smallest id of the group. See `duplicate_links`."""
    index = Scratch(structures.sparkSession, "near-duplicates")
    links = Scratch(structures.sparkSession, "near-duplicate-links").keep(duplicate_links(structures, id_col, scratch=index, **how))
    index.clear()
    return connected_components(links).select(F.col("node").alias(id_col), F.col("component").alias("group"))


def duplicate_pairs(structures: DataFrame, id_col: str = "seq", **how) -> DataFrame:
    """All pairs of records of the same group, smaller id first, as seq_a and seq_b: the form that the found query states."""
    groups = Scratch(structures.sparkSession, "near-duplicate-groups").keep(duplicate_groups(structures, id_col, **how))
    a, b = groups.select(F.col(id_col).alias("seq_a"), "group"), groups.select(F.col(id_col).alias("seq_b"), "group")
    return a.join(b, "group").where("seq_a < seq_b").select("seq_a", "seq_b")
