"""The coincidence of site sets near the tolerance: pairs that meet the definition by construction must all be found."""

import numpy as np
import pytest

from lodestone.operators.crystals import SiteTable, coincide, covering_triples, rigid_match


def _ball(rng, n, r):
    v = rng.normal(size=(n, 3))
    return v / np.linalg.norm(v, axis=1)[:, None] * r * rng.random((n, 1)) ** (1 / 3)


def _turn(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def _molecule(rng, n):
    x = [np.zeros(3)]
    while len(x) < n:
        v = rng.normal(size=3)
        c = x[rng.integers(len(x))] + 1.5 * v / np.linalg.norm(v)
        if min(np.linalg.norm(c - q) for q in x) > 1.0:
            x.append(c)
    return np.array(x)


@pytest.mark.parametrize("tol", [0.1, 0.15])
@pytest.mark.parametrize("n", [4, 8, 16, 20])
def test_crystals_displaced_by_nearly_the_tolerance(n, tol):
    rng, pairs, cell = np.random.default_rng(n), 60, np.array([[8.0, 0, 0], [1.5, 7.5, 0], [-1.0, 0.8, 9.0]])
    xa, z = np.zeros((pairs, n, 3)), rng.choice([8, 52, 55], (pairs, n))
    for p in range(pairs):
        at = rng.permutation(27)[:n]
        xa[p] = (np.stack([at // 9, at // 3 % 3, at % 3], 1) + 0.1 * rng.random((n, 3))) / 3
    xb = (xa + _ball(rng, pairs * n, 0.95 * tol).reshape(pairs, n, 3) @ np.linalg.inv(cell) + rng.random((pairs, 1, 3))) % 1
    table = lambda x: SiteTable(np.full(pairs, n), z.reshape(-1).astype(np.int16), x.reshape(-1, 3))
    every, g = np.arange(pairs), np.tile(cell @ cell.T, (pairs, 1, 1))
    assert coincide(table(xa), table(xb), every, every, np.zeros(pairs, int), g, np.full(pairs, n), tol).all()


def test_origin_search_equals_dense_grid():
    rng, cell = np.random.default_rng(1), 8.0
    for _ in range(40):
        x = np.array([[0.1, 0.1, 0.1], [0.4, 0.1, 0.2], [0.1, 0.5, 0.3], [0.6, 0.6, 0.6]])
        move = _ball(rng, 4, 0.16)
        y = x + move / cell
        # the smallest radius of a ball about all four steps, from a fine grid
        grid = np.stack(np.meshgrid(*[np.arange(-0.16, 0.161, 0.01)] * 3), -1).reshape(-1, 3)
        best = np.sqrt(((move[None] - grid[:, None]) ** 2).sum(2)).max(1).min()
        table = lambda p: SiteTable(np.array([4]), np.array([1, 2, 3, 4], np.int16), p)
        one = np.zeros(1, int)
        found = bool(coincide(table(x), table(y), one, one, one, np.eye(3)[None] * cell**2, np.array([4]), 0.1)[0])
        if abs(best - 0.1) > 0.01:
            assert found == (best < 0.1)


@pytest.mark.parametrize("n", [4, 6, 9, 14, 20, 24])
def test_molecules_displaced_by_nearly_the_tolerance(n):
    rng = np.random.default_rng(n)
    for _ in range(25):
        x, z = _molecule(rng, n), rng.choice([1, 6, 8], n)
        y = (x + _ball(rng, n, 0.095)) @ _turn(rng) + 5
        need = int(np.ceil(0.85 * n - 1e-9))
        gone = rng.permutation(n)[: n - need]
        y[gone] += 1.0 + rng.random((len(gone), 3))
        order = rng.permutation(n)
        assert rigid_match(z, x, z[order], y[order], need, 0.1)


LINEAR = {
    "rod with side atoms": ([6, 8, 7, 16, 1, 1], [(0, 0, 0), (0, 0, 1.2), (0, 0, -1.2), (0, 0, 2.6), (1.0, 0, 0.2), (0, 1.0, -0.3)]),
    "trigonal bipyramid": ([15, 9, 17, 8, 8, 7], [(0, 0, 0), (0, 0, 1.6), (0, 0, -1.6), (1.5, 0, 0), (-0.75, 1.3, 0), (-0.75, -1.3, 0)]),
    "pentafluoride": ([15, 9, 9, 9, 9, 9], [(0, 0, 0), (0, 0, 1.6), (0, 0, -1.6), (1.5, 0, 0), (-0.75, 1.3, 0), (-0.75, -1.3, 0)]),
    "linear": ([6, 8, 16], [(0, 0, 0), (0, 0, 1.2), (0, 0, -1.5)]),
    "two": ([6, 8], [(0, 0, 0), (0, 0, 1.2)]),
    "one": ([6], [(0, 0, 0)]),
}


@pytest.mark.parametrize("z, x", LINEAR.values(), ids=LINEAR)
def test_turned_copies_of_molecules_with_sites_on_a_line(z, x):
    rng, z, x = np.random.default_rng(3), np.array(z), np.array(x, float)
    for _ in range(40):
        order = rng.permutation(len(z))
        assert rigid_match(z, x, z[order], (x @ _turn(rng) + 3)[order], len(z), 0.1)


def test_mirror_images_and_far_sites_are_kept_apart():
    rng = np.random.default_rng(8)
    x, z = np.array([(0, 0, 0), (1.4, 0, 0), (0, 1.5, 0), (0, 0, 1.6), (-1, -1, -1)], float), np.array([6, 1, 7, 8, 9])
    assert not rigid_match(z, x, z, (x * [1, 1, -1]) @ _turn(rng), 5, 0.1)
    far = x.copy()
    far[4] += 0.5
    assert not rigid_match(z, x, z, far, 5, 0.1) and rigid_match(z, x, z, far, 4, 0.1)


@pytest.mark.parametrize("n, miss", [(9, 1), (14, 2), (20, 3)])
def test_one_triple_avoids_any_missing_sites(n, miss):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    triples = list(covering_triples(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), list(range(n)), miss))
    for _ in range(300):
        gone = set(rng.permutation(n)[:miss].tolist())
        assert any(not gone & set(t) for t in triples)
