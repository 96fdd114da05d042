"""Coordination graphs of structures: connected fragments and hydrogen bonds, inside the neighbour kernel of each structure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.operators import neighbours as N


def fragments(structures: DataFrame, r_max: float, method: str = "radius", exclude: tuple[str, ...] = (), ends: tuple[str, ...] = (), **how) -> DataFrame:
    """(seq, site, fragment): sites joined by bonds, a fragment named by its smallest site. Sites of excluded elements belong to none; bonds aren't followed beyond
    sites of end-point elements, which belong to the smallest fragment that reaches them."""

    def work(shell: N.Shell):
        s, _ = N.bonds(shell, method, r_max, **how)
        name = N.LABEL[s.z]
        use, end = ~np.isin(name.astype(str), list(exclude)), np.isin(name.astype(str), list(ends))
        ok = use[s.i] & use[s.j] & ~(end[s.i] & end[s.j])
        i, j = np.concatenate([s.i[ok], s.j[ok]]), np.concatenate([s.j[ok], s.i[ok]])
        root = np.arange(len(s.z))
        go = ~end[j]  # what a site hands on: end points hand on nothing
        while True:
            least = root.copy()
            np.minimum.at(least, i[go], root[j[go]])
            least = np.minimum(least, least[least])
            if (least == root).all():
                break
            root = least
        site = np.flatnonzero(use)
        return site, root[site]

    return N._run(structures, ["site", "fragment"], "site long, fragment long", work, [pa.int64(), pa.int64()], r_max)


def hydrogen_bonds(structures: DataFrame, donors: tuple[str, ...] = ("N", "O", "F"), bond: float = 1.3, reach: float = 2.5, least_angle: float = 120.0) -> DataFrame:
    """(seq, donor, hydrogen, acceptor, distance, angle): hydrogens bound to a donor (within `bond`) with another donor element within `reach` that sees them at
    `least_angle` degrees or more; distance is from the hydrogen to the acceptor, the angle is at the hydrogen."""

    def work(shell: N.Shell):
        out: list[list] = [[], [], [], [], []]
        polar = np.isin(N.LABEL[shell.z].astype(str), donors)
        for h in np.flatnonzero(N.LABEL[shell.z] == "H"):
            k = np.arange(shell.first[h], shell.first[h + 1])
            k = k[polar[shell.j[k]]]
            near, far = k[shell.dist[k] <= bond], k[(shell.dist[k] > bond) & (shell.dist[k] <= reach)]
            for a in near:
                for b in far:
                    cos = shell.step[a] @ shell.step[b] / (shell.dist[a] * shell.dist[b])
                    angle = float(np.degrees(np.arccos(np.clip(cos, -1, 1))))
                    if angle >= least_angle:
                        for col, v in zip(out, (int(shell.j[a]), int(h), int(shell.j[b]), float(shell.dist[b]), angle)):
                            col.append(v)
        return tuple(out)

    return N._run(structures, ["donor", "hydrogen", "acceptor", "distance", "angle"], "donor long, hydrogen long, acceptor long, distance double, angle double", work, [pa.int64()] * 3 + [pa.float64()] * 2, reach)
