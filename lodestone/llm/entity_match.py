"""Matching a second description of crystals with structures, without a shared key.

1. Blocking across attributes: the MinHash signature of the set of elements, joined with coarse bins of the sorted cell lengths and angles that are in reach of
   the tolerances. Records of the same elements have equal signatures, so no pair that meets the conditions is missed; formulas need not agree.
2. Features of each candidate pair: overlap of the reduced formulas (tokens "element:share"), largest relative difference of a cell length, largest difference of
   an angle, share of listed sites, and whether all, or most, listed sites coincide with sites of the structure.
3. A logistic classifier on these, fitted to weak labels (do the ICSD numbers of the two records overlap? they are unreliable) of a
   bounded sample of candidate pairs, then calibrated on held-out pairs with Platt's scaling: the confidence of the match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.formula import parse_formula, reduce_counts
from lodestone.llm.near_duplicates import ANGLE_BIN, LEN_BIN, bins_in_reach
from lodestone.operators.crystals import NUMBER, Sites, SiteTable, atomic_number, cells_agree, coincide, metric
from lodestone.session import Scratch

HASHES = 4  # MinHash functions of a signature of the elements
#: Length units in angstrom.
LENGTH_UNIT = {"": 1.0, "a": 1.0, "å": 1.0, "ang": 1.0, "angs": 1.0, "angstrom": 1.0, "angstroms": 1.0, "ångström": 1.0, "pm": 0.01, "picometre": 0.01, "picometer": 0.01, "nm": 10.0, "nanometre": 10.0, "nanometer": 10.0, "bohr": 0.529177210903, "a.u.": 0.529177210903}

OUT = pa.schema([("node", pa.int64()), ("id", pa.int64()), ("tokens", pa.list_(pa.int64())), ("n_cell", pa.int32()), ("sites", pa.binary())])
OUT_DDL = "node long, id long, tokens array<long>, n_cell int, sites binary"


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    return x ^ (x >> np.uint64(31))


def minhash(tokens: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Signature, combined into one number, of token sets that begin at `start`."""
    sig = np.zeros(len(start), np.uint64)
    for k in range(HASHES):
        sig = _mix(sig ^ np.minimum.reduceat(_mix(tokens, k + 1), start), 77)
    return sig


CERTAIN = 0.5  # confidence that a match needs
SHARE = 1 << 20  # a token is element * SHARE + its share in the reduced formula


def _composition(z: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, list[list[int]]]:
    """Signature of the elements and tokens of the reduced formula of each row from its sites; none where there are none."""
    key = np.sort(row.astype(np.int64) * 256 + z)
    uniq, count = np.unique(key, return_counts=True)
    owner = uniq >> 8
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(uniq) else np.zeros(0, np.int64)
    sig, tokens = np.zeros(rows, np.uint64), [[] for _ in range(rows)]
    if len(uniq):
        g = np.gcd.reduceat(count, start)
        share = count // np.repeat(g, np.diff(np.append(start, len(uniq))))
        sig[owner[start]] = minhash(uniq & 255, start)
        for o, t in zip(owner.tolist(), ((uniq & 255) * SHARE + share).tolist()):
            tokens[o].append(t)
    return sig, tokens


def _block(par: np.ndarray, sig: np.ndarray, length_tol: float, angle_tol: float, visit: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of the bins of each row; with visit, of all bins in reach."""
    lengths, angles = np.sort(par[:, :3], 1), np.sort(par[:, 3:], 1)
    dims = [(np.log(lengths[:, d]), LEN_BIN, -np.log(1 - length_tol) + 1e-4) for d in range(3)]
    dims += [(angles[:, d] + ANGLE_BIN / 2, ANGLE_BIN, angle_tol + 1e-3) for d in range(3)]
    home, others = bins_in_reach(dims, later_only=False)
    rows, nodes = [np.arange(len(par))], [home]
    if visit:
        rows += [r for r, _ in others]
        nodes += [n for _, n in others]
    row, node = np.concatenate(rows), np.concatenate(nodes)
    return row, (_mix(node.astype(np.uint64), 5) ^ sig[row]).view(np.int64)


def _emit(ids, keep, par, n, z, x, off, sig, tokens, n_cell, length_tol, angle_tol, visit) -> pa.RecordBatch:
    keep = np.flatnonzero(keep)
    row, node = _block(par[keep], sig[keep], length_tol, angle_tol, visit)
    zb, xb, pb = z.astype(np.uint8).tobytes(), x.astype(np.float32).tobytes(), par.astype(np.float32)
    body = pa.array([pb[i].tobytes() + zb[off[i] : off[i + 1]] + xb[12 * off[i] : 12 * off[i + 1]] for i in keep], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(node), pa.array(ids[keep][row]), pa.array([tokens[k] for k in keep[row]], pa.list_(pa.int64())), pa.array(n_cell[keep][row].astype(np.int32)), body.take(pa.array(row))], schema=OUT
    )


def _structures(length_tol: float, angle_tol: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Sites(b.column(1), b.column(2), b.column(3))
            sig, tokens = _composition(s.z, s.row, len(s.n))
            yield _emit(np.asarray(b.column(0), np.int64), s.crystal & (s.n > 0), s.parameters(), s.n, s.z, s.fractions(), s.off, sig, tokens, s.n, length_tol, angle_tol, False)

    return run


def _measured(length_tol: float, angle_tol: float):
    known: dict[str | None, tuple[int, list[int]]] = {}

    def formula_keys(text: str | None) -> tuple[int, list[int]]:
        if text not in known:
            counts = reduce_counts(parse_formula(text) or {})
            z = np.array(sorted(NUMBER[k] for k in counts), np.int64)
            known[text] = (int(minhash(z, np.zeros(1, np.int64))[0]), sorted(NUMBER[k] * SHARE + v for k, v in counts.items())) if counts else (0, [])
        return known[text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Sites(b.column(1), b.column(2), None)
            unit = np.array([LENGTH_UNIT.get((u or "").strip().lower(), np.nan) for u in b.column(3).to_pylist()])
            num = lambda i, d: np.asarray(pc.fill_null(b.column(i), d), np.float64)
            par = np.stack([num(4, np.nan) * unit, num(5, np.nan) * unit, num(6, np.nan) * unit, num(7, 90.0), num(8, 90.0), num(9, 90.0)], 1)
            sig, tokens = _composition(s.z, s.row, len(s.n))
            text = [t if t and t.strip() else None for t in b.column(10).to_pylist()]
            given = np.array([t is not None for t in text], bool)
            for i in np.flatnonzero(given):
                sig[i], tokens[i] = formula_keys(text[i])
            keep = (s.n > 0) & np.isfinite(par).all(1) & (par[:, :3] > 0).all(1) & np.array([bool(t) for t in tokens], bool)
            # without a formula the listed sites are complete: n_cell is then their number, else -1
            yield _emit(np.asarray(b.column(0), np.int64), keep, par, s.n, s.z, s.xyz, s.off, sig, tokens, np.where(given, -1, s.n), length_tol, angle_tol, True)

    return run


def _decode(col: pa.Array) -> tuple[np.ndarray, SiteTable]:
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8)
    n = (np.diff(off) - 24) // 13
    inner = lambda w: np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    take = lambda start, w: raw[np.repeat(start, w) + inner(w)]
    par = take(off[:-1], np.full(len(n), 24)).view(np.float32).reshape(-1, 6).astype(np.float64)
    return par, SiteTable(n, take(off[:-1] + 24, n).astype(np.int16), take(off[:-1] + 24 + n, 12 * n).view(np.float32).reshape(-1, 3))


FEATURES = pa.schema([("seq", pa.int64()), ("ref_id", pa.int64()), ("weak", pa.float64()), ("formula", pa.float64()), ("d_length", pa.float64()), ("d_angle", pa.float64()), ("listed", pa.float64()), ("most", pa.float64()), ("every", pa.float64()), ("exact", pa.bool_())])
FEATURES_DDL = "seq long, ref_id long, weak double, formula double, d_length double, d_angle double, listed double, most double, every double, exact boolean"


def _features(site_tol: float, length_tol: float, angle_tol: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (ps, ss), (pm, sm) = _decode(b.column(2)), _decode(b.column(3))
            complete = np.asarray(b.column(4), np.int64)
            k = np.arange(b.num_rows)
            agree = cells_agree(pm, ps, length_tol, angle_tol)
            turns = np.stack([np.concatenate([np.roll(ps[:, :3], -r, 1), np.roll(ps[:, 3:], -r, 1)], 1) for r in range(3)], 1)
            dl = (np.abs(turns[..., :3] - pm[:, None, :3]) / np.maximum(turns[..., :3], pm[:, None, :3])).max(2)
            da = np.abs(turns[..., 3:] - pm[:, None, 3:]).max(2)
            best = (dl + da / 50).argmin(1)
            whole, part = np.zeros(len(k), bool), np.zeros(len(k), bool)
            fits = (sm.n <= ss.n) & ((complete < 0) | (complete == ss.n))
            for goal, share in ((whole, 1.0), (part, 0.7)):
                pair, turn = np.nonzero(agree & fits[:, None] & ~(whole if share < 1 else np.zeros_like(whole))[:, None])
                need = np.ceil(share * sm.n[pair] - 1e-9).astype(np.int64)
                hit = coincide(sm, ss, pair, pair, turn, metric(pm[pair]), need, site_tol)
                goal[pair[hit]] = True
            part |= whole
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(5), b.column(6), pa.array(dl[k, best]), pa.array(da[k, best]), pa.array(sm.n / ss.n.clip(1)), pa.array(part.astype(float)), pa.array(whole.astype(float)), pa.array(whole & (np.asarray(b.column(6), float) == 1.0))], schema=FEATURES
            )

    return run


def candidate_features(structures: DataFrame, measured: DataFrame, site_tol: float = 0.15, length_tol: float = 0.02, angle_tol: float = 1.0) -> DataFrame:
    """Candidate pairs (seq, ref_id) with their features, the weak label (1 if the ICSD numbers overlap, 0 if not, null where one has none) and `exact`: whether they
    meet all stated conditions."""
    s = structures.select(F.col("seq").cast("long"), "elements", "positions", "cell").where("seq is not null and cell is not null")
    m = measured.select(F.col("ref_id").cast("long"), "elements", "positions", "length_unit", "cell_a", "cell_b", "cell_c", "alpha", "beta", "gamma", "formula_text").where("ref_id is not null and positions is not null")
    named = lambda t, key, ids, out: t.where(f"{key} is not null and size({ids}) > 0").groupBy(F.col(key).cast("long").alias(key)).agg(F.first(ids).alias(out))
    left = s.mapInArrow(_structures(length_tol, angle_tol), OUT_DDL).select("node", F.col("tokens").alias("s_tokens"), F.col("id").alias("seq"), F.col("sites").alias("s_sites"))
    right = m.mapInArrow(_measured(length_tol, angle_tol), OUT_DDL).select("node", F.col("tokens").alias("m_tokens"), F.col("id").alias("ref_id"), "n_cell", F.col("sites").alias("m_sites"))
    left = left.join(named(structures, "seq", "icsd_ids", "s_ids"), "seq", "left")
    right = right.join(named(measured, "ref_id", "icsd_ids", "m_ids"), "ref_id", "left")
    weak = F.arrays_overlap("s_ids", "m_ids").cast("double").alias("weak")
    overlap = (F.size(F.array_intersect("s_tokens", "m_tokens")) / F.size(F.array_union("s_tokens", "m_tokens"))).alias("formula")
    pairs = left.join(right, "node").select("seq", "ref_id", "s_sites", "m_sites", "n_cell", weak, overlap)
    return pairs.mapInArrow(_features(site_tol, length_tol, angle_tol), FEATURES_DDL)


INPUTS = ("formula", "d_length", "d_angle", "listed", "most", "every")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression with an intercept, by Newton's steps; the ridge keeps separable data finite."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def match_entities(structures: DataFrame, measured: DataFrame, fit_pairs: int = 20_000, **tolerances) -> DataFrame:
    """(seq, ref_id, confidence, exact) for every candidate pair; confidence is the calibrated probability of a match.

    At most `fit_pairs` candidate pairs in which both records have ICSD numbers are brought to the driver to fit and calibrate the classifier; all
    pairs are scored. Without such pairs, or with labels of one kind only, the confidence is the share of conditions met. Entries without positions, with an
    unknown length unit, unreadable formula, or null cell lengths match nothing; null angles are right angles; a null or empty formula means that the listed
    sites are complete. Repeated rows give repeated matches. Empty tables give no rows; other columns are ignored.
    """
    spark = structures.sparkSession
    pairs = Scratch(spark, "entity-pairs").keep(candidate_features(structures, measured, **tolerances))
    h = F.xxhash64("seq", "ref_id")
    rows = pairs.where("weak is not null").select(*INPUTS, F.col("weak").alias("y"), (F.pmod(h, F.lit(5)) == 0).alias("held"), h.alias("h")).orderBy("h").limit(fit_pairs).toPandas()
    fit, held = rows[~rows.held], rows[rows.held]
    if len(fit) and len(held) and fit.y.nunique() == 2:
        mean, std = fit[list(INPUTS)].mean().to_numpy(), fit[list(INPUTS)].std(ddof=0).to_numpy() + 1e-9
        w = _logistic((fit[list(INPUTS)].to_numpy() - mean) / std, fit.y.to_numpy())
        score = lambda t: np.column_stack([np.ones(len(t)), (t[list(INPUTS)].to_numpy() - mean) / std]) @ w
        scale = _logistic(score(held)[:, None], held.y.to_numpy(), 0.01) if held.y.nunique() == 2 else np.array([0.0, 1.0])
        z = F.lit(float(w[0]))
        for i, c in enumerate(INPUTS):
            z = z + (F.col(c) - float(mean[i])) / float(std[i]) * float(w[i + 1])
        confidence = 1 / (1 + F.exp(-(z * float(scale[1]) + float(scale[0]))))
    else:
        confidence = (F.col("formula") + F.col("most") + F.col("every")) / 3
    return pairs.select("seq", "ref_id", confidence.alias("confidence"), "exact")
