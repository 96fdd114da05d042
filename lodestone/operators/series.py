"""Functions given as points: axes and grids, discretised fingerprints and their similarity, distances, smearing, hulls.

A series is a row with its sorted points as arrays, or rows (key, x, y). Axes are small parameter lists worked out on the driver; everything on data is an
expression or an aggregate that combines before the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def limit_axis(axis: np.ndarray, low: float, high: float) -> np.ndarray:
    """The values between low and high, with low and high as ends."""
    axis = np.asarray(axis, float)
    return np.concatenate([[low], axis[(axis > low) & (axis < high)], [high]])


def uniform_axis(low: float, high: float, step: float) -> np.ndarray:
    return np.arange(low, high + step, step)


def _walk(at: float, until: float, step: float, grow, sign: int, precision: int) -> list[float]:
    out = []
    while (until - at) * sign > 0:
        at = round(at + sign * grow(at) * step, precision)
        out.append(at)
    return out


def exponential_axis(low: float, high: float, step: float, most: int, mu: float, precision: int = 6) -> np.ndarray:
    """Steps grow with e^(x - mu), from one to `most` times the smallest."""
    return np.array([low, *_walk(low, high, step, lambda x: min(1 + math.exp(x - mu) // 1, most), 1, precision)])


def gaussian_axis(low: float, high: float, step: float, most: int, mu: float, sigma: float, precision: int = 6) -> np.ndarray:
    """Steps are smallest at mu and grow to 1 + `most` times that away from it, on both sides."""
    grow = lambda x: (1 + (1 - math.exp(-((x - mu) ** 2) / sigma**2)) * most) // 1
    return np.array([*_walk(mu, low, step, grow, -1, precision)[::-1], mu, *_walk(mu, high, step, grow, 1, precision)])


def join_axes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One axis after the other; a shared border counts once."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    return np.unique(np.concatenate([a, b]))


def grid(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> list[tuple[float, list[float]]]:
    """(x, y values in falling order) of each column of a grid; weights scale the y values of each column."""
    weights = np.ones(len(x)) if weights is None else np.asarray(weights, float)
    return [(float(a), np.round(np.sort(y)[::-1] * w, 8).tolist()) for a, w in zip(x, weights)]


def interpolate(xs: Column, ys: Column, at: Column) -> Column:
    """Value at a point by straight lines between the points (sorted by x); the end values hold beyond the ends."""
    k = F.size(F.filter(xs, lambda x: x <= at))
    x0, y0, x1, y1 = F.get(xs, k - 1), F.get(ys, k - 1), F.get(xs, k), F.get(ys, k)
    return F.when(k == 0, F.get(ys, F.lit(0))).when(k >= F.size(xs), F.element_at(ys, -1)).otherwise(y0 + (y1 - y0) * (at - x0) / (x1 - x0))


def integrals(xs: Column, ys: Column, edges: list[float], points: int = 5) -> Column:
    """Area between neighbouring edges by the trapezoid rule on `points` points each."""
    bins = F.array(*[F.array(*[F.lit(float(v)) for v in np.linspace(a, b, points)]) for a, b in zip(edges[:-1], edges[1:])])

    def one(p: Column) -> Column:
        v = F.transform(p, lambda at: interpolate(xs, ys, at))
        pieces = F.transform(F.sequence(F.lit(0), F.lit(points - 2)), lambda i: (F.get(p, i + 1) - F.get(p, i)) * (F.get(v, i + 1) + F.get(v, i)) / 2)
        return F.aggregate(pieces, F.lit(0.0), lambda a, b: a + b)

    return F.transform(bins, one)


def fingerprint_counts(areas: Column, heights: list[list[float]]) -> Column:
    """How many grid heights of each column lie at or below its area: a fingerprint is filled from below, so this number is all of it."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in h]) for h in heights])
    return F.transform(areas, lambda a, i: F.size(F.filter(F.get(table, i), lambda h: h <= a)))


def fingerprint_bits(areas: Column, heights: list[list[float]]) -> Column:
    """The fingerprint itself: 1 where a grid height lies at or below the area, heights from top to bottom, columns within."""
    rows = list(zip(*heights))
    table = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])
    return F.flatten(F.transform(table, lambda r: F.zip_with(r, areas, lambda h, a: F.when(h <= a, 1).otherwise(0))))


def tanimoto(c1: Column, c2: Column) -> Column:
    """Similarity of two fingerprints from their counts; null if both are empty."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, b: a + b)
    both = total(F.zip_with(c1, c2, lambda a, b: F.least(a, b)))
    return both / F.nullif(total(c1) + total(c2) - both, F.lit(0))


def distances(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, euclidian, cosine, total, absolute, correlation) of two series given as columns; points without both values are left out. One aggregate."""
    x, y = F.col(a), F.col(b)
    d = pairs.where(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.sum((x - y) * (x - y))).alias("euclidian"), (1 - F.sum(x * y) / F.nullif(F.sqrt(F.sum(x * x) * F.sum(y * y)), F.lit(0.0))).alias("cosine"),
        F.sum(x - y).alias("total"), F.sum(F.abs(x - y)).alias("absolute"), F.when((F.var_pop(x) > 1e-12) & (F.var_pop(y) > 1e-12), F.corr(x, y)).alias("correlation"),
    )
    return d


def kernel(sigma: float, method: str = "gaussian", radius: int | None = None) -> list[float]:
    """Weights from -radius to radius, of sum 1; the radius defaults to 4 sigma."""
    radius = int(4 * sigma + 0.5) if radius is None else radius
    w = [math.exp(-0.5 * (k / sigma) ** 2) if method == "gaussian" else 0.5 * sigma / (k * k + (0.5 * sigma) ** 2) for k in range(-radius, radius + 1)]
    return [v / sum(w) for v in w]


def smooth(values: Column, sigma: float, method: str = "gaussian", radius: int | None = None) -> Column:
    """An array convolved with a kernel, of the same length; values beyond its ends count as 0, nulls too."""
    w = kernel(sigma, method, radius)
    r = len(w) // 2
    weights = F.array(*map(F.lit, w))
    at = lambda i: F.aggregate(F.sequence(F.lit(-r), F.lit(r)), F.lit(0.0), lambda s, k: s + F.get(weights, k + r) * F.coalesce(F.when(i + k >= 0, F.get(values, i + k)), F.lit(0.0)))
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.size(values) - 1), at)).otherwise(values)


def extremes(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, x, low, high): smallest and largest y at each x."""
    return points.groupBy(key, x).agg(F.min(y).alias("low"), F.max(y).alias("high"))


def hull(x: np.ndarray, y: np.ndarray, lower: bool = True) -> np.ndarray:
    """Places of the corners of the lower or upper hull, by rising x."""
    sign = 1 if lower else -1
    order = np.lexsort((sign * y, x))
    out: list[int] = []
    for k in order:
        if out and x[out[-1]] == x[k]:
            continue
        while len(out) > 1 and sign * ((x[out[-1]] - x[out[-2]]) * (y[k] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[k] - x[out[-2]])) <= 0:
            out.pop()
        out.append(int(k))
    return np.array(out, np.int64)


def convex_hull(points: DataFrame, key: str, x: str, y: str, lower: bool = True, tolerance: float | None = 0.001) -> DataFrame:
    """(key, x, y): corners of each group's lower (or upper) hull; with a tolerance only corners below it (above its negative).

    A hull of hulls is the hull of all, so every task first keeps the corners of its own rows: a group of any size reaches the last step as a few rows.
    """
    schema = f"{key} {points.schema[key].dataType.simpleString()}, {x} double, {y} double"
    d = points.select(key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def part(frames):
        for f in frames:
            for _, g in f.groupby(key, sort=False, dropna=False):
                yield g.iloc[hull(g[x].to_numpy(), g[y].to_numpy(), lower)]

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        g = g.iloc[hull(g[x].to_numpy(), g[y].to_numpy(), lower)]
        return g if tolerance is None else g[g[y] < tolerance] if lower else g[g[y] > -tolerance]

    return d.mapInPandas(part, schema).groupBy(key).applyInPandas(whole, schema)
