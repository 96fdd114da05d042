"""Formation energies and distances to the convex hull of phases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import units as U
from lodestone.operators.series import hull


def phase_energies(phases: DataFrame) -> DataFrame:
    """(label, formula, n, energy_ev, elements, excluded): phases with an energy, in eV, zero counts left out; a null unit is eV, a null flag false."""
    clean = F.map_filter("formula", lambda k, v: v > 0)
    word = U.energy_word(F.coalesce("unit", F.lit("eV")))
    d = phases.where("energy is not null").withColumn("formula", clean).where(F.size("formula") > 0)
    return d.select("label", "formula", F.aggregate(F.map_values("formula"), F.lit(0), lambda a, x: a + x).alias("n"), (F.col("energy") * U.ev_factor(word)).alias("energy_ev"), F.array_sort(F.map_keys("formula")).alias("elements"), F.coalesce("excluded", F.lit(False)).alias("excluded"))


def elemental_references(energies: DataFrame) -> DataFrame:
    """(element, reference): lowest energy per atom among the phases of one element that aren't excluded."""
    one = energies.where((F.size("elements") == 1) & ~F.col("excluded"))
    return one.groupBy(F.get("elements", F.lit(0)).alias("element")).agg(F.min(F.col("energy_ev") / F.col("n")).alias("reference"))


def valued_phases(phases: DataFrame) -> DataFrame:
    """(label, formula, n, elements, excluded, formation_energy), excluded phases too; null where an element has no reference."""
    e = phase_energies(phases)
    part = e.select("label", "formula", "n", "elements", "excluded", "energy_ev", F.explode("formula").alias("element", "k")).join(elemental_references(e), "element", "left")
    whole = part.groupBy("label", "elements", "n", "excluded", "energy_ev").agg(F.sum(F.col("k") * F.col("reference")).alias("parts"), F.count("reference").alias("known"), F.count("*").alias("kinds"), F.map_from_entries(F.collect_list(F.struct("element", "k"))).alias("formula"))
    energy = F.when(F.col("known") == F.col("kinds"), (F.col("energy_ev") - F.col("parts")) / F.col("n"))
    return whole.select("label", "formula", "n", "elements", "excluded", energy.alias("formation_energy"))


def formation_energies(phases: DataFrame) -> DataFrame:
    """(label, formation_energy) in eV per atom; null for phases with an element that has no reference."""
    return valued_phases(phases).select("label", "formation_energy")


POINT = "el1 string, el2 string, label string, x double, y double, excluded boolean"


def binary_points(phases: DataFrame) -> DataFrame:
    """(el1, el2, label, x, y, excluded): valued phases of every binary system by the share of el2."""
    two = valued_phases(phases).where((F.size("elements") == 2) & F.col("formation_energy").isNotNull())
    second = F.get("elements", F.lit(1))
    return two.select(F.get("elements", F.lit(0)).alias("el1"), second.alias("el2"), "label", (F.element_at("formula", second) / F.col("n")).alias("x"), F.col("formation_energy").alias("y"), "excluded")


def _corners(frames):
    """What a task's rows can add to the hulls: hulls of hulls are the hull of all."""
    for f in frames:
        for _, g in f[~f.excluded].groupby(["el1", "el2"], sort=False):
            yield g.iloc[hull(g.x.to_numpy(), g.y.to_numpy())]


def _line(g: pd.DataFrame) -> pd.DataFrame:
    x, y = np.append(g.x.to_numpy(), [0.0, 1.0]), np.append(g.y.to_numpy(), [0.0, 0.0])
    at = hull(x, y)
    return pd.DataFrame({"el1": [g.el1.iloc[0]], "el2": [g.el2.iloc[0]], "xs": [x[at].tolist()], "ys": [y[at].tolist()]})


def hull_lines(points: DataFrame) -> DataFrame:
    """(el1, el2, xs, ys): corners of the lower hull of every system, elements included; a system's corners are few, whatever its size."""
    return points.mapInPandas(_corners, POINT).groupBy("el1", "el2").applyInPandas(_line, "el1 string, el2 string, xs array<double>, ys array<double>")


def stability(phases: DataFrame) -> DataFrame:
    """(label, formation_energy, stability) of all phases with an energy: eV per atom above the lower hull of their system.

    Excluded phases aren't part of the hull but have a value, which can be negative. Elements stand at 0. Phases of three and more elements, and those with
    an element that has no reference, have no stability: null.
    """
    points = binary_points(phases)
    lines = hull_lines(points)
    k = F.size(F.filter("xs", lambda v: v <= F.col("x")))
    i = F.greatest(F.least(k, F.size("xs") - 1), F.lit(1))
    x0, x1, y0, y1 = F.get("xs", i - 1), F.get("xs", i), F.get("ys", i - 1), F.get("ys", i)
    on = points.join(lines, ["el1", "el2"], "left").select("label", (F.col("y") - F.coalesce(y0 + (y1 - y0) * (F.col("x") - x0) / (x1 - x0), F.lit(0.0))).alias("above"))
    one = F.when(F.size("elements") == 1, F.col("formation_energy"))
    return valued_phases(phases).join(on, "label", "left").select("label", "formation_energy", F.coalesce("above", one).alias("stability"))
