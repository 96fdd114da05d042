"""Band structures and other series: gaps, alignment, densities of states, areas, peaks.

Energies are taken from the column `energy_ev`, which `unit_repair.common_bands` adds, or from `energy` where that isn't there. Repeated rows of a point count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OCCUPIED = 0.5  # electrons from which a state counts as occupied


def points(output_bands: DataFrame) -> DataFrame:
    """(bands_id, spin, band, k_idx, energy, occ): distinct points; rows without an energy are left out."""
    e = "energy_ev" if "energy_ev" in output_bands.columns else "energy"
    return output_bands.where(F.col(e).isNotNull()).groupBy("bands_id", F.coalesce("spin", F.lit("none")).alias("spin"), "band", "k_idx").agg(F.max(e).alias("energy"), F.max("occ").alias("occ"))


def _edges(p: DataFrame) -> DataFrame:
    """(bands_id, spin, cb): the first band that isn't occupied at the first k-point with known occupations."""
    first = p.where("occ is not null").groupBy("bands_id", "spin").agg(F.min("k_idx").alias("k0"))
    at = p.where("occ is not null").join(first, ["bands_id", "spin"]).where("k_idx = k0")
    return at.where(F.col("occ") < OCCUPIED).groupBy("bands_id", "spin").agg(F.min("band").alias("cb"))


def band_gaps(output_bands: DataFrame) -> DataFrame:
    """(bands_id, spin, vb, vbm, cbm, gap, direct_gap): gap between the highest occupied band and the next, at least 0, and the smallest at one k-point, at least 0.

    Calculations without occupations, without an occupied or without an empty band have no row.
    """
    p = points(output_bands)
    two = p.join(_edges(p), ["bands_id", "spin"]).where((F.col("band") == F.col("cb")) | (F.col("band") == F.col("cb") - 1))
    k = two.groupBy("bands_id", "spin", "cb", "k_idx").agg(F.max(F.when(F.col("band") < F.col("cb"), F.col("energy"))).alias("v"), F.min(F.when(F.col("band") == F.col("cb"), F.col("energy"))).alias("c"))
    g = k.groupBy("bands_id", "spin", "cb").agg(F.max("v").alias("vbm"), F.min("c").alias("cbm"), F.min(F.col("c") - F.col("v")).alias("d"))
    zero = F.lit(0.0)
    return g.where("vbm is not null and cbm is not null").select("bands_id", "spin", (F.col("cb") - 1).alias("vb"), "vbm", "cbm", F.greatest(F.col("cbm") - F.col("vbm"), zero).alias("gap"), F.greatest("d", zero).alias("direct_gap"))


def gap_at_kpoint(output_bands: DataFrame) -> DataFrame:
    """(bands_id, spin, k_idx, diff): energy between the bands on both sides of the gap at each k-point."""
    p = points(output_bands)
    two = p.join(_edges(p), ["bands_id", "spin"]).where((F.col("band") == F.col("cb")) | (F.col("band") == F.col("cb") - 1))
    k = two.groupBy("bands_id", "spin", "k_idx").agg(F.max(F.when(F.col("band") < F.col("cb"), F.col("energy"))).alias("v"), F.min(F.when(F.col("band") == F.col("cb"), F.col("energy"))).alias("c"))
    return k.where("v is not null and c is not null").select("bands_id", "spin", "k_idx", (F.col("c") - F.col("v")).alias("diff"))


def analyse_bands(output_bands: DataFrame) -> DataFrame:
    """(bands_id, spin, band, lowest, k_lowest, highest, k_highest): extremes of each band and the first k-points that have them."""
    p = points(output_bands).groupBy("bands_id", "spin", "band")
    return p.agg(
        F.min("energy").alias("lowest"), F.min_by("k_idx", F.struct("energy", "k_idx")).alias("k_lowest"), F.max("energy").alias("highest"), F.min_by("k_idx", F.struct(-F.col("energy"), F.col("k_idx"))).alias("k_highest")
    )


def shift_to_vbm(output_bands: DataFrame) -> DataFrame:
    """Distinct points with `shifted`: energies less the highest of the valence bands of both spins; calculations without a gap to find are left out."""
    top = band_gaps(output_bands).groupBy("bands_id").agg(F.max("vbm").alias("vbm"))
    return points(output_bands).join(top, "bands_id").withColumn("shifted", F.col("energy") - F.col("vbm"))


def shift_bands(output_bands: DataFrame, by: float) -> DataFrame:
    e = "energy_ev" if "energy_ev" in output_bands.columns else "energy"
    return output_bands.withColumn(e, F.col(e) + by)


def density_of_states(output_bands: DataFrame, width: float) -> DataFrame:
    """(bands_id, bin, states): number of distinct points by energy bin."""
    return points(output_bands).groupBy("bands_id", F.floor(F.col("energy") / width).alias("bin")).agg(F.count("*").alias("states"))


def band_widths(output_bands: DataFrame) -> DataFrame:
    """(bands_id, spin, band, lowest, highest, mean) of each band."""
    return points(output_bands).groupBy("bands_id", "spin", "band").agg(F.min("energy").alias("lowest"), F.max("energy").alias("highest"), F.avg("energy").alias("mean"))


def sum_densities(dos: DataFrame, keys: list[str]) -> DataFrame:
    """Projected densities (…, energy, value) summed over everything but the keys: orbitals of a kind, sites of an element, or all."""
    return dos.groupBy(*keys, "energy").agg(F.sum("value").alias("value"))


def trapezoid(series: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, area) under each series by the trapezoid rule, points in order of x."""
    w = Window.partitionBy(key).orderBy(x)
    d = series.withColumn("_nx", F.lead(x).over(w)).withColumn("_ny", F.lead(y).over(w))
    return d.groupBy(key).agg(F.sum((F.col("_nx") - F.col(x)) * (F.col("_ny") + F.col(y)) / 2).alias("area"))


def peaks(series: DataFrame, key: str, x: str, y: str, height: float) -> DataFrame:
    """Points higher than both neighbours and at least `height`."""
    w = Window.partitionBy(key).orderBy(x)
    d = series.withColumn("_p", F.lag(y).over(w)).withColumn("_n", F.lead(y).over(w))
    return d.where((F.col(y) > F.col("_p")) & (F.col(y) > F.col("_n")) & (F.col(y) >= height)).drop("_p", "_n")
