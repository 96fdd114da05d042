"""Quantities recorded on different scales: what scale each record is on, and all values on the common one.

A unit stated in text decides (own column, attribute, text of the value, note, axis label). Beside it every source's history is segmented: the
logarithms of the values, in order of arrival, are cut by exact penalised changepoint search on spans, whose segments are joined at the borders, and
level shifts that match a known factor mark the unit of a segment. Calculations that state no unit anywhere take the mark; see README.md for why stated units decide otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import units as U
from lodestone.operators.crystals import FRACTION_LIMIT
from lodestone.session import Scratch

SPAN = 4096  # arrival numbers that one search takes, so that a source with a third of all rows is searched by many tasks


def with_energy(structures: DataFrame) -> DataFrame:
    """structures with _energy, _unit and _stated: the real formation energy (null if there is none), its unit, and whether a text states it.

    The column counts first, then the attribute's number, then its text. The unit is the column's, the attribute's, the one in the
    value's text, or the one in the note, for a value of the column; a value of the attribute asks the attribute first. None anywhere is eV per atom.
    """
    d = structures.withColumn("_a", F.col("attributes")["formation_energy"])
    d = d.withColumn("_c", U.real_number(F.col("formation_energy"))).withColumn("_d", U.real_number(F.col("_a.d"))).withColumn("_s", U.real_number(U.number_in(U.real_text(F.col("_a.s")))))
    own, of_attribute, note = F.col("formation_energy_unit"), F.col("_a.unit"), F.col("note")
    of_text = F.when(F.col("_s").isNotNull(), F.regexp_replace(F.col("_a.s"), r"(?i)^\s*e_?f\s*=", ""))
    texts = F.when(F.col("_c").isNotNull(), F.array(own, of_attribute, of_text, note)).when(F.col("_d").isNotNull(), F.array(of_attribute, own, note)).otherwise(F.array(of_text, of_attribute, own, note))
    d = d.withColumn("_unit", U.energy_unit(F.get(F.filter(texts, U.states_energy), F.lit(0))))
    return d.withColumn("_energy", F.coalesce("_c", "_d", "_s")).withColumn("_stated", F.col("_unit").isNotNull()).withColumn("_unit", F.coalesce("_unit", F.lit("ev_per_atom"))).drop("_a", "_c", "_d", "_s")


def stated_energies(structures: DataFrame) -> DataFrame:
    """(seq, source, n, energy, unit, stated): see `with_energy`; n: number of sites."""
    n = F.greatest(F.size("elements"), F.lit(0)).alias("n")
    return with_energy(structures).select(F.col("seq").cast("long").alias("seq"), "source", n, F.col("_energy").alias("energy"), F.col("_unit").alias("unit"), F.col("_stated").alias("stated"))


def fractional(positions: str = "positions", cell: str = "cell") -> F.Column:
    """Whether positions are fractions of the cell, from the numbers (see crystals.FRACTION_LIMIT); false without a cell or positions."""
    reach = F.array_max(F.transform(F.flatten(positions), lambda x: F.abs(x)))
    return F.coalesce((F.size(cell) == 3) & (reach <= FRACTION_LIMIT), F.lit(False))


def band_statements(output_bands: DataFrame) -> DataFrame:
    """One row for each calculation: (bands_id, source, unit, n, level): the stated unit or null, and count and mean log10 of |energy|.

    Grouping on the texts themselves lets each task combine its rows first: repeated texts of a calculation are one row in the shuffle.
    """
    e = F.abs("energy")
    logs = F.when((e > 0) & ~F.isnan("energy"), F.log10(e))
    texts = output_bands.groupBy("bands_id", "label", "unit_y", "y_label").agg(F.count(logs).alias("n"), F.sum(logs).alias("s"))
    # numbers can be combined in hash maps, texts can't: units as places in a list
    order = ["ev", "mev", "hartree", "rydberg", "thz", "inv_cm"]
    code = lambda c: F.array_position(F.array(*map(F.lit, order)), U.energy_word(F.col(c)))
    found = F.coalesce(F.nullif(code("unit_y"), F.lit(0)), F.nullif(code("y_label"), F.lit(0)) + 100)
    per = texts.groupBy("bands_id").agg(F.min(found).alias("u"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.min(F.xxhash64(F.regexp_extract("label", r"^([A-Za-z-]+)", 1))).alias("source"))
    unit = F.element_at(F.array(*map(F.lit, order)), F.when(F.col("u") > 100, F.col("u") - 100).otherwise(F.col("u")).cast("int"))
    return per.select(F.col("bands_id").cast("long").alias("bands_id"), "source", F.when(F.col("u").isNotNull(), unit).alias("unit"), "n", (F.col("s") / F.col("n")).alias("level"))


def changepoints(x: np.ndarray, penalty: float) -> np.ndarray:
    """Starts of the segments that minimise squared error plus `penalty` a segment: exact, by pruned optimal partitioning."""
    n = len(x)
    c1, c2 = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    best, last, live = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), np.zeros(1, np.int64)
    best[0] = -penalty
    for t in range(1, n + 1):
        cost = best[live] + (c2[t] - c2[live]) - (c1[t] - c1[live]) ** 2 / (t - live)
        k = int(cost.argmin())
        best[t], last[t] = cost[k] + penalty, live[k]
        live = np.append(live[cost <= best[t]], t)
    starts, t = [], n
    while t > 0:
        t = int(last[t])
        starts.append(t)
    return np.array(starts[::-1], np.int64)


#: log10 of a value in each unit over the value in eV.
SHIFTS = {k: -np.log10(v) for k, v in U.EV.items()}
SEGMENT_DDL = "table_name string, source string, span long, segment int, first_id long, last_id long, n long, level double, shift double, marked_unit string"
PART_DDL = "source string, span long, segment int, last boolean, first_id long, last_id long, n long, level double, silent array<long>"
STRUCTURE_UNITS = ["ev", "mev", "hartree", "rydberg", "kj_per_mol", "kcal_per_mol"]
BAND_UNITS = ["ev", "mev", "hartree", "rydberg", "thz", "inv_cm"]


def _parts(penalty: float):
    """Exact segments of one span of a source's history, in order of arrival, and the ids in each that state no unit."""

    def solve(h: pd.DataFrame) -> pd.DataFrame:
        h = h.sort_values(["id", "level"], kind="stable")
        x, ids, silent = h.level.to_numpy(), h.id.to_numpy(), (h.stated == "~").to_numpy()
        at = changepoints(x, penalty)
        end = np.append(at[1:], len(x))
        rows = [(h.source.iloc[0], int(h.span.iloc[0]), k, k == len(at) - 1, int(ids[a]), int(ids[b - 1]), int(b - a), x[a:b].mean(), ids[a:b][silent[a:b]].tolist()) for k, (a, b) in enumerate(zip(at, end))]
        return pd.DataFrame(rows, columns=["source", "span", "segment", "last", "first_id", "last_id", "n", "level", "silent"])

    return solve


def _borders(penalty: float):
    """Of one source's first and last segments of each span: those that go on a segment of an earlier span, and that segment."""

    def join(h: pd.DataFrame) -> pd.DataFrame:
        out, held = [], None
        for r in h.sort_values(["span", "segment"]).itertuples():
            if r.segment == 0 and held is not None:
                n, level, span, segment = held
                # what one segment less saves must make up for the squared error that joining adds
                if n * r.n / (n + r.n) * (level - r.level) ** 2 <= penalty:
                    out.append((r.source, r.span, r.segment, span, segment))
                    held = (n + r.n, (n * level + r.n * r.level) / (n + r.n), span, segment)
                    continue
            held = (r.n, r.level, r.span, r.segment)
        return pd.DataFrame(out, columns=["source", "span", "segment", "to_span", "to_segment"])

    return join


def _history(rows: DataFrame, table: str, allowed: list[str], penalty: float, near: float) -> DataFrame:
    """Segments of SEGMENT_DDL and `silent`, the ids that state no unit. rows: (source, id, stated, level), stated '' for eV and '~' for no unit.

    Each source's history is in order of arrival. Spans are solved exactly; the last segment of a span and the first of the next are one if that costs less,
    over any number of spans. The base is the median level of all records of the source that state eV, or of all its records if fewer than 3 do.
    """
    scratch = Scratch(rows.sparkSession, "histories")
    rows = scratch.keep(rows)
    parts = scratch.keep(rows.withColumn("span", F.floor(F.col("id") / SPAN)).groupBy("source", "span").applyInPandas(_parts(penalty), PART_DDL))
    ends = parts.where("segment = 0 or last").select("source", "span", "segment", "n", "level")
    moved = ends.groupBy("source").applyInPandas(_borders(penalty), "source string, span long, segment int, to_span long, to_segment int")
    ev = F.when(F.col("stated") == "", F.col("level"))
    middle = lambda c: F.percentile_approx(c, 0.5, 10_000)
    base = rows.groupBy("source").agg(F.when(F.count(ev) >= 3, middle(ev)).otherwise(middle("level")).alias("base"))
    whole = parts.join(moved, ["source", "span", "segment"], "left").groupBy("source", F.coalesce("to_span", "span").alias("span"), F.coalesce("to_segment", "segment").alias("segment"))
    whole = whole.agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n").alias("n"), (F.sum(F.col("level") * F.col("n")) / F.sum("n")).alias("level"), F.flatten(F.collect_list("silent")).alias("silent"))
    whole = whole.join(base, "source").withColumn("shift", F.col("level") - F.col("base"))
    best = F.array_min(F.array(*[F.struct(F.abs(F.lit(float(SHIFTS[u])) - F.col("shift")).alias("off"), F.lit(i).alias("i"), F.lit(u).alias("unit")) for i, u in enumerate(allowed)]))
    marked = F.when(best["off"] <= near, best["unit"])
    return whole.select(F.lit(table).alias("table_name"), "source", "span", "segment", "first_id", "last_id", "n", "level", "shift", marked.alias("marked_unit"), "silent")


def _band_history(per: DataFrame) -> DataFrame:
    stated = F.when(F.col("unit") == "ev", "").otherwise(F.coalesce("unit", F.lit("~")))
    return per.where("level is not null and bands_id is not null").select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("bands_id").alias("id"), stated.alias("stated"), "level")


def segment_histories(structures: DataFrame, output_bands: DataFrame, penalty: float = 2.0, near: float = 0.25) -> DataFrame:
    """Segments of every source's history of formation energies and band energies with their level shifts and marked units.

    A segment is named by the span and place in it where it starts. Values of 0, nulls and stand-ins have no level and no place in a history, nor have
    records without a number of arrival. Energies per cell are divided by their sites first where that is stated.
    """
    s = stated_energies(structures)
    per_cell = F.when(F.col("unit").endswith("_per_cell"), F.col("n")).otherwise(1)
    unit = F.when(F.col("unit") == "ev_per_atom", F.when(F.col("stated"), "").otherwise("~")).otherwise(F.col("unit"))
    s = s.where("energy <> 0 and seq is not null").select(
        F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), F.col("seq").alias("id"), unit.alias("stated"), F.log10(F.abs("energy") / F.greatest(per_cell, F.lit(1))).alias("level")
    )
    e = _history(s, "structures", STRUCTURE_UNITS, penalty, near)
    return e.unionByName(_history(_band_history(band_statements(output_bands)), "output_bands", BAND_UNITS, penalty, near)).drop("silent")


def band_units(output_bands: DataFrame, penalty: float = 2.0, near: float = 0.25) -> DataFrame:
    """(bands_id, unit): stated, or else marked by the level shift of the segment of the history that the calculation lies in; 'ev' if neither."""
    per = Scratch(output_bands.sparkSession, "band-statements").keep(band_statements(output_bands))
    hist = _band_history(per)
    # only sources with calculations that state no unit need segments
    need = hist.join(hist.where("stated = '~'").select("source").distinct(), "source", "left_semi")
    marked = _history(need, "output_bands", BAND_UNITS, penalty, near).select(F.explode("silent").alias("bands_id"), F.col("marked_unit").alias("marked"))
    stated = per.where("unit is not null").select("bands_id", "unit")
    silent = per.where("unit is null").join(marked.hint("merge"), "bands_id", "left").select("bands_id", F.coalesce("marked", F.lit("ev")).alias("unit"))
    return stated.union(silent)


def off_scale(structures: DataFrame, output_bands: DataFrame) -> DataFrame:
    """(table_name, record_id, quantity, found_unit): one row for each quantity that isn't in eV per atom, Cartesian angstrom or eV.

    Null seq or bands_id are left out. Repeated rows of structures give repeated rows; repeated rows of a calculation count once. Empty tables give no rows.
    """
    one = structures.where("seq is not null")
    a = _structure_quantities(one)
    b = band_units(output_bands).where("unit <> 'ev' and bands_id is not null").select(F.lit("output_bands").alias("table_name"), F.col("bands_id").alias("record_id"), F.lit("energy").alias("quantity"), F.col("unit").alias("found_unit"))
    return a.unionByName(b)


def _structure_quantities(structures: DataFrame) -> DataFrame:
    """Both quantities of structures in one scan."""
    rows = with_energy(structures).select(F.col("seq").cast("long").alias("record_id"), F.col("_energy").alias("energy"), F.col("_unit").alias("unit"), fractional().alias("_fractional"))
    what = F.array(
        F.when(F.col("energy").isNotNull() & (F.col("unit") != "ev_per_atom"), F.struct(F.lit("formation_energy").alias("quantity"), F.col("unit").alias("found_unit"))),
        F.when(F.col("_fractional"), F.struct(F.lit("positions").alias("quantity"), F.lit("fractional").alias("found_unit"))),
    )
    return rows.select(F.lit("structures").alias("table_name"), "record_id", F.explode(F.array_compact(what)).alias("q")).select("table_name", "record_id", "q.quantity", "q.found_unit")


def common_structures(structures: DataFrame) -> DataFrame:
    """(seq, formation_energy_ev_atom, positions_angstrom): formation energies in eV per atom and Cartesian positions in angstrom."""
    n = F.greatest(F.size("elements"), F.lit(0))
    row = lambda p, k: sum(p[i] * F.col("cell")[i][k] for i in range(3))
    cart = F.transform("positions", lambda p: F.array(*[row(p, k) for k in range(3)]))
    return with_energy(structures).select(
        F.col("seq").cast("long").alias("seq"), (F.col("_energy") * U.ev_per_atom_factor(F.col("_unit"), n)).alias("formation_energy_ev_atom"), F.when(fractional(), cart).otherwise(F.col("positions")).alias("positions_angstrom"),
    )


def common_bands(output_bands: DataFrame) -> DataFrame:
    """All rows of output_bands with `energy_ev`. The units are one small row a calculation; the join is on bands_id, of which none is large, and
    merges sorted rows: the calculations grow with the table, so they must not be gathered on the driver for a broadcast."""
    unit = band_units(output_bands).select("bands_id", U.ev_factor(F.col("unit")).alias("_f")).hint("merge")
    return output_bands.join(unit, "bands_id", "left").withColumn("energy_ev", F.col("energy") * F.col("_f")).drop("_f")
