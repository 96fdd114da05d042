"""Core problems on small fixtures: units, CIF lines, nested dumps, components."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.formula import format_formula, parse_formula, reduce_counts
from lodestone.functions.units import energy_unit, energy_word
from lodestone.operators import cif_rows, flatten, unit_repair
from lodestone.operators.components import connected_components
from lodestone.operators.crystals import atomic_number

CIF = "row_id long, block_id long, line_no int, raw_line string"
HEAD = ["loop_", "_atom_site_label", "_atom_site_fract_x", "_atom_site_fract_y ", "_atom_site_fract_z", "_atom_site_occupancy"]


def block(lines, start=1):
    return [(start + i, 1, i, t) for i, t in enumerate(lines)]


def rejects(spark, rows):
    return {r.row_id: r.reason for r in cif_rows.rejected_lines(spark.createDataFrame(rows, CIF)).collect()}


def test_cif_reasons(spark):
    lines = ["data_x", "_cell_length_a 5.1(2)", "_cell_length_b -5", "_cell_length_c", *HEAD]
    sites = ["Te1 .5 +0.1 1E-1 1.", "'Te 1' 0.1 ? . 1 # it's fine", "Te3 0.1 'open 0.2 1", "Te4 0.1 0.2 0.3", "Te5 0.1 0,2 0.3 1", "Te6 0 0 0 1.2", "", "# only a comment", "Te' 0 0 0 ?"]
    got = rejects(spark, block(lines + sites))
    n = len(lines)
    assert got == {3: "out_of_range", 4: "column_count", n + 3: "quoting", n + 4: "column_count", n + 5: "bad_number", n + 6: "out_of_range"}


def test_cif_text_fields_and_second_deliveries(spark):
    rows = block(["_x", ";", "_cell_length_a bad", ";", *HEAD, "Te 0 0 0 bad"])
    rows += [(100, 1, 1, ";"), (101, 1, len(rows) - 1, "Te 0 0 0 bad")]  # delivered again, later
    assert rejects(spark, rows) == {11: "bad_number", 101: "bad_number"}


def test_cif_long_block_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(cif_rows, "CHUNK", 3)
    rows = block([*HEAD, *["Te 0 0 0 1"] * 20, "Te 0 0 0 x", ";", "Te 0 0 0 x", ";", "Te 0 0 0 y"])
    assert rejects(spark, rows) == {27: "bad_number", 31: "bad_number"}


def test_cif_columns_are_those_of_the_line_s_own_loop(spark, monkeypatch):
    lines = ["loop_", "_atom_site_label", "_atom_site_fract_x", "_atom_site_fract_y", "_atom_site_fract_z", "Te1 0 0 0", "Cs1 0.5 0.5 x"]
    lines += ["loop_", "_atom_site_aniso_label", "_atom_site_aniso_U_11", "Te1 0.01", "Cs1 0.02"]
    lines += ["loop_", "_atom_site_label", "_atom_site_occupancy", "Te2 1", "Te3 2", "Te4 0 0 0"]
    want = {7: "bad_number", 17: "out_of_range", 18: "column_count"}
    assert rejects(spark, block(lines)) == want
    monkeypatch.setattr(cif_rows, "CHUNK", 4)
    assert rejects(spark, block(lines)) == want
    assert len(cif_rows.clean_values(spark.createDataFrame(block(lines), CIF)).collect()) == 4 + 2


def test_cif_empty_and_null(spark):
    assert rejects(spark, []) == {}
    assert rejects(spark, [(1, 1, 1, None)]) == {}
    clean = cif_rows.clean_values(spark.createDataFrame(block(["_cell_length_a 5.1(2)", "_cell_length_b x"]), CIF)).collect()
    assert [(r.row_id, r.number) for r in clean] == [(1, 5.1)]


def test_units_in_text(spark):
    cases = {"eV/at.": "ev_per_atom", "milli-eV/atom": "mev_per_atom", "kJ mol^-1": "kj_per_mol", "ev (cell)": "ev_per_cell", "Hartree/unit cell": "ha_per_cell", "all energies eV, cell relaxed": "ev_per_atom", "hand-checked": None, "-1.2Ryd/at.": "ry_per_atom"}
    d = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.u for r in d.select("t", energy_unit(F.col("t")).alias("u")).collect()} == cases
    words = {"E [a.u. (Ha)]": "hartree", "Frequency (cm^-1)": "inv_cm", "omega / THz": "thz", "Energy": None}
    d = spark.createDataFrame([(k,) for k in words], "t string")
    assert {r.t: r.u for r in d.select("t", energy_word(F.col("t")).alias("u")).collect()} == words


def test_changepoints_are_optimal():
    rng = random.Random(1)
    x = np.array([rng.gauss(m, 0.3) for m in (0, 0, 3, 3, 3, 1, 1)])

    def best(n):  # all segmentations
        out = (-2.0, [])
        if n == 0:
            return out
        cand = [(best(k)[0] + ((x[k:n] - x[k:n].mean()) ** 2).sum() + 2.0, best(k)[1] + [k]) for k in range(n)]
        return min(cand)

    assert unit_repair.changepoints(x, 2.0).tolist() == best(len(x))[1]


def test_silent_calculation_takes_the_mark(spark):
    rows = [(b, "Q_1", 0, k, (1.0 + b % 3 / 10) * (1000 if b >= 20 else 1), "eV" if b < 20 else None, None) for b in range(24) for k in range(3)]
    d = spark.createDataFrame(rows, "bands_id long, label string, band int, k_idx int, energy double, unit_y string, y_label string")
    got = {r.bands_id: r.unit for r in unit_repair.band_units(d).collect()}
    assert {got[b] for b in range(20)} == {"ev"} and {got[b] for b in range(20, 24)} == {"mev"}


def calculations(units):
    """One calculation an id: (unit, stated) to three rows of about 1 eV."""
    factor = {"eV": 1, "meV": 1000}
    return [(b, "Q_1", 0, k, (1.0 + b % 3 / 10) * factor[u], u if said else None, None) for b, (u, said) in enumerate(units) for k in range(3)]


BANDS = "bands_id long, label string, band int, k_idx int, energy double, unit_y string, y_label string"
STRUCTURES = "seq long, source string, elements array<string>, formation_energy double, formation_energy_unit string, attributes map<string, struct<d: double, s: string, b: boolean, j: string, unit: string>>, note string"


def test_change_of_unit_for_good_is_seen_in_later_spans(spark, monkeypatch):
    monkeypatch.setattr(unit_repair, "SPAN", 8)
    d = spark.createDataFrame(calculations([("eV", True)] * 16 + [("meV", False)] * 48), BANDS)
    got = {r.bands_id: r.unit for r in unit_repair.band_units(d).collect()}
    assert {got[b] for b in range(16)} == {"ev"} and {got[b] for b in range(16, 64)} == {"mev"}
    seg = unit_repair.segment_histories(spark.createDataFrame([], STRUCTURES), d).collect()
    assert sorted((r.first_id, r.last_id, r.n, r.marked_unit) for r in seg) == [(0, 15, 16, "ev"), (16, 63, 48, "mev")]


def test_segments_follow_arrival_and_not_the_label(spark):
    d = spark.createDataFrame(calculations([("eV", True)] * 6 + [("meV", True)] * 6 + [("eV", True)] * 6 + [("meV", True)] * 6), BANDS)
    seg = unit_repair.segment_histories(spark.createDataFrame([], STRUCTURES), d).collect()
    assert sorted((r.first_id, r.last_id, r.marked_unit) for r in seg) == [(0, 5, "ev"), (6, 11, "mev"), (12, 17, "ev"), (18, 23, "mev")]


def test_structures_without_a_unit_are_no_base(spark):
    rows = [(i, "A", ["Te"], -(1.0 + i % 3 / 10) * (1000 if i < 20 else 1), None if i < 20 else "eV/atom", None, None) for i in range(24)]
    bands = spark.createDataFrame([], BANDS)
    seg = unit_repair.segment_histories(spark.createDataFrame(rows, STRUCTURES), bands).collect()
    assert sorted((r.first_id, r.last_id, r.marked_unit) for r in seg) == [(0, 19, "mev"), (20, 23, "ev")]


def test_flatten_layouts(spark):
    a = {"attributes": [{"name": "bandGap", "value": "", "unit": None}, {"name": "x", "value": None}], "sites": [{"element": "Te", "siteIndex": 7, "properties": {"partialCharge": 1.0, "m": None}, "neighbours": {"0": {"element": "Cs"}, "1": {"element": "Te"}}}, {"element": "Cs", "neighbours": {"element": "Te", "distance": 2.0}}]}
    b = {"structure": {"elements": ["Te", "Cs"], "positions": [[0, 0, 0], [1, 1, 1]]}, "attributes": json.dumps({"formationEnergy": {"value": -1, "unit": "eV"}}), "siteAttributes": {"magmom": [None, 2.0]}, "extras": json.dumps({"coordination": {"sites": [{"site_index": 1, "neighbours": [{"element": "Te"}]}]}})}
    d = spark.createDataFrame([(1, json.dumps(a)), (2, json.dumps(b)), (3, None), (4, ""), (5, "{}")], "dump_id long, payload string")
    got = {(r.dump_id, r.child_table, r.parent_key, r.child_key) for r in flatten.flatten_dumps(d).collect()}
    assert got == {
        (1, "attribute", "", "band_gap"), (1, "site", "", "7"), (1, "site", "", "1"), (1, "site_value", "7", "partial_charge"), (1, "neighbour", "7", "0"), (1, "neighbour", "7", "1"), (1, "neighbour", "1", "0"),
        (2, "attribute", "", "formation_energy"), (2, "site", "", "0"), (2, "site", "", "1"), (2, "site_value", "1", "magmom"), (2, "neighbour", "1", "0"),
    }


@pytest.mark.parametrize("text,want", [("Cs 3 Te 1", {"Cs": 3, "Te": 1}), ("Sb_{8}Cd", {"Sb": 8, "Cd": 1}), ("Ca(OH)2", {"Ca": 1, "O": 2, "H": 2}), ("CuSO4·5H2O", {"Cu": 1, "S": 1, "O": 9, "H": 10}), ("?", None), ("", None), (None, None)])
def test_formula(text, want):
    assert parse_formula(text) == want


def test_formula_reduce_and_symbols():
    assert reduce_counts({"Cs": 1.0, "Te": 0.5, "O": 0}) == {"Cs": 2, "Te": 1}
    assert format_formula({"Te": 1, "Cs": 2}) == "Cs2Te"
    assert [atomic_number(x) for x in ("TE", " te", "Te3", "Te2-", "D", "", None, "Xx")] == [52, 52, 52, 52, 1, 0, 0, 0]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in parent}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
