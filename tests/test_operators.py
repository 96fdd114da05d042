"""Operators and functions on small fixtures: odd rows, known values, brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import elements as E
from lodestone.functions import formula_columns as FC
from lodestone.functions import geometry as G
from lodestone.functions import quantities as Q
from lodestone.operators import access, bands, compare, features, graphs, manipulate, neighbours, series, site_geometry
from lodestone.operators.voronoi import area, solid_angle, voronoi_faces

DDL = "seq long, label string, elements array<string>, kinds array<string>, positions array<array<double>>, cell array<array<double>>, attributes map<string, struct<d: double, s: string, b: boolean, j: string, unit: string>>, extra string"
A = 5.65
ZINCBLENDE = [[0.0, A / 2, A / 2], [A / 2, 0.0, A / 2], [A / 2, A / 2, 0.0]]
WATER = (["O", "H", "H"], [[0.0, 0.0, 0.0], [0.757, 0.586, 0.0], [-0.757, 0.586, 0.0]])


def structures(spark, rows):
    return spark.createDataFrame([(i, f"s{i}", *r[:1], None, *r[1:], None, "x") for i, r in enumerate(rows)], DDL)


@pytest.fixture(scope="module")
def odd(spark):
    return structures(spark, [
        (["Ga", "As"], [[0.0, 0.0, 0.0], [0.25, 0.25, 0.25]], ZINCBLENDE), (*WATER, None), (None, None, None), ([], [], None), (["Te"], [[0.0, 0.0]], None), (["Te", "Cs"], [[0.0, 0.0, 0.0]], None),
        (["Te"], [[float("nan"), 0.0, 0.0]], ZINCBLENDE), (["Te"], [[0.0, 0.0, 0.0]], [[0.0, 0.0, 0.0]] * 3), (["??"], [[0.1, 0.1, 0.1]], ZINCBLENDE), ([None], [[0.1, 0.1, 0.1]], ZINCBLENDE),
    ])


EVERY = [
    lambda s: neighbours.pairs(s, 4.0), lambda s: neighbours.coordination_sites(s, "econ", 5.0), lambda s: neighbours.coordination_sites(s, "voronoi", 8.0), lambda s: neighbours.coordination_statistics(s, "atomic_radius", 5.0),
    lambda s: neighbours.pair_distribution(s, 4.0, 0.5), lambda s: neighbours.fingerprints(s, 4.0, 0.5, 0.6), lambda s: neighbours.site_fingerprints(s, 4.0, 0.5, 0.6), lambda s: neighbours.order_parameter(s, 4.0, 0.5, 0.6),
    lambda s: neighbours.warren_cowley(s, 2, 6.0), lambda s: site_geometry.site_distances(s), lambda s: site_geometry.site_angles(s), lambda s: site_geometry.site_dihedrals(s, 0, 1, 2, 3),
    lambda s: compare.equivalent_sites(s, r_max=5.0), lambda s: compare.equivalent_sites_by_fingerprint(s, 1e-3, 4.0, 0.5, 0.6), lambda s: compare.find_duplicates_by_fingerprint(s, 1e-3, 4.0, 0.5, 0.6),
    lambda s: manipulate.delete_atoms(s, ["Te"], [1]), lambda s: manipulate.substitute_elements(s, [("Ga", "Al")]), lambda s: manipulate.scale_unit_cell(s, [1.1, 1.0, 0.9]), lambda s: manipulate.create_supercell(s, [1, 2, 1]),
    lambda s: manipulate.translate_structure(s, [1, 0, 0]), lambda s: manipulate.rotate_structure(s, [10, 20, 30]), lambda s: manipulate.add_structure_position(s, [1, 1, 1], "H2O", 0.5), lambda s: manipulate.add_structure_random(s, "H", 0.5, 8),
    lambda s: manipulate.scale_unit_cell(s, random=(0.9, 1.1), seed=3), lambda s: graphs.fragments(s, 2.5), lambda s: graphs.hydrogen_bonds(s), lambda s: features.composition(s, ["Ga", "O"]), lambda s: features.density(s, ["Ga"]),
    lambda s: features.coordination(s, ["Ga", "As"], r_max=5.0), lambda s: features.fingerprint(s, ["As", "Ga"], 4.0, 0.5, 0.6), lambda s: features.pair_distribution(s, ["As", "Ga"], 4.0, 0.5), lambda s: features.coulomb_matrix(s),
    lambda s: features.chemical_order(s, ["As", "Ga"], 1, 6.0), lambda s: features.stratified_split(s, F.size("elements")), lambda s: access.Constraints().formula("GaAs").attribute("x", 0.0).apply(s), lambda s: access.slice_structures(s, 1, 5, 2),
    lambda s: access.elements_of(s), lambda s: access.kinds_of(s), lambda s: access.attribute_keys(s), lambda s: access.union(s, s), lambda s: access.duplicate_structure(s, "s0", "new"), lambda s: access.set_attribute(s, "gap", F.lit(1.0), "eV"),
]


@pytest.mark.parametrize("k", range(len(EVERY)))
def test_odd_rows_and_empty_tables_do_not_crash(spark, odd, k):
    EVERY[k](odd).collect()
    assert EVERY[k](odd.limit(0)).count() == 0


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    cell = np.array([[4.0, 0.3, 0.0], [0.0, 3.5, 0.2], [1.0, 0.0, 5.0]])
    frac = rng.random((5, 3))
    got = neighbours.pairs(structures(spark, [(["Cs", "Te", "Cs", "O", "O"], frac.tolist(), cell.tolist())]), 6.0).toPandas()
    want = []
    for i, j in itertools.product(range(5), repeat=2):
        for shift in itertools.product(range(-5, 6), repeat=3):
            d = np.linalg.norm((frac[j] + shift - frac[i]) @ cell)
            if d <= 6.0 and (i != j or any(shift)):
                want.append((i, j, d))
    assert len(got) == len(want)
    assert np.allclose(sorted(got.distance), sorted(w[2] for w in want))


def test_coordination_of_zincblende(spark, odd):
    for method, cn in (("minimum_distance", 4), ("atomic_radius", 4), ("econ", 4), ("voronoi", 4)):
        got = neighbours.coordination_sites(odd.where("seq = 0"), method, 10.0).collect()
        assert [r.total_cn for r in got] == [cn, cn] and all(abs(n.distance - A * math.sqrt(3) / 4) < 1e-6 for r in got for n in r.neighbours)
    s = {(r.element, r.nbr_element): r for r in neighbours.coordination_statistics(odd.where("seq = 0"), "minimum_distance").collect()}
    assert s["Ga", "As"].nrs_avg == 4 and s["Ga", "As"].distance_stdev < 1e-9 and s["Ga", "Ga"].nrs_max == 0 and s["Ga", "Ga"].distance_avg is None
    w = {(r.element, r.shell): r.value for r in neighbours.warren_cowley(odd.where("seq = 0"), 1, 8.0).collect()}
    # four hexagons to the other element and twelve small triangles to the own one
    assert 0.5 < w["Ga", 1] < 1.0 and abs(w["Ga", 1] - w["As", 1]) < 1e-6


def test_voronoi_cells_fill_space():
    rng = np.random.default_rng(3)
    frac, cell = rng.random((4, 3)), np.array([[4.0, 0, 0], [1.0, 4.5, 0], [0, 0.5, 5.0]])
    shifts = np.array(list(itertools.product(range(-3, 4), repeat=3)))
    total = 0.0
    for i in range(4):
        steps = ((frac[None] + shifts[:, None] - frac[i]) @ cell).reshape(-1, 3)
        steps = steps[np.linalg.norm(steps, axis=1) > 1e-9]
        steps = steps[np.argsort(np.linalg.norm(steps, axis=1))]
        faces = voronoi_faces(steps, 20.0)
        assert abs(sum(solid_angle(p) for p in faces.values()) - 4 * math.pi) < 1e-6
        total += sum(area(p) * np.linalg.norm(steps[k]) / 2 / 3 for k, p in faces.items())
    assert abs(total - abs(np.linalg.det(cell))) < 1e-6


def test_geometry_of_water(spark, odd):
    one = odd.where("seq = 1")
    assert abs(site_geometry.site_angles(one, 0, 1, 2).collect()[0].angle - 104.5) < 0.1
    assert {(r.site_1, r.site_2) for r in site_geometry.site_distances(one, [0, 1], [1, 2]).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert site_geometry.site_tuples([[0, 1], None]) == [(0, 1)]
    box = structures(spark, [(["H", "H"], [[0.0, 1.0, 0.0], [0.0, 9.0, 0.0]], [[2.0, 0.0, 0.0], [0.0, 10.0, 0.0], [0.0, 0.0, 2.0]])])
    assert abs(site_geometry.site_distances(box).collect()[0].distance - 2.0) < 1e-9
    assert abs(site_geometry.site_distances(box, fold=False).collect()[0].distance - 8.0) < 1e-9
    bent = structures(spark, [(["H", "O", "O", "H"], [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 1.0, 1.0]], None)])
    assert abs(site_geometry.site_dihedrals(bent, 0, 1, 2, 3).collect()[0].dihedral - 90) < 1e-9


def test_vector_expressions(spark):
    v = lambda *x: F.array(*[F.lit(float(k)) for k in x])
    square = F.array(v(0, 0, 0), v(2, 0, 0), v(2, 2, 0), v(0, 2, 0))
    octant = F.array(v(1, 0, 0), v(0, 1, 0), v(0, 0, 1))
    r = spark.range(1).select(
        G.angle(v(1, 0, 0), v(1, 1, 0)).alias("angle"), G.plane(v(0, 0, 1), v(1, 0, 1), v(0, 1, 1)).alias("plane"), G.polygon_area(square).alias("area"), G.solid_angle(v(0, 0, 0), octant).alias("solid"),
        G.circular_segment_area(F.lit(1.0), F.lit(0.0)).alias("half"), G.circular_segment_area(F.lit(1.0), F.lit(2.0)).alias("none"), G.reflection_matrix(v(0, 0, 2)).alias("mirror"), G.independent_vector(v(1, 0, 0)).alias("ind"),
        G.gaussian(F.lit(0.0), 0.0, 2.0).alias("g"), G.cell_from_parameters(*[F.lit(x) for x in (3.0, 4.0, 5.0, 90.0, 90.0, 90.0)]).alias("cell"), G.angle(v(0, 0, 0), v(1, 0, 0)).alias("no"),
    ).first()
    assert abs(r.angle - math.pi / 4) < 1e-12 and r.plane == [0, 0, 1, -1] and r.area == 4 and abs(r.solid - math.pi / 2) < 1e-12
    assert abs(r.half - math.pi / 2) < 1e-12 and r.none is None and r.mirror == [[1, 0, 0], [0, 1, 0], [0, 0, -1]] and r.ind == [1, 1, 0]
    assert abs(r.g - 1 / (2 * math.sqrt(2 * math.pi))) < 1e-12 and np.allclose(r.cell, np.diag([3.0, 4.0, 5.0])) and r.no is None


UNIT_CASES = [
    ("m", 1.0, "mm", 1000.0), ("angstrom", 23.0, "ev", 539.061732318262), ("hartree", 10.0, "angstrom", 45.563352473376504), ("hartree", -0.001834, "kj_per_mol", -4.815166344697022), ("eV", 1.0, "micro_m", 1.2398419843320025),
    ("kHz", 2.0, "m", 149896.229), ("m", 0.057652395769230765, "GHz", 5.2), ("m", 13.2, "m-1", 0.47599888690754444), ("eV", 1.0, "THz", 241.79892420849183), ("eV", 1.0, "micro_m-1", 5.067730716156396), ("THz", 1.0, "micro_m-1", 0.020958450219516814),
]


def test_unit_conversion(spark):
    for u1, x, u2, y in UNIT_CASES:
        assert math.isclose(Q.convert(x, u1, u2), y, rel_tol=1e-9)
        assert math.isclose(Q.convert(y, u2, u1), x, rel_tol=1e-9)
    r = spark.range(1).select(*[Q.convert_units(F.lit(x), u1, u2).alias(f"c{k}") for k, (u1, x, u2, _) in enumerate(UNIT_CASES)], Q.convert_units(F.lit(0.0), "m", "eV").alias("none")).first()
    assert all(math.isclose(r[k], y, rel_tol=1e-9) for k, (_, _, _, y) in enumerate(UNIT_CASES)) and r.none is None
    for bad in (("eV", "nothing"), ("eV", "Pa")):
        with pytest.raises(ValueError):
            Q.conversion(*bad)
    assert Q.constant("C") == 299792458.0 and Q.constant_unit("kb") == "JK-1"


def test_elements(spark):
    rows = [("te",), ("TELLURIUM",), ("52",), ("Xx",), (None,), ("0",), ("119",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "e string").select(E.element_symbol(F.col("e")), E.atomic_number(F.col("e")), E.atomic_radius(F.col("e")), E.atomic_mass(F.col("e")), E.valence_electrons(F.col("e")), E.electronegativity(F.col("e"), "allen")).collect()]
    assert got[:3] == [("Te", 52, 1.38, 127.6, 6, 2.158)] * 3 and got[3:] == [(None,) * 6] * 4
    assert all(len(t) == 118 for t in [*E.RADII.values(), *E.SCALES.values(), E.MASSES, E.VALENCE_ELECTRONS, E.NAMES])
    assert E.groups_of("Sb") == ["metalloid", "non-metal", "pnictogen"] and E.groups_of("Fe") == ["metal", "transition metal"] and E.members("halogen") == ["F", "Cl", "Br", "I", "At", "Ts"]
    with pytest.raises(ValueError):
        E.members("nonsense")


def test_formulas(spark):
    texts = ["HOH", "H.5(CO)CH3{OH[CH]4}3.5", "Fe2O3", "", None, "@Cs2Te", "Cs(OH"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.m for r in d.select("i", FC.parse(F.col("t")).alias("m")).collect()}
    assert got[0] == {"H": 2.0, "O": 1.0} and got[1] == {"C": 16.0, "O": 4.5, "H": 21.0} and got[2] == {"Fe": 2.0, "O": 3.0} and got[3] == {} and got[4] is None and got[5] == {"Cs": 2.0, "Te": 1.0} and got[6] == {}
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    r = spark.range(1).select(
        FC.to_text(m(Fe=2.0, O=3.5, H=1.0)).alias("t"), FC.to_latex(m(Fe=2.0, O=1.0)).alias("l"), FC.reduce_formula(m(Fe=4.0, O=6.0)).alias("r"), FC.reduce_formula(m(Fe=0.33333, O=0.66667)).alias("f"),
        FC.reduce_formula(m(Fe=7.0)).alias("one"), FC.same_formula(m(A=2.0, B=4.0), m(B=2.0, A=1.0), True).alias("same"), FC.same_formula(m(A=2.0, B=4.0), m(B=2.0, A=1.0)).alias("not"), FC.list_to_text(F.array(*map(F.lit, "HOH"))).alias("h"),
    ).first()
    assert (r.t, r.l, r.r, r.f, r.one, r.same, r["not"], r.h) == ("Fe2O3.5H", "$\\mathrm{Fe}_\\mathrm{2}\\mathrm{O}$", {"Fe": 2, "O": 3}, {"Fe": 1, "O": 2}, {"Fe": 1}, True, False, "H2O")


def test_duplicates_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(6):
        x = rng.random((4, 3))
        for noise in (0.0, 0.0, 1e-4, 0.05):
            rows.append((["Cs", "Cs", "Te", "O"], (x + noise * rng.normal(size=x.shape)).tolist(), (np.eye(3) * 6).tolist()))
    s = structures(spark, rows)
    v = {r.seq: np.array(r.vector) for r in compare.fingerprint_vectors(s, 6.0, 0.5, 0.6).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(v), 2):
        if 0.5 * (1 - v[a] @ v[b]) <= 1e-3:
            want.setdefault(b, a)
    assert {r.seq: r.duplicate_of for r in compare.find_duplicates_by_fingerprint(s, 1e-3, 6.0, 0.5, 0.6).collect()} == want and len(want) >= 6


def test_series_and_hulls(spark):
    assert series.limit_axis([0.5, 1.0, 2.0, 5.0], 1.0, 3.0).tolist() == [1.0, 2.0, 3.0]
    g = series.gaussian_axis(-1.0, 1.0, 0.1, 5, 0.0, 0.5)
    assert g[0] <= -1 and g[-1] >= 1 and 0.0 in g and np.diff(g).min() > 0.099 and np.diff(g).max() <= 0.6 + 1e-9
    assert series.exponential_axis(0.0, 2.0, 0.5, 3, 1.0)[-1] >= 2.0 and series.uniform_axis(0, 1, 0.5).tolist() == [0, 0.5, 1.0] and series.join_axes([0, 1], [1, 2]).tolist() == [0, 1, 2]
    assert series.grid(np.array([0.0]), np.array([1.0, 2.0]), np.array([0.5])) == [(0.0, [1.0, 0.5])]
    y = [0.0, 0, 1, 0, 0, 3, 0]
    got = spark.range(1).select(series.smooth(F.array(*map(F.lit, y)), 0.8).alias("s"), series.smooth(F.array().cast("array<double>"), 0.8).alias("e")).first()
    w = np.array(series.kernel(0.8))
    assert np.allclose(got.s, np.convolve(y, w, mode="same")) and got.e == [] and np.allclose(neighbours.smooth(np.array(y), 0.8), np.convolve(y, w, mode="same"))
    rng = np.random.default_rng(1)
    pts = [("a", float(x), float(v)) for x, v in zip(np.r_[0, 1, rng.random(300)], np.r_[0, 0, -rng.random(300)])]
    hull = {(r.x, r.y) for r in series.convex_hull(spark.createDataFrame(pts, "key string, x double, y double").repartition(5), "key", "x", "y").collect()}
    line = sorted(hull)
    for _, x, v in pts:
        k = max(i for i in range(len(line)) if line[i][0] <= x)
        k = min(k, len(line) - 2)
        (x0, y0), (x1, y1) = line[k], line[k + 1]
        assert v >= y0 + (y1 - y0) * (x - x0) / (x1 - x0) - 1e-12
    assert series.convex_hull(spark.createDataFrame([], "key string, x double, y double"), "key", "x", "y").count() == 0
    areas, heights = F.array(F.lit(0.5), F.lit(2.5)), [[1.0, 0.25], [3.0, 2.0]]
    r = spark.range(1).select(series.fingerprint_counts(areas, heights).alias("c"), series.fingerprint_bits(areas, heights).alias("b"), series.tanimoto(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1))).alias("t")).first()
    assert r.c == [1, 1] and r.b == [0, 0, 1, 1] and r.t == 0.5


def test_pipeline_registry_and_sizes(spark, odd):
    out = manipulate.run_pipeline(odd.where("seq = 0"), [(manipulate.scale_unit_cell, {"factors": 2.0}), (manipulate.delete_atoms, {"elements": ["As"]}, [0, 1])])
    got = {r.label: (r.elements, r.cell[0][1]) for r in out.collect()}
    assert got == {"s0x0": (["Ga", "As"], A), "s0x1": (["Ga"], A)}
    assert "coordination_sites" in access.list_methods("analysis") and access.perform(odd, "analysis", "pair_distribution", r_max=3.0, delta=0.5).count() > 0
    with pytest.raises(ValueError):
        access.perform(odd, "analysis", "nothing")
    assert features.split_sizes(10, test=0.25) == (7, 3) and features.split_sizes(10, train=6, test=2) == (6, 2)
    with pytest.raises(ValueError):
        features.split_sizes(10, train=9, test=2)
    parts = features.stratified_split(spark.range(2000).withColumnRenamed("id", "seq"), F.col("seq") % 2, 0.25).groupBy("stratum", "part").count().toPandas()
    assert all(200 < n < 300 for n in parts[parts.part == "test"]["count"])
    one = odd.where("seq = 0")
    assert {tuple(r.features) for r in features.composition(one, ["As", "Ga", "O"]).collect()} == {(0.5, 0.5, 0.0)}
    assert access.Constraints().formula("Ga2As2").concentration("Ga", 0.4, 0.6).neglect_elemental().apply(odd).count() == 1 and access.Constraints().formula("GaAs").remove().apply(odd).count() == 10
    assert manipulate.rotation(90.0, [0, 0, 2])[0][1] == pytest.approx(-1) and [r.positions for r in manipulate.rotate_structure(odd.where("seq = 1"), 180.0, [0, 1, 0], [0, 0, 0]).collect()][0][1] == pytest.approx([-0.757, 0.586, 0.0])
    a = {r.seq: r.positions for r in manipulate.add_structure_random(one, "H", 0.5, 16, seed=1).collect()}
    assert a == {r.seq: r.positions for r in manipulate.add_structure_random(one.repartition(3), "H", 0.5, 16, seed=1).collect()} and len(a[0]) == 3


def test_gaps(spark):
    ddl = "bands_id long, spin string, band int, k_idx int, energy double, occ double"
    rows = [(1, None, b, k, e, o) for b, o, es in ((0, 2.0, (-2.0, -1.0)), (1, 0.0, (1.0, 0.5))) for k, e in enumerate(es)] + [(2, None, 0, 0, -1.0, 2.0), (3, None, 0, 0, 1.0, None), (1, None, 0, 0, -2.0, 2.0)]
    got = {r.bands_id: (r.vbm, r.cbm, r.gap, r.direct_gap) for r in bands.band_gaps(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: (-1.0, 0.5, 1.5, 1.5)}
    assert {(r.band, r.k_idx): r.shifted for r in bands.shift_to_vbm(spark.createDataFrame(rows, ddl)).collect()} == {(0, 0): -1.0, (0, 1): 0.0, (1, 0): 2.0, (1, 1): 1.5}
    assert bands.sum_densities(spark.createDataFrame([("Cs", "s", 0.0, 1.0), ("Cs", "p", 0.0, 2.0), ("Te", "s", 0.0, 4.0)], "kind string, orbital string, energy double, value double"), ["kind"]).where("kind = 'Cs'").first().value == 3.0
    assert bands.band_gaps(spark.createDataFrame([], ddl)).count() == 0


def _ring(n, r, z=0.0, turn=0.0):
    return [(r * math.cos(2 * math.pi * k / n + turn), r * math.sin(2 * math.pi * k / n + turn), z) for k in range(n)]


GROUPS = {
    "C2v": ([8, 1, 1], [(0, 0, 0), (0.757, 0.586, 0), (-0.757, 0.586, 0)]), "C3v": ([7, 1, 1, 1], [(0, 0, 0.3), *_ring(3, 0.94)]),
    "Td": ([6] + [1] * 4, [(0, 0, 0)] + [(a * 0.63, b * 0.63, c * 0.63) for a, b, c in ((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1))]),
    "Oh": ([16] + [9] * 6, [(0, 0, 0), (1.56, 0, 0), (-1.56, 0, 0), (0, 1.56, 0), (0, -1.56, 0), (0, 0, 1.56), (0, 0, -1.56)]), "D3h": ([15] + [17] * 5, [(0, 0, 0), *_ring(3, 2.0), (0, 0, 2.1), (0, 0, -2.1)]),
    "D6h": ([6] * 6 + [1] * 6, _ring(6, 1.4) + _ring(6, 2.48)), "D2h": ([6, 6, 1, 1, 1, 1], [(0.67, 0, 0), (-0.67, 0, 0)] + [(a * 1.23, b * 0.93, 0) for a in (1, -1) for b in (1, -1)]),
    "D2d": ([6, 6, 6, 1, 1, 1, 1], [(0, 0, 0), (0, 0, 1.3), (0, 0, -1.3), (0.93, 0, 1.87), (-0.93, 0, 1.87), (0, 0.93, -1.87), (0, -0.93, -1.87)]), "D3d": ([6, 6] + [1] * 6, [(0, 0, 0.76), (0, 0, -0.76), *_ring(3, 1.02, 1.16), *_ring(3, 1.02, -1.16, math.pi / 3)]),
    "C1": ([6, 1, 9, 17, 35], [(0, 0, 0), (0.63, 0.63, 0.63), (0.8, -0.8, -0.8), (-1.0, 1.0, -1.0), (-1.1, -1.1, 1.1)]), "Cs": ([8, 1, 17], [(0, 0, 0), (0.96, 0, 0), (-0.4, 1.6, 0)]), "C2": ([8, 8, 1, 1], [(0, 0.73, 0), (0, -0.73, 0), (0.8, 0.9, 0.5), (-0.8, -0.9, 0.5)]),
    "C2h": ([6, 6, 1, 1, 17, 17], [(0.67, 0, 0), (-0.67, 0, 0), (1.23, 0.93, 0), (-1.23, -0.93, 0), (1.5, -1.5, 0), (-1.5, 1.5, 0)]), "Dinfh": ([6, 6, 1, 1], [(0, 0, 0.6), (0, 0, -0.6), (0, 0, 1.66), (0, 0, -1.66)]), "Cinfv": ([1, 6, 7], [(0, 0, 0), (0, 0, 1.06), (0, 0, 2.2)]),
}


@pytest.mark.parametrize("name", GROUPS)
def test_point_groups(name):
    from lodestone.operators.symmetry import point_group

    rng, (z, x) = np.random.default_rng(0), GROUPS[name]
    for _ in range(4):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        o = rng.permutation(len(z))
        assert point_group(np.array(z)[o], ((np.array(x, float) + rng.normal(0, 0.003, (len(z), 3))) @ q + 1)[o])[0] == name


def test_tables_and_trees(spark, odd, tmp_path):
    from lodestone.operators import symmetry, tables

    assert {r.seq: r.point_group for r in symmetry.point_groups(odd).collect()}[1] == "C2v"
    t = {r.seq: r for r in tables.wide_table(odd).collect()}
    assert t[1].el_conc_H == 2 / 3 and t[1].nr_atoms_H == 2 and t[0].nr_atoms_Ga == 1 and t[2].nr_atoms == 0 and len(t) == 10
    assert tables.element_subsets(["Te", "Cs"]) == [("Cs",), ("Te",), ("Cs", "Te")] and tables.formula_series(["Te", "Cs"], 2) == ["CsTe", "CsTe2", "Cs2Te"]
    assert tables.optimade_filter("Te2Cs4") == 'chemical_formula_reduced="Cs2Te"' and tables.optimade_filter("Te-Cs") == 'elements HAS ONLY "Cs", "Te"'
    (tmp_path / "a.json").write_text('{"data": [{"id": "x", "attributes": {"lattice_vectors": [[1,0,0],[0,1,0],[0,0,1]], "cartesian_site_positions": [[0,0,0]], "species_at_sites": ["Te"]}}, {"id": "y", "attributes": {}}]}')
    assert {r.label: r.elements for r in tables.read_optimade(spark, str(tmp_path)).collect()} == {"x": ["Te"], "y": None}
    tree = {"A": {"b": 1}, "c": 2}
    assert tables.set_path(tree, ["A", "d", "e"], 3) == {"A": {"b": 1, "d": {"e": 3}}, "c": 2} and tree == {"A": {"b": 1}, "c": 2}
    assert tables.get_path(tree, ["A", "b"]) == 1 and tables.get_path(tree, ["A", "x"], 0) == 0 and tables.paths(tree) == [(("A", "b"), 1), (("c",), 2)]
    assert tables.merge_trees(tree, {"A": {"b": 5}, "f": 1}) == {"A": {"b": 5}, "c": 2, "f": 1} and tables.with_case(tree) == {"a": {"b": 1}, "c": 2}
    assert len(tables.to_pandas(odd)) == 10
    with pytest.raises(ValueError):
        tables.to_pandas(odd, limit=3)
