"""Structure and series files: small texts in each format, round trips, broken frames."""

import numpy as np
import pytest

from lodestone.sources import electronic as EL
from lodestone.sources import files
from lodestone.sources import formats as FM

CELL = [[4.0, 0.0, 0.0], [0.5, 5.0, 0.0], [0.0, 0.3, 6.0]]
CRYSTAL = {"label": "x1", "elements": ["Cs", "Te"], "positions": [[0.1, 0.2, 0.3], [2.0, 2.5, 3.0]], "is_cartesian": True, "cell": CELL, "pbc": [True] * 3}


@pytest.mark.parametrize("fmt, parse", [("xyz", "xyz"), ("xsf", "xsf"), ("cif", "cif"), ("cssr", "zeo"), ("v1", "zeo"), ("cuc", "zeo"), ("geometry_in", "geometry_in")])
def test_round_trips(fmt, parse):
    got = next(FM.PARSERS[parse][1](FM.WRITERS[fmt](CRYSTAL)))
    assert got["elements"] == ["Cs", "Te"]
    # formats that give lengths and angles turn the crystal: compare what doesn't depend on that
    assert np.allclose(FM.parameters(got["cell"]), FM.parameters(CELL), atol=2e-3)
    assert np.allclose(FM.scaled(got), FM.scaled(CRYSTAL), atol=2e-4)


def test_xyz_columns_follow_the_properties():
    text = '2\nLattice="4 0 0 0 4 0 0 0 4" Properties=id:I:1:pos:R:3:species:S:1:forces:R:3 pbc="T T F" energy=-1.5 note="a b"\n7 0 0 0 Te 1 2 3\n8 1 1 1 Cs1 4 5 6\n\n1\njust a comment\nH 0 0 0\n'
    a, b = FM.parse_xyz(text)
    assert (a["elements"], a["kinds"], a["pbc"]) == (["Te", "Cs"], ["Te", "Cs1"], [True, True, False])
    assert a["site_attributes"] == {"id": ["7", "8"], "forces": ["1 2 3", "4 5 6"]} and a["attributes"] == {"energy": "-1.5", "note": "a b"}
    assert b["attributes"] == {"comment": "just a comment"} and b.get("cell") is None and b["pbc"] == [False] * 3


def test_xsf_steps():
    text = "ANIMSTEPS 2\nCRYSTAL\nPRIMVEC\n0 2.7 2.7\n2.7 0 2.7\n2.7 2.7 0\nPRIMCOORD 1\n2 1\n16 0 0 0 1 2 3\n30 1.3 1.3 1.3 0 0 1\nPRIMCOORD 2\n2 1\nS 0 0 0\nZn 1.2 1.2 1.2\n"
    a, b = FM.parse_xsf(text)
    assert a["elements"] == b["elements"] == ["S", "Zn"] and a["site_attributes"]["forces"] == ["1 2 3", "0 0 1"] and b["cell"][0] == [0.0, 2.7, 2.7]


CIF = """data_NaCl
_cell_length_a 5.64(1)
_cell_length_b 5.64
_cell_length_c 5.64
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
_chemical_formula_sum 'Na4 Cl4'
loop_
_symmetry_equiv_pos_as_xyz
'x,y,z'
'x, y+1/2, z+1/2'
'x+1/2,y,z+1/2'
'1/2+x,1/2+y,z'
loop_
_atom_site_label
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
Na1 0 0 0
Cl1 0.5 0 0 # a comment
_text
;
data_ not a block
;
"""


def test_cif_symmetry_expansion():
    (s,) = FM.parse_cif(CIF)
    assert s["elements"].count("Na") == s["elements"].count("Cl") == 4 and s["is_cartesian"] is False
    assert {tuple(np.round(np.array(p) % 1, 6)) for p, e in zip(s["positions"], s["elements"]) if e == "Na"} == {(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0)}
    with pytest.raises(ValueError, match="formula"):
        list(FM.parse_cif(CIF.replace("Na4 Cl4", "Na Cl2")))
    rot, shift = FM.symmetry_operation("-x+y, 1/2 - z, 0.25+x")
    assert rot.tolist() == [[-1, 1, 0], [0, 0, -1], [1, 0, 0]] and shift.tolist() == [0, 0.5, 0.25]


def test_inputs_of_codes():
    (q,) = FM.parse_qe_input("&SYSTEM\n ibrav = 0, nat = 2, ntyp = 1\n/\nCELL_PARAMETERS bohr\n10 0 0\n0 10 0\n0 0 10\nATOMIC_POSITIONS {crystal}\nSi1 0 0 0\nSi 0.25 0.25 0.25\n")
    assert q["elements"] == ["Si", "Si"] and q["kinds"] == ["Si1", "Si"] and abs(q["cell"][0][0] - 5.2917721) < 1e-5 and q["is_cartesian"] is False
    with pytest.raises(ValueError, match="ibrav"):
        list(FM.parse_qe_input("&SYSTEM\n ibrav = 2, nat = 0\n/\nATOMIC_POSITIONS\n"))
    (c,) = FM.parse_cp2k_restart("&SUBSYS\n &CELL\n A 2 0 0\n B 0 2 0\n C 0 0 2\n PERIODIC XY\n MULTIPLE_UNIT_CELL 1 2 1\n &END CELL\n &COORD\nO1 0 0 0\nH 0 *** 1\n &END COORD\n &KIND O1\n ELEMENT O\n &END KIND\n&END SUBSYS\n")
    assert c["elements"] == ["O", "H"] and c["cell"][1] == [0, 4, 0] and c["positions"][1] == [0, 0, 1] and c["pbc"] == [True, True, False]
    (g,) = FM.parse_geometry_in("lattice_vector 1 0 0\nlattice_vector 0 1 0\nlattice_vector 0 0 1\natom_frac 0 0 0.5 Cs2\n")
    assert g["elements"] == ["Cs"] and g["kinds"] == ["Cs2"] and g["is_cartesian"] is False
    with pytest.raises(ValueError):
        list(FM.parse_geometry_in("atom 0 0 0 H\natom_frac 0 0 0 H\n"))


def test_cube_round_trip(spark, tmp_path):
    values = [float(k) for k in range(24)]
    text = FM.format_cube(CRYSTAL, (2, 3, 4), values)
    (s,) = FM.parse_cube(text)
    assert s["elements"] == ["Cs", "Te"] and np.allclose(s["positions"], CRYSTAL["positions"], atol=1e-5) and np.allclose(s["cell"], CELL, atol=1e-4)
    (tmp_path / "a.cube").write_text(text)
    got = files.read_cube_values(spark, str(tmp_path)).orderBy("ix", "iy", "iz").collect()
    assert [r.value for r in got] == values and (got[-1].ix, got[-1].iy, got[-1].iz) == (1, 2, 3)


def test_typed_values():
    assert [FM.typed(v) for v in ("yes", "FALSE", "12", "-1.5e3", "1.23(4)", ".5", "No.", "abc", "1d-2")] == [True, False, 12, -1500.0, 1.23, 0.5, "No.", "abc", 0.01]


def test_files_with_broken_frames_are_set_apart(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("1\nfine\nH 0 0 0\n2\nbroken\nH 0 0 0\n")
    (tmp_path / "b.cif").write_text(CIF)
    (tmp_path / "c.xsf").write_text("CRYSTAL\nPRIMVEC\n1 0 0\n")
    (tmp_path / "d.unknown").write_text("?")
    (tmp_path / "e.xyz").write_text("")
    got = {(r.path.rsplit("/", 1)[1], r.frame): (r.elements, r.problem) for r in files.read_structures(spark, str(tmp_path)).collect()}
    assert got["a.xyz", 0] == (["H"], None) and "ends too early" in got["a.xyz", 1][1] and got["b.cif", 0][1] is None and len(got["b.cif", 0][0]) == 8
    assert "no format" in got["d.unknown", 0][1] and ("e.xyz", 0) not in got


def test_write_and_read_again(spark, tmp_path):
    ddl = "seq long, label string, elements array<string>, positions array<array<double>>, cell array<array<double>>, pbc array<boolean>"
    d = spark.createDataFrame([(1, "a", ["Cs", "Te"], CRYSTAL["positions"], CELL, [True] * 3), (2, "b", ["H"], [[0.0, 0.0, 0.0]], None, [False] * 3), (3, "c", None, None, None, None)], ddl)
    files.write_structures(d, str(tmp_path / "out"), "xyz")
    got = {r.label: r for r in files.read_structures(spark, str(tmp_path / "out"), "xyz", "*.txt").collect()}
    assert set(got) == {"a", "b"} and got["a"].elements == ["Cs", "Te"] and np.allclose(got["a"].cell, CELL) and got["b"].cell is None
    assert {r.key: r.text is None for r in files.to_text(d, "cif").collect()} == {"1": False, "2": True, "3": True}


def test_bands_and_densities(spark, tmp_path):
    (tmp_path / "band1001.out").write_text("1 0 0 0 2.0 -5.0 0.0 1.0\n2 0.5 0 0 2.0 -4.5 0.0 1.5\n")
    (tmp_path / "x.bands.dat").write_text(" &plot nbnd=   3, nks=     2 /\n  0.0 0.0 0.0\n -5.0 1.0\n 2.0\n 0.5 0.0 0.0\n -4.0 1.5 2.5\n")
    (tmp_path / "y.bs").write_text("# Set 1: 2 special points, 2 k-points, 2 bands\n#  Point 1 Spin 1: 0.0 0.0 0.0 0.5\n#  Band  Energy [eV] Occupation\n 1 -3.0 2.0\n 2 1.0 0.0\n#  Point 2 Spin 1: 0.5 0.0 0.0 0.5\n 1 -2.5 2.0\n 2 1.5 0.0\n")
    rows = lambda code: [(r.k_idx, r.band, r.kx, r.energy, r.occ) for r in EL.read_bands(spark, str(tmp_path), code).orderBy("k_idx", "band").collect()]
    assert rows("aims") == [(0, 0, 0.0, -5.0, 2.0), (0, 1, 0.0, 1.0, 0.0), (1, 0, 0.5, -4.5, 2.0), (1, 1, 0.5, 1.5, 0.0)]
    assert rows("qe")[2] == (0, 2, 0.0, 2.0, None) and len(rows("qe")) == 6
    assert rows("cp2k")[2] == (1, 0, 0.5, -2.5, 2.0)
    (tmp_path / "t.dos").write_text("#  E (eV)   dos(E)     Int dos(E) EFermi =    5.968 eV\n -1.0 0.5 0.1\n 0.0 ****** 0.2\n")
    assert [(r.energy, r.value, r.e_fermi) for r in EL.read_dos(spark, str(tmp_path), "qe_total").orderBy("energy").collect()] == [(-1.0, 0.5, 5.968), (0.0, 0.0, 5.968)]
    (tmp_path / "atom_projected_dos_Cs0002.dat").write_text("# head\n -1.0 0.5 0.3 0.2\n")
    assert [(r.kind, r.site, r.orbital, r.value) for r in EL.read_dos(spark, str(tmp_path), "aims_projected").collect()] == [("Cs", 1, "total", 0.5), ("Cs", 1, "s", 0.3), ("Cs", 1, "p", 0.2)]
    (tmp_path / "run-ALPHA_k1-1.pdos").write_text("# Projected DOS for atomic kind Cs at iteration step i = 0, E(Fermi) = 0.1 a.u.\n#  MO Eigenvalue [a.u.] Occupation s py\n 1 -0.5 1.0 0.2 0.1\n")
    got = EL.read_dos(spark, str(tmp_path), "cp2k_projected").collect()
    assert [(r.kind, r.spin, r.orbital, round(r.energy, 4)) for r in got] == [("Cs", "up", "s", -13.6057), ("Cs", "up", "py", -13.6057)]
    (tmp_path / "band1002.out").write_text("1 0 0\n")
    assert [r.problem is not None for r in EL.read_bands(spark, str(tmp_path), "aims", "band1002.out").collect()] == [True]
    (tmp_path / "p.agr").write_text("@    s0 line color 2\n@target G0.S0\n@type xy\n0.0 1.0\n1.0 2.0\n&\n")
    assert [(r.set, r.colour, r.x, r.y) for r in EL.read_xmgrace(spark, str(tmp_path)).collect()] == [(0, "2", 0.0, 1.0), (0, "2", 1.0, 2.0)]
    assert {r.name: r.value for r in EL.read_patterns(spark, str(tmp_path), {"fermi": r"EFermi =\s*(\S+)"}, "t.dos").collect()} == {"fermi": "5.968"}
