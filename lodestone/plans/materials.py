"""Queries on bands, series, features, access and constraints, with SQL for DuckDB. Band energies are brought to eV first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import quantities as Q
from lodestone.functions import units as U
from lodestone.operators import access as A
from lodestone.operators import bands as B
from lodestone.operators import collection as C
from lodestone.operators import features as FT
from lodestone.operators import series as SE
from lodestone.operators import unit_repair
from lodestone.plans.analysis import _KEYED, _NB, RADIUS, _r
from lodestone.plans.reference import _STRUCT
from lodestone.session import Scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _s(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "structures")


def _bands(spark: SparkSession, d: str) -> DataFrame:
    return unit_repair.common_bands(table(spark, d, "output_bands"))


#: The unit that a text states, in SQL: a word between non-letters, without blanks and signs, and what it means.
_WORD = r"regexp_replace(regexp_extract(lower({0}), '(?:^|[^a-z])(milli[\s-]?(?:ev|electron\s?volts?)|mev|electron\s?volts?|ev|hartrees?|ha|a\.u\.|rydbergs?|ryd|ry|kj|kcal|terahertz|thz|cm\s?\^?-1|cm\^\{{-1\}}|1\s?/\s?cm)(?:$|[^a-z])', 1), '[\s^{{}}.-]', '', 'g')"
_CODE = "CASE WHEN {0} IN ('ev', 'electronvolt', 'electronvolts') THEN 1 WHEN {0} IN ('mev', 'milliev', 'millielectronvolt', 'millielectronvolts') THEN 2 WHEN {0} IN ('hartree', 'hartrees', 'ha', 'au') THEN 3 WHEN {0} IN ('rydberg', 'rydbergs', 'ryd', 'ry') THEN 4 WHEN {0} IN ('thz', 'terahertz') THEN 5 WHEN {0} IN ('cm1', '1/cm') THEN 6 END"
BAND_UNITS = ["ev", "mev", "hartree", "rydberg", "thz", "inv_cm"]
UNITS_SQL = f"""tx AS (SELECT DISTINCT bands_id, {_WORD.format('unit_y')} wu, {_WORD.format('y_label')} wl FROM output_bands),
bu AS (SELECT bands_id, min(coalesce({_CODE.format('wu')}, {_CODE.format('wl')} + 100)) % 100 u FROM tx GROUP BY bands_id),
ob AS (SELECT output_bands.*, energy * [{', '.join(repr(U.EV[u]) for u in BAND_UNITS)}][coalesce(u, 1)] e FROM output_bands JOIN bu USING (bands_id)),
pt AS (SELECT bands_id, coalesce(spin, 'none') spin, band, k_idx, max(e) energy, max(occ) occ FROM ob WHERE e IS NOT NULL GROUP BY ALL)"""
_EDGE = f"""WITH {UNITS_SQL}, f0 AS (SELECT bands_id, spin, min(k_idx) k0 FROM pt WHERE occ IS NOT NULL GROUP BY ALL),
ed AS (SELECT bands_id, spin, min(band) cb FROM pt JOIN f0 USING (bands_id, spin) WHERE k_idx = k0 AND occ < 0.5 GROUP BY ALL),
kk AS (SELECT bands_id, spin, cb, k_idx, max(CASE WHEN band < cb THEN energy END) v, min(CASE WHEN band = cb THEN energy END) c FROM pt JOIN ed USING (bands_id, spin) WHERE band IN (cb, cb - 1) GROUP BY ALL),
gp AS (SELECT bands_id, spin, cb - 1 vb, max(v) vbm, min(c) cbm, greatest(min(c) - max(v), 0) gap, greatest(min(c - v), 0) direct_gap FROM kk GROUP BY bands_id, spin, cb HAVING max(v) IS NOT NULL AND min(c) IS NOT NULL)"""


@query(_EDGE + " SELECT bands_id, spin, vb, round(vbm, 6) vbm, round(cbm, 6) cbm, round(gap, 6) gap, round(direct_gap, 6) direct_gap FROM gp")
def band_gap(spark, d):
    return B.band_gaps(_bands(spark, d)).select("bands_id", "spin", "vb", *[_r(c, 6) for c in ("vbm", "cbm", "gap", "direct_gap")])


@query(_EDGE + " SELECT bands_id, spin, k_idx, round(c - v, 6) diff FROM kk WHERE c IS NOT NULL AND v IS NOT NULL")
def gap_at_kpoint(spark, d):
    return B.gap_at_kpoint(_bands(spark, d)).select("bands_id", "spin", "k_idx", _r("diff", 6))


@query(f"WITH {UNITS_SQL} SELECT bands_id, floor(energy / 0.5)::BIGINT bin, count(*) states FROM pt GROUP BY ALL")
def dos_histogram(spark, d):
    return B.density_of_states(_bands(spark, d), 0.5).select("bands_id", F.col("bin").cast("long").alias("bin"), "states")


@query(f"WITH {UNITS_SQL}, x AS (SELECT bands_id, spin, band, min(energy) lo, max(energy) hi FROM pt GROUP BY ALL) SELECT x.bands_id, x.spin, x.band, round(lo, 6) lowest, min(CASE WHEN energy = lo THEN k_idx END) k_lowest, round(hi, 6) highest, min(CASE WHEN energy = hi THEN k_idx END) k_highest FROM x JOIN pt USING (bands_id, spin, band) GROUP BY ALL")
def analyse_band(spark, d):
    return B.analyse_bands(_bands(spark, d)).select("bands_id", "spin", "band", _r("lowest", 6), "k_lowest", _r("highest", 6), "k_highest")


@query(f"WITH {UNITS_SQL} SELECT bands_id, spin, band, min(energy) lowest, max(energy) highest FROM pt GROUP BY ALL")
def band_width(spark, d):
    return B.band_widths(_bands(spark, d)).drop("mean")


@query(_EDGE + ", tp AS (SELECT bands_id, max(vbm) vbm FROM gp GROUP BY ALL) SELECT bands_id, spin, band, k_idx, round(energy - vbm, 6) shifted FROM pt JOIN tp USING (bands_id)")
def shift_to_vbm(spark, d):
    return B.shift_to_vbm(_bands(spark, d)).select("bands_id", "spin", "band", "k_idx", _r("shifted", 6))


_LINE = np.linspace(-8, 11, 39)[:-1]


@query(f"""WITH {UNITS_SQL}, h AS (SELECT bands_id, floor((energy + 8) / 0.5)::INT b, count(*) n FROM pt WHERE energy >= -8 AND energy < 11 GROUP BY ALL), ids AS (SELECT DISTINCT bands_id FROM h), g AS (SELECT bands_id, b FROM ids, unnest(range(0, 38)) t(b)),
tap(k, w) AS (VALUES {', '.join(f'({i - len(SE.kernel(1.1)) // 2}, {w!r})' for i, w in enumerate(SE.kernel(1.1)))})
SELECT g.bands_id, g.b::BIGINT bin, round(coalesce(sum(h.n * w), 0), 6) value FROM g JOIN tap ON true LEFT JOIN h ON h.bands_id = g.bands_id AND h.b = g.b - k GROUP BY g.bands_id, g.b""")
def dos_smeared(spark, d):
    """Densities of states between -8 and 11 eV, smeared with a Gaussian."""
    p = B.points(_bands(spark, d)).where("energy >= -8 and energy < 11").groupBy("bands_id", F.floor((F.col("energy") + 8) / 0.5).cast("int").alias("b")).agg(F.count("*").alias("n"))
    one = p.groupBy("bands_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    y = F.transform(F.sequence(F.lit(0), F.lit(37)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0)).cast("double"))
    return one.select("bands_id", F.posexplode(SE.smooth(y, 1.1)).alias("bin", "value")).select("bands_id", F.col("bin").cast("long").alias("bin"), _r("value", 6))


_TWO = f"WITH {UNITS_SQL}, t AS (SELECT bands_id, k_idx, max(CASE WHEN band = 0 THEN energy END) a, max(CASE WHEN band = 1 THEN energy END) b FROM pt GROUP BY ALL), ok AS (SELECT * FROM t WHERE a IS NOT NULL AND b IS NOT NULL)"


def _two(spark, d):
    p = B.points(_bands(spark, d)).where("band <= 1")
    of = lambda k: F.max(F.when(F.col("band") == k, F.col("energy")))
    return p.groupBy("bands_id", "k_idx").agg(of(0).alias("a"), of(1).alias("b"))


@query(_TWO + """ SELECT bands_id, count(*) n, round(sqrt(sum((a - b) * (a - b))), 5) euclidian, round(1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 5) cosine, round(sum(a - b), 5) total, round(sum(abs(a - b)), 5) absolute,
round(CASE WHEN var_pop(a) > 1e-12 AND var_pop(b) > 1e-12 THEN corr(a, b) END, 4) correlation FROM ok GROUP BY bands_id""")
def series_distances(spark, d):
    """Distances between the two lowest bands of each calculation."""
    s = SE.distances(_two(spark, d), ["bands_id"], "a", "b")
    return s.select("bands_id", "n", _r("euclidian", 5), _r("cosine", 5), _r("total", 5), _r("absolute", 5), _r("correlation", 4))


@query(_TWO + " SELECT bands_id, round(corr(a, b), 4) r, count(*) n FROM ok GROUP BY bands_id HAVING count(*) > 2 AND var_pop(a) > 1e-9 AND var_pop(b) > 1e-9")
def series_corr(spark, d):
    t = _two(spark, d).where("a is not null and b is not null").groupBy("bands_id").agg(F.round(F.corr("a", "b"), 4).alias("r"), F.count("*").alias("n"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"))
    return t.where("n > 2 and va > 1e-9 and vb > 1e-9").select("bands_id", "r", "n")


_EDGES = [float(k) for k in range(6)]
_LISTS = f"""WITH {UNITS_SQL}, pk AS (SELECT bands_id, band, k_idx::DOUBLE x, max(energy) y FROM pt WHERE band <= 1 GROUP BY ALL), l AS (SELECT bands_id, band, list(x ORDER BY x) xs, list(y ORDER BY x) ys FROM pk GROUP BY ALL),
spot AS (SELECT bands_id, band, bin, bin + q * 0.25 p, q, xs, ys, len([x for x in xs if x <= bin + q * 0.25]) k FROM l, unnest(range(0, 5)) a(bin), unnest(range(0, 5)) b(q)),
v AS (SELECT *, CASE WHEN k = 0 THEN ys[1] WHEN k >= len(xs) THEN ys[-1] ELSE ys[k] + (ys[k + 1] - ys[k]) * (p - xs[k]) / (xs[k + 1] - xs[k]) END y FROM spot),
ar AS (SELECT bands_id, band, bin, sum(y * CASE WHEN q IN (0, 4) THEN 0.125 ELSE 0.25 END) area FROM v GROUP BY ALL)"""


def _areas(spark, d):
    p = B.points(_bands(spark, d)).where("band <= 1").groupBy("bands_id", "band", F.col("k_idx").cast("double").alias("x")).agg(F.max("energy").alias("y"))
    one = p.groupBy("bands_id", "band").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("p"))
    return one.select("bands_id", "band", SE.integrals(F.transform("p", lambda q: q["x"]), F.transform("p", lambda q: q["y"]), _EDGES).alias("areas"))


@query(_LISTS + " SELECT bands_id, band, bin::BIGINT bin, round(area, 8) area FROM ar")
def series_interp_integrate(spark, d):
    a = _areas(spark, d).select("bands_id", "band", F.posexplode("areas").alias("bin", "area"))
    return a.select("bands_id", "band", F.col("bin").cast("long").alias("bin"), _r("area", 8))


_HEIGHTS = [round(float(h), 7) for h in SE.uniform_axis(-7.5312347, 10.5, 0.5)]


@query(_LISTS + f""", ct AS (SELECT bands_id, band, bin, len([h for h in {_HEIGHTS} if h <= area]) n FROM ar)
SELECT a.bands_id, round(sum(least(a.n, b.n)) / nullif(sum(a.n) + sum(b.n) - sum(least(a.n, b.n)), 0), 6) similarity FROM ct a JOIN ct b ON a.bands_id = b.bands_id AND a.bin = b.bin AND a.band = 0 AND b.band = 1 GROUP BY a.bands_id""")
def series_tanimoto(spark, d):
    """Similarity of the discretised fingerprints of the two lowest bands."""
    c = _areas(spark, d).select("bands_id", "band", SE.fingerprint_counts(F.col("areas"), [_HEIGHTS] * (len(_EDGES) - 1)).alias("c"))
    a, b = c.where("band = 0").select("bands_id", F.col("c").alias("c1")), c.where("band = 1").select("bands_id", F.col("c").alias("c2"))
    return a.join(b, "bands_id").select("bands_id", _r(SE.tanimoto(F.col("c1"), F.col("c2")), 6, "similarity"))


@query(f"""WITH {_STRUCT}, g AS (SELECT seq, try_cast(attributes['space_group'].d AS INT) n FROM structures), c AS (SELECT st.seq, len([e for e in els if e = 'Te']) / n_sites c, n FROM st JOIN g USING (seq) WHERE n BETWEEN 1 AND 230)
SELECT ceil((c - 0.05) / 0.1)::BIGINT bin, CASE WHEN n <= 2 THEN 'triclinic' WHEN n <= 15 THEN 'monoclinic' WHEN n <= 74 THEN 'orthorhombic' WHEN n <= 142 THEN 'tetragonal' WHEN n <= 167 THEN 'trigonal' WHEN n <= 194 THEN 'hexagonal' ELSE 'cubic' END crystal_system, count(*) n
FROM c WHERE c > 0 GROUP BY ALL""")
def phase_histogram_stacked(spark, d):
    """Numbers of structures by the share of Te, in bins of 0.1 about their middles, and by crystal system."""
    n = F.col("attributes")["space_group"]["d"].try_cast("int")
    c = F.size(F.filter("elements", lambda e: C.symbol(e) == "Te")) / F.size("elements")
    s = _s(spark, d).select(c.alias("c"), Q.crystal_system(n).alias("crystal_system")).where("crystal_system is not null and c > 0")
    return s.groupBy(F.ceil((F.col("c") - 0.05) / 0.1).cast("long").alias("bin"), "crystal_system").agg(F.count("*").alias("n"))


# access and constraints


@query("WITH l AS (SELECT label, seq, row_number() OVER (ORDER BY seq) - 1 place FROM structures) SELECT seq, label, place::BIGINT place FROM l WHERE place >= 10 AND place % 3 = 1")
def collection_slice(spark, d):
    """Every third row from the tenth on, in order of arrival."""
    s = A.slice_structures(_s(spark, d).select("seq", "label"), 10, None, 3)
    return s.select("seq", "label", F.col("place").cast("long").alias("place"))


@query("""WITH a AS (SELECT seq, label FROM structures WHERE seq % 2 = 0), b AS (SELECT seq, label FROM structures WHERE seq % 2 = 1)
SELECT seq, label FROM a UNION ALL SELECT seq, label FROM b WHERE label NOT IN (SELECT label FROM a WHERE label IS NOT NULL) OR label IS NULL""")
def collection_union(spark, d):
    """Two halves of the collection put together, keys of the first first."""
    s = _s(spark, d).select("seq", "label")
    return A.union(s.where("seq % 2 = 0"), s.where("seq % 2 = 1")).select("seq", "label")


@query("SELECT DISTINCT unnest(map_keys(attributes)) attribute FROM structures")
def collection_attribute_keys(spark, d):
    return A.attribute_keys(_s(spark, d))


@query("SELECT DISTINCT k kind FROM (SELECT unnest(kinds) k FROM structures) WHERE k IS NOT NULL")
def collection_distinct_kinds(spark, d):
    return A.kinds_of(_s(spark, d))


@query(f"WITH {_STRUCT}, c AS (SELECT seq, len([e for e in els if e = 'Cs']) / n_sites a, len([e for e in els if e = 'Te']) / n_sites b FROM st) SELECT seq FROM c WHERE (a = 0 OR (a > 0.25 AND a < 0.7)) AND (b = 0 OR (b > 0.0 AND b < 0.5))")
def conc_constraint_open(spark, d):
    return A.Constraints().concentration("Cs", 0.25, 0.7).concentration("Te", 0.0, 0.5).apply(_s(spark, d)).select("seq")


@query("WITH a AS (SELECT seq, coalesce(attributes['band_gap'].d, try_cast(attributes['band_gap'].s AS DOUBLE)) g, coalesce(attributes['stability'].d, try_cast(attributes['stability'].s AS DOUBLE)) s FROM structures) SELECT seq FROM a WHERE g >= 0.5 AND g <= 2.0 AND s <= 0.2")
def attr_constraint_closed(spark, d):
    return A.Constraints().attribute("band_gap", 0.5, 2.0).attribute("stability", None, 0.2).apply(_s(spark, d)).select("seq")


@query(_KEYED + " SELECT st.seq FROM st LEFT JOIN rk USING (seq) WHERE formula IN ('Cs2Te', 'CsTe', 'AsGa') OR len([e for e in els if e IN ('Cs', 'Sb', 'K')]) = len(els)")
def formula_constraint_or(spark, d):
    return A.Constraints().formula("Cs2Te", "Cs4Te4", "GaAs", {"Cs": "-", "Sb": "-", "K": "-"}).apply(_s(spark, d)).select("seq")


@query(f"WITH {_STRUCT} SELECT seq, (i - 1)::BIGINT site, els[i] element, positions[i][1] x, positions[i][2] y, positions[i][3] z FROM st, unnest(range(1, len(els) + 1)) t(i) WHERE len(els) = len(positions)")
def iter_sites(spark, d):
    s = C.sites(_s(spark, d).where(F.size("elements") == F.size("positions")))
    return s.select("seq", F.col("site").cast("long").alias("site"), "element", "x", "y", "z")


# features


@query(f"WITH {_STRUCT}, el AS (SELECT DISTINCT e FROM st, unnest(els) t(e) WHERE e IS NOT NULL) SELECT seq, e element, round(len([x for x in els if x = e]) / n_sites, 6) value FROM st, el WHERE list_contains(els, e)")
def composition_features(spark, d):
    """The entries of the composition vectors that aren't 0."""
    s = _s(spark, d)
    names = FT.fit_elements(s)
    f = FT.composition(s, names).select("seq", F.posexplode("features").alias("k", "value")).where("value <> 0")
    return f.select("seq", F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("element"), _r("value", 6))


@query(f"""WITH {_STRUCT}, v AS (SELECT seq, els, abs(cell[1][1]*(cell[2][2]*cell[3][3]-cell[2][3]*cell[3][2]) - cell[1][2]*(cell[2][1]*cell[3][3]-cell[2][3]*cell[3][1]) + cell[1][3]*(cell[2][1]*cell[3][2]-cell[2][2]*cell[3][1])) v FROM st WHERE cell IS NOT NULL)
SELECT seq, e element, round(count(*) / v, 7) value FROM v, unnest(els) t(e) WHERE e IS NOT NULL GROUP BY seq, e, v""")
def density_features(spark, d):
    s = _s(spark, d)
    names = FT.fit_elements(s)
    f = FT.density(s, names).select("seq", F.posexplode("features").alias("k", "value")).where("value <> 0")
    return f.select("seq", F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("element"), _r("value", 7))


@query()
def coordination_features(spark, d):
    s = _s(spark, d).where("cell is not null")
    return FT.coordination(s, FT.fit_elements(s), "minimum_distance", RADIUS)


@query()
def coulomb_features(spark, d):
    """Coulomb-matrix eigenvalues of molecules."""
    return FT.coulomb_matrix(_s(spark, d))


@query()
def stratified_split(spark, d):
    s = _s(spark, d)
    return FT.stratified_split(s, F.element_at(F.array_sort(F.array_distinct(F.transform("elements", C.symbol))), 1), 0.2)


@query(_NB + " SELECT seq, site::BIGINT site, nbr::BIGINT nbr, round(distance, 4) distance FROM nn WHERE distance < 1.5 AND element = 'H' AND nbr_element IN ('N', 'O', 'F')")
def hydrogen_donors(spark, d):
    """Bonds of hydrogen to N, O or F in crystals, the first half of hydrogen bonds."""
    from lodestone.operators import neighbours as N

    n = N.pairs(_s(spark, d).where("cell is not null"), 1.5).where((F.col("element") == "H") & F.col("nbr_element").isin("N", "O", "F") & (F.col("distance") < 1.5))
    return n.select("seq", "site", "nbr", _r("distance", 4))


@query(_NB + """, bd AS (SELECT DISTINCT seq, site, nbr FROM nn WHERE distance <= 2.2), al AS (SELECT seq, site FROM fr),
fx AS (SELECT * FROM (WITH RECURSIVE reach(seq, site, nbr) AS (SELECT seq, site, site FROM al UNION SELECT r.seq, r.site, b.nbr FROM reach r JOIN bd b ON b.seq = r.seq AND b.site = r.nbr) SELECT seq, site, min(nbr) fragment FROM reach GROUP BY seq, site))
SELECT seq, site::BIGINT site, fragment::BIGINT fragment FROM fx""")
def fragments(spark, d):
    """Sites of crystals joined by bonds of up to 2.2 angstrom; a fragment is named by its smallest site."""
    from lodestone.operators import graphs

    return graphs.fragments(_s(spark, d).where("cell is not null"), 2.2)


@query()
def point_groups(spark, d):
    """Point groups of molecules."""
    from lodestone.operators import symmetry

    return symmetry.point_groups(_s(spark, d))


@query()
def hydrogen_bonds(spark, d):
    from lodestone.operators import graphs

    return graphs.hydrogen_bonds(_s(spark, d))


@query()
def warren_cowley(spark, d):
    """Order parameters of the first three shells of crystals, with the reference's own radius of 20 angstrom."""
    from lodestone.operators import neighbours as N

    w = N.warren_cowley(_s(spark, d).where("cell is not null"), 3, 20.0)
    return w.groupBy("seq", "element", "shell").agg(F.round(F.avg("value"), 5).alias("value"))


@query(f"WITH {_STRUCT} SELECT seq, label, len(els)::BIGINT nr_atoms, round(len([e for e in els if e = 'Cs']) / n_sites, 6) el_conc_cs, round(len([e for e in els if e = 'Te']) / n_sites, 6) el_conc_te, len([e for e in els if e = 'Cs'])::BIGINT nr_cs, attributes['band_gap'].d band_gap FROM st JOIN structures USING (seq, label) WHERE label IS NOT NULL")
def el_concentration_pivot(spark, d):
    from lodestone.operators import tables

    t = tables.wide_table(_s(spark, d).where("label is not null"), elements=["Cs", "Te"]).join(_s(spark, d).select("seq", F.col("attributes")["band_gap"]["d"].alias("band_gap")), "seq")
    return t.select("seq", "label", F.col("nr_atoms").cast("long").alias("nr_atoms"), _r("el_conc_Cs", 6, "el_conc_cs"), _r("el_conc_Te", 6, "el_conc_te"), F.col("nr_atoms_Cs").cast("long").alias("nr_cs"), "band_gap")


@query(f"WITH {_STRUCT}, u AS (SELECT seq, list_sort(list_distinct([e for e in els if e IS NOT NULL])) s FROM st) SELECT seq, list_aggregate(s, 'string_agg', '-') system FROM u WHERE len(s) > 0 AND len([e for e in s if e NOT IN ('Cs', 'Te', 'O', 'Sb')]) = 0")
def element_subset_powerset(spark, d):
    """Structures of all chemical systems within Cs-O-Sb-Te."""
    from lodestone.operators import tables

    return tables.subsystems(_s(spark, d), ["Cs", "Te", "O", "Sb"])


@query(_KEYED + " SELECT seq, formula FROM rk WHERE formula IN ('CsTe', 'Cs2Te', 'Cs3Te', 'CsTe2', 'Cs3Te2', 'CsTe3', 'Cs2Te3')")
def formula_series(spark, d):
    """Structures whose reduced formula is one of the series of Cs and Te with up to three atoms each."""
    from lodestone.operators import compare, tables

    return _s(spark, d).select("seq", compare.reduced_formula_key().alias("formula")).where(F.col("formula").isin(*tables.formula_series(["Cs", "Te"], 3)))
