"""Queries on functions of formulas, elements, units and geometry, on neighbours and fingerprints, on comparison and manipulation, with SQL for DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import elements as E
from lodestone.functions import formula_columns as FC
from lodestone.functions import geometry as G
from lodestone.functions import quantities as Q
from lodestone.operators import collection as C
from lodestone.operators import compare as CMP
from lodestone.operators import manipulate as M
from lodestone.operators import neighbours as N
from lodestone.operators import series as SE
from lodestone.operators import site_geometry as SG
from lodestone.plans.reference import _CRYSTAL, _STRUCT, _sym
from lodestone.session import table

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


def _r(c: str | F.Column, k: int, name: str | None = None) -> F.Column:
    return F.round(c, k).alias(name or str(c))


def _values(name: str, table: list) -> str:
    """A lookup table in SQL: (name, value)."""
    rows = ", ".join(f"('{s}', {'NULL' if v is None else v})" for s, v in zip(E.SYMBOLS, table))
    return f"{name}(el, v) AS (VALUES {rows})"


# formulas

_PIECES = r"regexp_extract_all(replace(formula_text, '@', ''), '([A-Z][a-z]?)([0-9]*(?:\.[0-9]+)?)', {})"
_FLAT = f"""flat AS (SELECT ref_id, unnest({_PIECES.format(1)}) el, unnest({_PIECES.format(2)}) q FROM measured_crystals WHERE formula_text IS NOT NULL AND NOT regexp_matches(formula_text, '[(\\[{{]')),
fm AS (SELECT ref_id, el, sum(CASE WHEN q = '' THEN 1.0 ELSE q::DOUBLE END) q FROM flat GROUP BY ALL)"""


def _flat_formulas(spark, d):
    m = table(spark, d, "measured_crystals").where("formula_text is not null").where(~F.col("formula_text").rlike(r"[(\[{]"))
    return m.select("ref_id", FC.parse_flat(F.col("formula_text")).alias("formula"))


@query(f"WITH {_FLAT} SELECT ref_id, el element, q quantity FROM fm")
def formula_parse_flat(spark, d):
    return _flat_formulas(spark, d).select("ref_id", F.explode("formula").alias("element", "quantity"))


@query()
def formula_parse(spark, d):
    """Every stated formula, with brackets too."""
    m = table(spark, d, "measured_crystals").where("formula_text is not null")
    return m.select("ref_id", F.explode(FC.parse(F.col("formula_text"))).alias("element", "quantity"))


_PHASE_PARTS = "part AS (SELECT label, unnest(map_keys(formula)) el, unnest(map_values(formula)) q FROM phases)"


@query(f"""WITH {_PHASE_PARTS}, g AS (SELECT label, count(*) n FROM part GROUP BY label)
SELECT label, string_agg(el || CASE WHEN q = 1 THEN '' ELSE q::VARCHAR END, '' ORDER BY el) formula FROM part GROUP BY label""")
def formula_text(spark, d):
    return table(spark, d, "phases").select("label", FC.to_text(F.col("formula"), alphabetic=True).alias("formula"))


@query("""SELECT label, '$' || list_aggregate([ '\\mathrm{' || k || '}' || CASE WHEN formula[k] = 1 THEN '' ELSE '_\\mathrm{' || formula[k] || '}' END for k in map_keys(formula)], 'string_agg', '') || '$' latex FROM phases WHERE cardinality(formula) > 0""")
def formula_latex(spark, d):
    return table(spark, d, "phases").where(F.size("formula") > 0).select("label", FC.to_latex(F.col("formula")).alias("latex"))


@query(f"""WITH {_PHASE_PARTS}, p AS (SELECT * FROM part WHERE q > 0), g AS (SELECT label, list_reduce(list(q::BIGINT), lambda a, b: gcd(a, b)) g, count(*) k FROM p GROUP BY label)
SELECT label, el element, CASE WHEN k = 1 THEN 1 ELSE q // g END quantity FROM p JOIN g USING (label)""")
def formula_reduce_int(spark, d):
    f = F.map_filter("formula", lambda _, v: v > 0)
    return table(spark, d, "phases").select("label", F.explode(FC.reduce_whole(f)).alias("element", "quantity"))


_KEYED = f"""WITH {_STRUCT}, ec AS (SELECT seq, e, count(*) k FROM st, unnest(els) t(e) WHERE e IS NOT NULL GROUP BY ALL),
gk AS (SELECT seq, list_reduce(list(k), lambda a, b: gcd(a, b)) g, count(*) kinds FROM ec GROUP BY seq),
rk AS (SELECT seq, string_agg(e || CASE WHEN kinds = 1 OR k = g THEN '' ELSE (k // g)::VARCHAR END, '' ORDER BY e) formula FROM ec JOIN gk USING (seq) GROUP BY seq)"""


@query(_KEYED + """, ph AS (SELECT label, [k for k in map_keys(formula) if formula[k] > 0] ks, formula FROM phases), pg AS (SELECT *, list_reduce([formula[k]::BIGINT for k in ks], lambda a, b: gcd(a, b)) g FROM ph WHERE len(ks) > 0),
pk AS (SELECT label, list_aggregate(list_transform(list_sort(ks), lambda k: k || CASE WHEN len(ks) = 1 OR formula[k] = g THEN '' ELSE (formula[k] // g)::VARCHAR END), 'string_agg', '') formula FROM pg)
SELECT seq, pk.label phase FROM rk JOIN pk USING (formula)""")
def formula_equal_join(spark, d):
    """Structures with the phases of the same composition."""
    s = _s(spark, d).select("seq", CMP.reduced_formula_key().alias("key"))
    p = table(spark, d, "phases").select(F.col("label").alias("phase"), F.map_filter("formula", lambda _, v: v > 0).alias("f")).where(F.size("f") > 0)
    return s.join(p.select("phase", FC.canonical(FC.reduce_whole(F.col("f"))).alias("key")), "key").select("seq", "phase")


@query(_KEYED + " SELECT seq, formula FROM rk")
def formula_reduced(spark, d):
    return _s(spark, d).select("seq", CMP.reduced_formula_key().alias("formula")).where("formula <> ''")


@query(f"""WITH {_PHASE_PARTS}, a AS (SELECT x.label l1, y.label l2 FROM phases x JOIN phases y ON x.label < y.label WHERE list_sort(map_keys(x.formula)) = list_sort(map_keys(y.formula))
 AND list_transform(list_sort(map_keys(x.formula)), lambda k: x.formula[k]) = list_transform(list_sort(map_keys(y.formula)), lambda k: y.formula[k])) SELECT l1 label_1, l2 label_2 FROM a""")
def formula_same(spark, d):
    """Pairs of phases with the same formula, joined on its canonical text and compared."""
    p = table(spark, d, "phases").select("label", "formula", FC.canonical(F.col("formula")).alias("key"))
    a, b = p.select(F.col("label").alias("label_1"), F.col("formula").alias("f1"), "key"), p.select(F.col("label").alias("label_2"), F.col("formula").alias("f2"), "key")
    return a.join(b, "key").where("label_1 < label_2").where(FC.same_formula(F.col("f1"), F.col("f2"))).select("label_1", "label_2")


# elements

_NAMES = "nm(el, number, name) AS (VALUES " + ", ".join(f"('{s}', {i + 1}, '{n}')" for i, (s, n) in enumerate(zip(E.SYMBOLS, E.NAMES))) + ")"
_USED = f"WITH {_STRUCT}, {_NAMES}, used AS (SELECT e el, count(*) n_sites FROM st, unnest(els) t(e) WHERE e IS NOT NULL GROUP BY e)"


def _used(spark, d):
    sites = _s(spark, d).select(F.explode("elements").alias("e")).select(C.symbol(F.col("e")).alias("element")).where("element is not null")
    return sites.groupBy("element").agg(F.count("*").alias("n_sites"))


@query(_USED + " SELECT el element, n_sites, number atomic_number, name FROM used LEFT JOIN nm USING (el)")
def element_names(spark, d):
    u = _used(spark, d)
    return u.select("element", "n_sites", E.atomic_number(F.col("element")).alias("atomic_number"), E.element_name(F.col("element")).alias("name"))


@query(f"{_USED}, {_values('m', E.MASSES)}, {_values('ve', E.VALENCE_ELECTRONS)} SELECT el element, m.v mass, ve.v::INT valence_electrons FROM used LEFT JOIN m USING (el) LEFT JOIN ve USING (el)")
def element_mass(spark, d):
    e = F.col("element")
    return _used(spark, d).select("element", E.atomic_mass(e).alias("mass"), E.valence_electrons(e).alias("valence_electrons"))


_RADII = ", ".join(_values(f"r_{k}", v) for k, v in E.RADII.items())


@query(f"{_USED}, {_RADII} SELECT el element, " + ", ".join(f"r_{k}.v {k}" for k in E.RADII) + " FROM used " + " ".join(f"LEFT JOIN r_{k} USING (el)" for k in E.RADII))
def element_radii(spark, d):
    return _used(spark, d).select("element", *[E.atomic_radius(F.col("element"), k).alias(k) for k in E.RADII])


@query(f"{_USED}, {_values('pa', E.SCALES['pauling'])}, {_values('al', E.SCALES['allen'])} SELECT el element, pa.v pauling, al.v allen FROM used LEFT JOIN pa USING (el) LEFT JOIN al USING (el)")
def element_electronegativity(spark, d):
    return _used(spark, d).select("element", *[E.electronegativity(F.col("element"), k).alias(k) for k in E.SCALES])


_GROUPS = "gr(el, g) AS (VALUES " + ", ".join(f"('{s}', '{g}')" for g in ["metal", *E.GROUPS] for s in E.members(g)) + ")"


@query(f"{_USED}, {_GROUPS} SELECT el element, g element_group FROM used JOIN gr USING (el)")
def element_group(spark, d):
    return _used(spark, d).select("element", F.explode(E.element_groups(F.col("element"))).alias("element_group"))


_CHALCOGENS = ", ".join(f"'{e}'" for e in E.members("chalcogen"))


@query(f"WITH {_STRUCT} SELECT seq, len([e for e in els if e IN ({_CHALCOGENS})])::BIGINT n FROM st")
def group_members(spark, d):
    """Number of chalcogen sites of each structure."""
    return _s(spark, d).select("seq", F.size(F.filter("elements", lambda e: F.coalesce(C.symbol(e).isin(*E.members("chalcogen")), F.lit(False)))).cast("long").alias("n"))


# units


def _k(u1, u2):
    return Q.conversion(u1, u2)[1]


@query(f"""SELECT seq, round(cell[1][1] * {_k('angstrom', 'bohr')!r}, 7) x_bohr, round(cell[1][1] * {_k('angstrom', 'nm')!r}, 8) x_nm FROM structures WHERE cell IS NOT NULL""")
def unit_convert_linear(spark, d):
    x = F.col("cell")[0][0]
    return _s(spark, d).where("cell is not null").select("seq", _r(Q.convert_units(x, "angstrom", "bohr"), 7, "x_bohr"), _r(Q.convert_units(x, "Angstrom", "nm"), 8, "x_nm"))


_WAVES = [("m", "eV"), ("m", "THz"), ("m", "angstrom-1")]


@query("SELECT event_id, " + ", ".join(f"{_k('nm', u)!r} / value in_{u.replace('-', '_')}" for _, u in _WAVES) + f", value * {_k('ev', 'thz')!r} e_thz, value * {_k('ev', 'cm-1')!r} e_cm, value * {_k('thz', 'nm-1')!r} f_nm FROM events WHERE value > 1e-6")
def unit_convert_reciprocal(spark, d):
    """Values read as wavelengths in nm, energies in eV and frequencies in THz."""
    v = F.col("value")
    wave = [Q.convert_units(v, "nm", u).alias(f"in_{u.replace('-', '_')}") for _, u in _WAVES]
    return table(spark, d, "events").where("value > 1e-6").select("event_id", *wave, Q.convert_units(v, "eV", "THz").alias("e_thz"), Q.convert_units(v, "eV", "cm-1").alias("e_cm"), Q.convert_units(v, "THz", "nm-1").alias("f_nm"))


@query(f"SELECT event_id, value * {_k('ha_per_bohr', 'ev_per_ang')!r} force, value * {_k('bar', 'pa')!r} pressure, value * {_k('j', 'kj_per_mol')!r} energy FROM events")
def unit_convert_more(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", Q.convert_units(v, "Ha_per_bohr", "eV_per_ang").alias("force"), Q.convert_units(v, "bar", "Pa").alias("pressure"), Q.convert_units(v, "J", "kJ_per_mol").alias("energy"))


@query("""WITH g AS (SELECT seq, try_cast(attributes['space_group'].d AS INT) n FROM structures)
SELECT seq, CASE WHEN n < 1 OR n > 230 THEN NULL WHEN n <= 2 THEN 'triclinic' WHEN n <= 15 THEN 'monoclinic' WHEN n <= 74 THEN 'orthorhombic' WHEN n <= 142 THEN 'tetragonal' WHEN n <= 167 THEN 'trigonal' WHEN n <= 194 THEN 'hexagonal' ELSE 'cubic' END crystal_system FROM g WHERE n IS NOT NULL""")
def crystal_systems(spark, d):
    n = F.col("attributes")["space_group"]["d"].try_cast("int")
    return _s(spark, d).where(n.isNotNull()).select("seq", Q.crystal_system(n).alias("crystal_system"))


# geometry

_FOLD = f"""WITH {_STRUCT}, {_CRYSTAL},
im AS (SELECT i, j, k FROM unnest(range(-1, 2)) a(i), unnest(range(-1, 2)) b(j), unnest(range(-1, 2)) c(k)),
rel AS (SELECT p.seq, q.site, (q.fx-p.fx+i)*p.ax + (q.fy-p.fy+j)*p.bx + (q.fz-p.fz+k)*p.cx dx, (q.fx-p.fx+i)*p.ay + (q.fy-p.fy+j)*p.by_ + (q.fz-p.fz+k)*p.cy dy,
  (q.fx-p.fx+i)*p.az + (q.fy-p.fy+j)*p.bz + (q.fz-p.fz+k)*p.cz dz, i, j, k FROM fr p JOIN fr q USING (seq), im WHERE p.site = 0 AND q.site BETWEEN 1 AND 3),
nr AS (SELECT seq, site, dx, dy, dz, sqrt(dx*dx+dy*dy+dz*dz) d, row_number() OVER (PARTITION BY seq, site ORDER BY dx*dx+dy*dy+dz*dz) r FROM rel),
nx AS (SELECT * FROM nr WHERE r = 1)"""


def _crystals(spark, d):
    return _s(spark, d).where("cell is not null")


@query(_FOLD + " SELECT seq, 0::BIGINT site_1, site::BIGINT site_2, round(d, 5) distance FROM nx")
def distance_min_image(spark, d):
    return SG.site_distances(_crystals(spark, d), 0, [1]).union(SG.site_distances(_crystals(spark, d), 0, [2])).union(SG.site_distances(_crystals(spark, d), 0, [3])).select("seq", "site_1", "site_2", _r("distance", 5))


@query(_FOLD + """, u AS (SELECT a.seq, (SELECT 1) o, a.d d1, b.d d2, a.dx*b.dx+a.dy*b.dy+a.dz*b.dz dt, a.dx ax, a.dy ay, a.dz az, b.dx bx, b.dy by_, b.dz bz FROM nx a JOIN nx b ON a.seq = b.seq AND a.site = 1 AND b.site = 2)
SELECT seq, round(degrees(acos(greatest(-1, least(1, dt / (d1 * d2))))), 2) angle FROM u WHERE abs(dt / (d1 * d2)) < 0.99999 AND NOT EXISTS (SELECT 1 FROM nr z WHERE z.seq = u.seq AND z.site IN (1, 2) AND z.r = 2 AND z.d - CASE WHEN z.site = 1 THEN u.d1 ELSE u.d2 END < 1e-4)""")
def angle(spark, d):
    """Angles at the first site; those for which another image is as near, so that either could be meant, are left out, and so are straight ones."""
    a = SG.site_angles(_crystals(spark, d), 0, 1, 2, apart=1e-4).where("angle between 0.3 and 179.7")
    return a.where(F.abs(F.cos(F.radians("angle"))) < 0.99999).select("seq", _r("angle", 2))


@query(f"""WITH c AS (SELECT seq, cell FROM structures WHERE cell IS NOT NULL), v AS (SELECT seq, cell[1][1] ax, cell[1][2] ay, cell[1][3] az, cell[2][1] bx, cell[2][2] by_, cell[2][3] bz, cell[3][1] cx, cell[3][2] cy, cell[3][3] cz FROM c),
w AS (SELECT *, abs(ax*(by_*cz-bz*cy) - ay*(bx*cz-bz*cx) + az*(bx*cy-by_*cx)) v FROM v)
SELECT seq, round((by_*cz-bz*cy) * {2 * math.pi!r} / v, 6) + 0.0 r11, round((bz*cx-bx*cz) * {2 * math.pi!r} / v, 6) + 0.0 r12, round((ax*by_-ay*bx) * {2 * math.pi!r} / v, 6) + 0.0 r33 FROM w""")
def reciprocal_cell(spark, d):
    r = G.reciprocal_cell(F.col("cell"))
    return _crystals(spark, d).select("seq", _r(r[0][0], 6, "r11"), _r(r[0][1], 6, "r12"), _r(r[2][2], 6, "r33"))


_PAR = "a * 1.0 x11, b * cos(radians(g)) x21, b * sin(radians(g)) x22, c * cos(radians(be)) x31, c * (cos(radians(al)) - cos(radians(be)) * cos(radians(g))) / sin(radians(g)) x32"


@query(f"""WITH p AS (SELECT ref_id, cell_a a, cell_b b, cell_c c, coalesce(alpha, 90) al, coalesce(beta, 90) be, coalesce(gamma, 90) g FROM measured_crystals WHERE cell_a IS NOT NULL AND cell_b IS NOT NULL AND cell_c IS NOT NULL), q AS (SELECT *, {_PAR} FROM p)
SELECT ref_id, round(x11, 6) x11, round(x21, 6) x21, round(x22, 6) x22, round(x31, 6) x31, round(x32, 6) x32, round(sqrt(greatest(c*c - x31*x31 - x32*x32, 0)), 4) x33 FROM q""")
def cell_from_parameters(spark, d):
    right = lambda c: F.coalesce(c, F.lit(90.0))
    m = table(spark, d, "measured_crystals").where("cell_a is not null and cell_b is not null and cell_c is not null")
    cell = G.cell_from_parameters(F.col("cell_a"), F.col("cell_b"), F.col("cell_c"), right(F.col("alpha")), right(F.col("beta")), right(F.col("gamma")))
    d2 = m.select("ref_id", cell.alias("m"))
    at = lambda i, k, n, p=6: _r(F.col("m")[i][k], p, n)
    return d2.select("ref_id", at(0, 0, "x11"), at(1, 0, "x21"), at(1, 1, "x22"), at(2, 0, "x31"), at(2, 1, "x32"), at(2, 2, "x33", 4))


# neighbours: pairs within 4.5 angstrom from SQL, in as many cells as that reaches

RADIUS = 4.5
_NB = f"""WITH {_STRUCT}, {_CRYSTAL}, hc AS (SELECT DISTINCT seq, ax, ay, az, bx, by_, bz, cx, cy, cz, abs(v) v FROM fr),
rg AS (SELECT seq, ceil({RADIUS} * sqrt(pow(by_*cz-bz*cy,2)+pow(bz*cx-bx*cz,2)+pow(bx*cy-by_*cx,2)) / v)::INT na, ceil({RADIUS} * sqrt(pow(cy*az-cz*ay,2)+pow(cz*ax-cx*az,2)+pow(cx*ay-cy*ax,2)) / v)::INT nb,
  ceil({RADIUS} * sqrt(pow(ay*bz-az*by_,2)+pow(az*bx-ax*bz,2)+pow(ax*by_-ay*bx,2)) / v)::INT nc FROM hc),
im AS (SELECT seq, i, j, k FROM rg, unnest(range(-na, na + 1)) a(i), unnest(range(-nb, nb + 1)) b(j), unnest(range(-nc, nc + 1)) c(k)),
nb AS (SELECT p.seq, p.site, p.element, q.site nbr, q.element nbr_element, abs(p.v) v, i, j, k, sqrt(
  pow((q.fx-p.fx+i)*p.ax + (q.fy-p.fy+j)*p.bx + (q.fz-p.fz+k)*p.cx, 2) + pow((q.fx-p.fx+i)*p.ay + (q.fy-p.fy+j)*p.by_ + (q.fz-p.fz+k)*p.cy, 2)
  + pow((q.fx-p.fx+i)*p.az + (q.fy-p.fy+j)*p.bz + (q.fz-p.fz+k)*p.cz, 2)) distance FROM fr p JOIN fr q USING (seq) JOIN im USING (seq)),
nn AS (SELECT * FROM nb WHERE distance <= {RADIUS} AND NOT (site = nbr AND i = 0 AND j = 0 AND k = 0))"""


@query(_NB + ", m AS (SELECT *, min(distance) OVER (PARTITION BY seq, site) dm FROM nn) SELECT seq, site::BIGINT site, count(*) total_cn, round(min(distance), 4) min_dist, round(max(distance), 4) max_dist, round(avg(distance), 4) avg_dist FROM m WHERE distance <= 1.1 * dm GROUP BY seq, site")
def coord_minimum_distance(spark, d):
    c = N.coordination_sites(_crystals(spark, d), "minimum_distance", RADIUS, delta=0.1).where("total_cn > 0")
    return c.select("seq", "site", "total_cn", _r("min_dist", 4), _r("max_dist", 4), _r("avg_dist", 4))


@query(_NB + ", k AS (SELECT *, row_number() OVER (PARTITION BY seq, site ORDER BY round(distance, 6), nbr) r FROM nn) SELECT seq, site::BIGINT site, count(*) total_cn, round(min(distance), 4) min_dist, round(max(distance), 4) max_dist, round(avg(distance), 4) avg_dist FROM k WHERE r <= 5 GROUP BY seq, site")
def coord_n_nearest(spark, d):
    c = N.coordination_sites(_crystals(spark, d), "n_nearest_neighbours", RADIUS, k=5).where("total_cn > 0")
    return c.select("seq", "site", "total_cn", _r("min_dist", 4), _r("max_dist", 4), _r("avg_dist", 4))


@query(f"{_NB}, {_values('ra', E.RADII['chen_manz'])}, b AS (SELECT nn.* FROM nn JOIN ra a ON a.el = element JOIN ra c ON c.el = nbr_element WHERE distance <= a.v + c.v) SELECT seq, site::BIGINT site, nbr::BIGINT nbr, element, nbr_element, count(*) n, round(min(distance), 4) distance FROM b GROUP BY ALL")
def coord_radius(spark, d):
    p = N.pairs(_crystals(spark, d), RADIUS, "atomic_radius")
    return p.groupBy("seq", "site", "nbr", "element", "nbr_element").agg(F.count("*").alias("n"), _r(F.min("distance"), 4, "distance"))


@query(f"""{_NB}, {_values('ra', E.RADII['chen_manz'])}, b AS (SELECT nn.* FROM nn JOIN ra a ON a.el = element JOIN ra c ON c.el = nbr_element WHERE distance <= a.v + c.v),
prs AS (SELECT f.seq, f.site, f.element, g.element nbr_element FROM fr f JOIN (SELECT DISTINCT seq, element FROM fr) g USING (seq) WHERE f.element IS NOT NULL AND g.element IS NOT NULL),
cn AS (SELECT p.seq, p.site, p.element, p.nbr_element, count(b.site) n FROM prs p LEFT JOIN b ON b.seq = p.seq AND b.site = p.site AND b.nbr_element = p.nbr_element GROUP BY ALL),
nrs AS (SELECT seq, element, nbr_element, round(avg(n), 5) nrs_avg, round(coalesce(stddev_samp(n), 0), 5) nrs_stdev, max(n)::DOUBLE nrs_max, min(n)::DOUBLE nrs_min FROM cn GROUP BY ALL),
ds AS (SELECT seq, element, nbr_element, round(avg(distance), 4) distance_avg, round(coalesce(stddev_samp(distance), 0), 4) distance_stdev, round(max(distance), 4) distance_max, round(min(distance), 4) distance_min, count(*) n_bonds FROM b GROUP BY ALL)
SELECT seq, element, nbr_element, coalesce(n_bonds, 0) n_bonds, distance_avg, distance_stdev, distance_max, distance_min, nrs_avg, nrs_stdev, nrs_max, nrs_min FROM nrs LEFT JOIN ds USING (seq, element, nbr_element)""")
def coord_statistics(spark, d):
    c = N.coordination_statistics(_crystals(spark, d), "atomic_radius", RADIUS)
    return c.select("seq", "element", "nbr_element", "n_bonds", *[_r(f"distance_{f}", 4) for f in ("avg", "stdev", "max", "min")], _r("nrs_avg", 5), _r("nrs_stdev", 5), "nrs_max", "nrs_min")


@query()
def coord_econ(spark, d):
    c = N.coordination_sites(_s(spark, d), "econ", 10.0)
    return c.select("seq", "site", "element", "total_cn", _r("avg_dist", 4))


@query()
def coord_voronoi(spark, d):
    """Coordination by the solid angles of Voronoi faces."""
    return N.coordination_statistics(_crystals(spark, d), "voronoi", 8.0).select("seq", "element", "nbr_element", "n_bonds", _r("distance_avg", 4), _r("nrs_avg", 4))


@query(f"""{_NB}, cn AS (SELECT seq, element, count(*) n1 FROM fr WHERE element IS NOT NULL GROUP BY ALL), h AS (SELECT seq, element, nbr_element, floor(distance / 0.25)::BIGINT bin FROM nn WHERE distance < 4.0)
SELECT seq, element, nbr_element, bin, round(count(*) * 3 / (4 * {math.pi!r} * (pow(bin * 0.25 + 0.25, 3) - pow(bin * 0.25, 3)) * n1), 8) value FROM h JOIN cn USING (seq, element) WHERE nbr_element IS NOT NULL GROUP BY seq, element, nbr_element, bin, n1""")
def prdf_normalised(spark, d):
    return N.pair_distribution(_crystals(spark, d), 4.0, 0.25).select("seq", "element", "nbr_element", "bin", _r("value", 8))


_TAPS = SE.kernel(0.6)
_TAP_ROWS = ", ".join(f"({k - len(_TAPS) // 2}, {w!r})" for k, w in enumerate(_TAPS))
_FF = f"""{_NB}, cn AS (SELECT seq, element, count(*) n1 FROM fr WHERE element IS NOT NULL GROUP BY ALL),
h AS (SELECT n.seq, n.element, n.nbr_element, floor(distance / 0.25)::BIGINT bin, sum(v / (4 * {math.pi!r} * 0.25 * distance * distance * a.n1 * b.n1)) y FROM nn n JOIN cn a ON a.seq = n.seq AND a.element = n.element JOIN cn b ON b.seq = n.seq AND b.element = n.nbr_element
  WHERE distance < 4.0 AND n.element <= n.nbr_element GROUP BY ALL),
tap(k, w) AS (VALUES {_TAP_ROWS}),
pr AS (SELECT a.seq, a.element, b.element nbr_element, a.n1 * b.n1 w0 FROM cn a JOIN cn b ON a.seq = b.seq AND a.element <= b.element),
grd AS (SELECT pr.*, bin FROM pr, unnest(range(0, 16)) t(bin)),
ff AS (SELECT g.seq, g.element, g.nbr_element, g.w0, g.bin, coalesce(sum(h.y * tap.w), 0) - 1 y FROM grd g JOIN tap ON true LEFT JOIN h ON h.seq = g.seq AND h.element = g.element AND h.nbr_element = g.nbr_element AND h.bin = g.bin - tap.k GROUP BY ALL)"""


@query(_FF + " SELECT seq, element, nbr_element, bin::BIGINT bin, round(y, 5) value FROM ff")
def ffingerprint(spark, d):
    f = N.fingerprints(_crystals(spark, d), 4.0, 0.25, 0.6)
    return f.select("seq", "element", "nbr_element", F.posexplode("values").alias("bin", "value")).select("seq", "element", "nbr_element", F.col("bin").cast("long").alias("bin"), _r("value", 5))


@query(_FF + ", tw AS (SELECT seq, sum(w0) w FROM pr GROUP BY seq), n AS (SELECT seq, sum(n1) n FROM cn GROUP BY seq) SELECT ff.seq, round(sum(w0 / tw.w * y * y) * 0.25 * pow(max(hc.v) / max(n.n), 1.0 / 3), 4) total FROM ff JOIN tw USING (seq) JOIN hc ON hc.seq = ff.seq JOIN n ON n.seq = ff.seq GROUP BY ff.seq")
def order_parameter(spark, d):
    return N.order_parameter(_crystals(spark, d), 4.0, 0.25, 0.6).select("seq", _r("total", 4))


@query(_FF + ", " + _KEYED[_KEYED.index("ec AS") :] + """,
vec AS (SELECT seq, element, nbr_element, bin, y * sqrt(w0::DOUBLE) x FROM ff), nrm AS (SELECT seq, sqrt(sum(x * x)) l FROM vec GROUP BY seq),
kq AS (SELECT rk.seq, rk.formula, nrm.l FROM rk JOIN nrm USING (seq)),
pq AS (SELECT a.seq s1, b.seq s2, a.l l1, b.l l2 FROM kq a JOIN kq b ON a.formula = b.formula AND a.seq < b.seq),
dd AS (SELECT s1, s2, 0.5 * (1 - sum(u.x * w.x) / any_value(l1 * l2)) dist FROM pq JOIN vec u ON u.seq = s1 JOIN vec w ON w.seq = s2 AND w.element = u.element AND w.nbr_element = u.nbr_element AND w.bin = u.bin GROUP BY s1, s2)
SELECT s2 seq, min(s1) duplicate_of FROM dd WHERE dist <= 0.0005 GROUP BY s2""")
def find_duplicates(spark, d):
    """Duplicates by fingerprint among structures of the same composition."""
    return CMP.find_duplicates_by_fingerprint(_crystals(spark, d), 0.0005, 4.0, 0.25, 0.6)


@query(_KEYED + """, sg AS (SELECT rk.seq, formula, attributes['space_group'].d g FROM rk JOIN structures USING (seq) WHERE attributes['space_group'].d IS NOT NULL), f AS (SELECT formula, g, min(seq) duplicate_of FROM sg GROUP BY ALL)
SELECT seq, duplicate_of FROM sg JOIN f USING (formula, g) WHERE seq <> duplicate_of""")
def find_duplicates_comp_sym(spark, d):
    return CMP.duplicates_by_composition_and_symmetry(_s(spark, d), F.col("attributes")["space_group"]["d"])


@query()
def compare_direct(spark, d):
    """Records of the same label compared directly with the first of it."""
    s = _s(spark, d).where("cell is not null")
    first = s.groupBy("label").agg(F.min("seq").alias("seq_1"))
    pairs = s.select("label", F.col("seq").alias("seq_2")).join(first, "label").where("seq_1 <> seq_2").select("seq_1", "seq_2")
    return CMP.compare_pairs(s, pairs)


@query()
def equivalent_sites(spark, d):
    return CMP.equivalent_sites(_crystals(spark, d), "minimum_distance", RADIUS)


@query()
def equivalent_sites_ffingerprint(spark, d):
    return CMP.equivalent_sites_by_fingerprint(_crystals(spark, d), 1e-3, 4.0, 0.25, 0.6)


@query(f"{_NB}, {_values('ra', E.RADII['chen_manz'])}, e AS (SELECT seq, site, nbr, element, nbr_element, distance FROM nn JOIN ra a ON a.el = element JOIN ra c ON c.el = nbr_element WHERE distance <= a.v + c.v) SELECT seq, site::BIGINT site, nbr::BIGINT nbr, count(*) edges, dense_rank() OVER (PARTITION BY seq, site ORDER BY count(*) DESC, nbr)::INT rank FROM e GROUP BY seq, site, nbr")
def graph_rank(spark, d):
    """Edges of the coordination graph with how often a pair is joined, ranked per site. Ranks are within a site, of few partners."""
    from pyspark.sql import Window

    e = N.pairs(_crystals(spark, d), RADIUS, "atomic_radius").groupBy("seq", "site", "nbr").agg(F.count("*").alias("edges"))
    return e.withColumn("rank", F.dense_rank().over(Window.partitionBy("seq", "site").orderBy(F.desc("edges"), "nbr")))


# manipulation

_PRE = f"WITH {_STRUCT}"
_SITES = "unnest(range(1, len(positions) + 1)) t(i)"


@query(f"{_PRE} SELECT seq, (row_number() OVER (PARTITION BY seq ORDER BY i) - 1)::BIGINT site, els[i] element, positions[i][1] x, positions[i][2] y, positions[i][3] z FROM st, {_SITES} WHERE len(els) = len(positions) AND els[i] IS DISTINCT FROM 'Te'")
def delete_atoms_sites(spark, d):
    s = M.delete_atoms(_s(spark, d).where(F.size("elements") == F.size("positions")), ["Te"]).where("elements is not null")
    rows = s.select("seq", F.posexplode(F.arrays_zip("elements", "positions")).alias("site", "p"))
    return rows.select("seq", F.col("site").cast("long").alias("site"), C.symbol(F.col("p.elements")).alias("element"), *[F.col("p.positions")[k].alias("xyz"[k]) for k in range(3)])


_STRAIN = [[1.02137, 0.01371, 0.0], [0.0, 0.98291, 0.0], [0.0, 0.03173, 1.0]]


@query("SELECT seq, i::BIGINT vector, " + ", ".join(f"round(cell[i + 1][1] * {_STRAIN[0][k]} + cell[i + 1][2] * {_STRAIN[1][k]} + cell[i + 1][3] * {_STRAIN[2][k]}, 6) {'xyz'[k]}" for k in range(3)) + " FROM structures, unnest(range(0, 3)) t(i) WHERE cell IS NOT NULL")
def strain_cell(spark, d):
    """Cells under a strain matrix, every vector."""
    s = M.scale_unit_cell(_crystals(spark, d), _STRAIN).select("seq", F.posexplode("cell").alias("vector", "v"))
    return s.select("seq", F.col("vector").cast("long").alias("vector"), *[_r(F.col("v")[k], 6, "xyz"[k]) for k in range(3)])


@query("SELECT seq, round(cell[1][1] * pow(1 - 2.0 / 50.0, 1.0 / 3), 6) a_x, round(cell[3][3] * pow(1 - 2.0 / 50.0, 1.0 / 3), 6) c_z FROM structures WHERE cell IS NOT NULL")
def pressure_cell(spark, d):
    s = M.scale_unit_cell(_crystals(spark, d), pressure=2.0, bulk_modulus=50.0)
    return s.select("seq", _r(F.col("cell")[0][0], 6, "a_x"), _r(F.col("cell")[2][2], 6, "c_z"))


@query(f"""{_PRE}, {_CRYSTAL} SELECT seq, image * n_sites + site site, element, round(((fx + i) / 3) % 1, 6) fx, round(((fy + j) / 1) % 1, 6) fy, round(((fz + k) / 3) % 1, 6) fz
FROM fr, (SELECT i, j, k, (i * 3 + j * 3 + k)::BIGINT image FROM unnest(range(0, 3)) a(i), unnest(range(0, 1)) b(j), unnest(range(0, 3)) c(k))""")
def supercell_sites(spark, d):
    """All sites of 3 x 1 x 3 supercells."""
    s = M.create_supercell(_crystals(spark, d).where(F.size("elements") == F.size("positions")), [3, 1, 3]).select("seq", F.posexplode(F.arrays_zip("elements", "positions")).alias("site", "p"))
    return s.select("seq", F.col("site").cast("long").alias("site"), C.symbol(F.col("p.elements")).alias("element"), *[_r(F.col("p.positions")[k], 6, n) for k, n in enumerate(("fx", "fy", "fz"))])


@query(f"""{_PRE}, {_values('ra', E.RADII['covalent'])}, o AS (SELECT seq, cell, [CASE WHEN e = 'Te' THEN 'Se' WHEN e = 'Cs' THEN 'Rb' ELSE e END for e in els] ne, els FROM st WHERE cell IS NOT NULL),
k AS (SELECT seq, cell, ne, els[i] a, ne[i] b, i FROM o, unnest(range(1, len(els) + 1)) t(i)),
f AS (SELECT seq, any_value(cell) cell, any_value(ne) ne, sum(CASE WHEN a = b THEN 1.0 ELSE coalesce(y.v / x.v, 1.0) END) / count(*) r FROM k LEFT JOIN ra x ON x.el = a LEFT JOIN ra y ON y.el = b GROUP BY seq)
SELECT seq, list_aggregate(ne, 'string_agg', '-') elements, round(cell[1][1] * r, 6) a_x, round(cell[3][3] * r, 6) c_z FROM f""")
def substitute_scaled(spark, d):
    """Te to Se and Cs to Rb, cells scaled by the radii."""
    s = M.substitute_elements(_crystals(spark, d), [("Te", "Se"), ("Cs", "Rb")])
    return s.select("seq", F.array_join("elements", "-").alias("elements"), _r(F.col("cell")[0][0], 6, "a_x"), _r(F.col("cell")[2][2], 6, "c_z"))


@query(f"""{_PRE}, m AS (SELECT seq, i, positions[i][1] x, positions[i][2] y, positions[i][3] z FROM st, {_SITES} WHERE cell IS NULL), c AS (SELECT seq, avg(x) mx, avg(y) my FROM m GROUP BY seq)
SELECT m.seq, (i - 1)::BIGINT site, round(mx + (x - mx) * cos(radians(37)) - (y - my) * sin(radians(37)), 5) x, round(my + (x - mx) * sin(radians(37)) + (y - my) * cos(radians(37)), 5) y, z FROM m JOIN c USING (seq)""")
def rotate_molecules(spark, d):
    """Molecules turned about z."""
    s = M.rotate_structure(_s(spark, d).where("cell is null"), 37.0, [0, 0, 1]).select("seq", F.posexplode("positions").alias("site", "p"))
    return s.select("seq", F.col("site").cast("long").alias("site"), _r(F.col("p")[0], 5, "x"), _r(F.col("p")[1], 5, "y"), F.col("p")[2].alias("z"))


@query(f"{_PRE} SELECT seq, (i - 1)::BIGINT site, round(positions[i][1] + CASE WHEN i <= 2 THEN 0.5 ELSE 0 END, 7) x, round(positions[i][3] - CASE WHEN i <= 2 THEN 1.0 ELSE 0 END, 7) z FROM st, {_SITES} WHERE cell IS NULL")
def translate_molecules(spark, d):
    """The first two sites of molecules moved."""
    s = M.translate_structure(_s(spark, d).where("cell is null"), [0.5, 0.0, -1.0], sites=[0, 1]).select("seq", F.posexplode("positions").alias("site", "p"))
    return s.select("seq", F.col("site").cast("long").alias("site"), _r(F.col("p")[0], 7, "x"), _r(F.col("p")[2], 7, "z"))


@query(f"""{_PRE}, ok AS (SELECT seq, len(els) n, NOT coalesce(list_bool_or([sqrt(pow(p[1] - 1.0, 2) + pow(p[2] - 1.0, 2) + pow(p[3] - g, 2)) < 0.8 for p in positions for g in [1 - 0.485, 1 + 0.485]]), false) added FROM st WHERE cell IS NULL AND len(els) > 0)
SELECT seq, added, (n + CASE WHEN added THEN 2 ELSE 0 END)::BIGINT n FROM ok""".replace("for p in positions for g in [1 - 0.485, 1 + 0.485]", "for p in positions").replace("pow(p[3] - g, 2)) < 0.8", "pow(p[3] - 0.515, 2)) < 0.8 OR sqrt(pow(p[1] - 1.0, 2) + pow(p[2] - 1.0, 2) + pow(p[3] - 1.485, 2)) < 0.8"))
def add_guest(spark, d):
    """OH added to molecules at a point, where there is room."""
    s = M.add_structure_position(_s(spark, d).where("cell is null").where(F.size("elements") > 0), [1.0, 1.0, 1.0], "OH", 0.8)
    return s.select("seq", "added", F.size("elements").cast("long").alias("n"))


@query("""WITH b AS (SELECT seq, label, cell[1][1] a FROM structures WHERE cell IS NOT NULL)
SELECT seq, label || 'x0' label, round(a * 1.1, 6) a FROM b UNION ALL SELECT seq, label || 'x1', round(a * 1.1 * 1.1, 6) FROM b""")
def pipeline_fanout(spark, d):
    """A pipeline whose step is applied once to one copy and twice to the other."""
    out = M.run_pipeline(_crystals(spark, d), [(M.scale_unit_cell, {"factors": 1.1}, [1, 2])])
    return out.select("seq", "label", _r(F.col("cell")[0][0], 6, "a"))
