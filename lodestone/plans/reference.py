"""Queries on the operators for collections of structures, phases and series, each with the same result in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import units as U
from lodestone.operators import bands as B
from lodestone.operators import collection as C
from lodestone.operators import series as SE
from lodestone.operators import stability as S
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


def _sym(x: str) -> str:
    s = rf"regexp_extract(trim({x}), '^([A-Za-z]{{1,2}})[0-9]*[+-]?[0-9]*$', 1)"
    low = f"upper(substr({s}, 1, 1)) || lower(substr({s}, 2))"
    return f"(CASE WHEN {s} = '' THEN NULL WHEN upper({s}) = 'D' THEN 'H' ELSE {low} END)"


_STRUCT = f"st AS (SELECT seq, label, [{_sym('e')} for e in elements] els, positions, cell, len(elements) n_sites, mtime FROM structures)"
_VEC = ", ".join(f"cell[{i + 1}][{k + 1}] {'abc'[i]}{'xyz'[k]}" for i in range(3) for k in range(3))
_CRYSTAL = f"""cr AS (SELECT seq, els, positions, n_sites, {_VEC}, list_max([abs(x) for x in flatten(positions)]) <= 2.0 frac FROM st WHERE cell IS NOT NULL),
cv AS (SELECT *, ax*(by_*cz-bz*cy) - ay*(bx*cz-bz*cx) + az*(bx*cy-by_*cx) v FROM cr),
raw AS (SELECT cv.*, i - 1 site, els[i] element, positions[i][1] x, positions[i][2] y, positions[i][3] z FROM cv, unnest(range(1, n_sites + 1)) t(i)),
fr0 AS (SELECT *, CASE WHEN frac THEN x ELSE (x*(by_*cz-bz*cy) + y*(bz*cx-bx*cz) + z*(bx*cy-by_*cx)) / v END gx,
  CASE WHEN frac THEN y ELSE (x*(cy*az-cz*ay) + y*(cz*ax-cx*az) + z*(cx*ay-cy*ax)) / v END gy,
  CASE WHEN frac THEN z ELSE (x*(ay*bz-az*by_) + y*(az*bx-ax*bz) + z*(ax*by_-ay*bx)) / v END gz FROM raw),
fr AS (SELECT *, gx - floor(gx) fx, gy - floor(gy) fy, gz - floor(gz) fz FROM fr0)""".replace(" by FROM", " by_ FROM")
_CRYSTAL = _CRYSTAL.replace("cell[2][2] by,", "cell[2][2] by_,")
_NBR = f"""WITH {_STRUCT}, {_CRYSTAL},
nb AS (SELECT p.seq, p.site, p.element, q.site nbr, q.element nbr_element, sqrt(
  pow((q.fx-p.fx+i)*p.ax + (q.fy-p.fy+j)*p.bx + (q.fz-p.fz+k)*p.cx, 2) + pow((q.fx-p.fx+i)*p.ay + (q.fy-p.fy+j)*p.by_ + (q.fz-p.fz+k)*p.cy, 2)
  + pow((q.fx-p.fx+i)*p.az + (q.fy-p.fy+j)*p.bz + (q.fz-p.fz+k)*p.cz, 2)) distance
  FROM fr p JOIN fr q USING (seq), unnest(range(-1, 2)) a(i), unnest(range(-1, 2)) b(j), unnest(range(-1, 2)) c(k)),
nn AS (SELECT * FROM nb WHERE distance <= 3.2 AND distance > 1e-6)"""


def _s(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "structures")


@query(f"WITH {_STRUCT} SELECT seq, e element, count(*) n_atoms, n_sites::BIGINT n_sites, round(count(*) / n_sites, 6) concentration FROM st, unnest(els) t(e) GROUP BY seq, n_sites, e")
def elem_counts(spark, d):
    c = C.element_counts(_s(spark, d))
    return c.select("seq", "element", "n_atoms", F.col("n_sites").cast("long").alias("n_sites"), F.round("concentration", 6).alias("concentration"))


@query(f"""WITH {_STRUCT}, c AS (SELECT seq, e, count(*) k FROM st, unnest(els) t(e) WHERE e IS NOT NULL GROUP BY ALL)
SELECT seq, string_agg(e || CASE WHEN k = 1 THEN '' ELSE k::VARCHAR END, '' ORDER BY e) formula FROM c GROUP BY seq""")
def formula_string(spark, d):
    return _s(spark, d).select("seq", C.formula_text().alias("formula"))


@query(f"""WITH {_STRUCT} SELECT seq, len([e for e in els if e = 'Cs'])::BIGINT n_cs, len([e for e in els if e = 'Te'])::BIGINT n_te, n_sites::BIGINT n_atoms FROM st""")
def nr_atoms_pivot(spark, d):
    n = lambda x: F.size(F.filter("elements", lambda e: C.symbol(e) == x)).cast("long")
    return _s(spark, d).select("seq", n("Cs").alias("n_cs"), n("Te").alias("n_te"), F.size("elements").cast("long").alias("n_atoms"))


@query(f"WITH {_STRUCT} SELECT seq, label FROM st WHERE len([e for e in els if e = 'Cs']) / n_sites BETWEEN 0.25 AND 0.5")
def conc_constraint(spark, d):
    return C.within_concentration(_s(spark, d), "Cs", 0.25, 0.5).select("seq", "label")


@query(f"WITH {_STRUCT} SELECT seq, label FROM st WHERE len([e for e in els if e NOT IN ('Cs', 'Te') OR e IS NULL]) = 0")
def element_set_constraint(spark, d):
    return C.only_elements(_s(spark, d), ["Cs", "Te"]).select("seq", "label")


@query(f"WITH {_STRUCT} SELECT seq, label FROM st WHERE len(list_distinct(els)) > 1")
def neglect_elemental(spark, d):
    return C.without_elemental(_s(spark, d)).select("seq", "label")


@query("SELECT seq, attributes['band_gap'].d band_gap FROM structures WHERE attributes['band_gap'].d BETWEEN 0.5 AND 2.0")
def attr_constraint(spark, d):
    g = F.col("attributes")["band_gap"]["d"]
    return _s(spark, d).where(g.between(0.5, 2.0)).select("seq", g.alias("band_gap"))


@query("SELECT label, max(seq) seq FROM structures GROUP BY label")
def collection_upsert(spark, d):
    return C.latest(_s(spark, d)).select("label", "seq")


@query(f"WITH {_STRUCT} SELECT DISTINCT e element FROM st, unnest(els) t(e) WHERE e IS NOT NULL")
def collection_distinct_elements(spark, d):
    return _s(spark, d).select(F.explode(F.array_distinct("elements")).alias("e")).select(C.symbol(F.col("e")).alias("element")).where("element is not null").distinct()


@query("SELECT label, count(*) n, min(seq) first_seq, max(seq) last_seq FROM structures GROUP BY label HAVING count(*) > 1")
def dedup_by_label(spark, d):
    return _s(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).where("n > 1")


_LEN = "round(sqrt(list_sum([x*x for x in cell[{0}]])), 5)"


@query(f"""WITH g AS (SELECT seq, sqrt(list_dot_product(cell[1], cell[1])) a, sqrt(list_dot_product(cell[2], cell[2])) b, sqrt(list_dot_product(cell[3], cell[3])) c,
 list_dot_product(cell[2], cell[3]) bc, list_dot_product(cell[1], cell[3]) ac, list_dot_product(cell[1], cell[2]) ab, {_VEC.replace(' by,', ' by_,')} FROM structures WHERE cell IS NOT NULL)
SELECT seq, round(a, 7) a, round(b, 7) b, round(c, 7) c, round(degrees(acos(bc/(b*c))), 3) alpha, round(degrees(acos(ac/(a*c))), 3) beta, round(degrees(acos(ab/(a*b))), 3) gamma,
 round(abs(ax*(by_*cz-bz*cy) - ay*(bx*cz-bz*cx) + az*(bx*cy-by_*cx)), 5) volume FROM g""")
def lattice_params(spark, d):
    r = lambda c, k: F.round(c, k).alias(c)
    return C.lattice(_s(spark, d)).select("seq", *[r(c, 7) for c in "abc"], *[r(c, 3) for c in ("alpha", "beta", "gamma")], r("volume", 5))


@query(f"WITH {_STRUCT}, {_CRYSTAL} SELECT seq, site::BIGINT site, element, round(fx, 7) % 1 fx, round(fy, 7) % 1 fy, round(fz, 7) % 1 fz FROM fr")
def wrap_positions(spark, d):
    f = C.with_fractions(_s(spark, d))
    return f.select("seq", F.col("site").cast("long").alias("site"), "element", *[(F.round(c, 7) % 1).alias(c) for c in ("fx", "fy", "fz")])


@query(f"WITH {_STRUCT}, {_CRYSTAL} SELECT seq, element, count(*) n, round(avg(fx / 2 + i / 2.0), 4) mean_x FROM fr, unnest(range(0, 2)) a(i), unnest(range(0, 2)) b(j) GROUP BY seq, element")
def supercell(spark, d):
    s = C.supercell(C.with_fractions(_s(spark, d)), 2, 2, 1)
    return s.groupBy("seq", "element").agg(F.count("*").alias("n"), F.round(F.avg("fx"), 4).alias("mean_x"))


@query(_NBR + " SELECT seq, element, nbr_element, count(DISTINCT site) n_sites, count(*) n_bonds, round(avg(distance), 4) mean_distance, round(min(distance), 4) min_distance, round(max(distance), 4) max_distance FROM nn GROUP BY ALL")
def coord_stats(spark, d):
    c = C.coordination(C.neighbours(_s(spark, d), 3.2))
    return c.select("seq", "element", "nbr_element", "n_sites", "n_bonds", *[F.round(x, 4).alias(x) for x in ("mean_distance", "min_distance", "max_distance")])


@query(_NBR + " SELECT seq, site::BIGINT site, round(min(distance), 4) distance, count(*) cn FROM nn GROUP BY seq, site")
def coord_min_distance(spark, d):
    return C.neighbours(_s(spark, d), 3.2).groupBy("seq", F.col("site").cast("long").alias("site")).agg(F.round(F.min("distance"), 4).alias("distance"), F.count("*").alias("cn"))


@query(_NBR + ", k AS (SELECT *, row_number() OVER (PARTITION BY seq, site ORDER BY round(distance, 6), nbr) r FROM nn) SELECT seq, site::BIGINT site, round(sum(distance), 3) total, count(*) n FROM k WHERE r <= 3 GROUP BY seq, site")
def coord_knn(spark, d):
    n = C.nearest(C.neighbours(_s(spark, d), 3.2), 3)
    return n.groupBy("seq", F.col("site").cast("long").alias("site")).agg(F.round(F.sum("distance"), 3).alias("total"), F.count("*").alias("n"))


@query(_NBR + " SELECT seq, element, nbr_element, floor(distance / 0.4)::BIGINT bin, count(*) n FROM nn GROUP BY ALL")
def prdf(spark, d):
    return C.pair_distribution(C.neighbours(_s(spark, d), 3.2), 0.4).select("seq", "element", "nbr_element", F.col("bin").cast("long").alias("bin"), "n")


@query(f"WITH {_STRUCT} SELECT seq, len([e for e in els if e = 'Se'])::BIGINT old_te, len(els)::BIGINT n FROM (SELECT seq, [CASE WHEN e = 'Te' THEN 'Se' ELSE e END for e in els] els FROM st WHERE list_contains(els, 'Te'))")
def substitute(spark, d):
    s = C.substitute(_s(spark, d), "Te", "Se")
    return s.select("seq", F.size(F.filter("elements", lambda e: e == "Se")).cast("long").alias("old_te"), F.size("elements").cast("long").alias("n"))


@query(f"WITH {_STRUCT}, k AS (SELECT seq, len([e for e in els if e <> 'Te' OR e IS NULL]) n FROM st) SELECT seq, n::BIGINT n FROM k WHERE n > 0")
def delete_atoms(spark, d):
    return C.delete_atoms(_s(spark, d), "Te").select("seq", F.size("positions").cast("long").alias("n"))


@query(f"SELECT seq, {_LEN.format(1).replace('cell[1]', '[x * 1.1 for x in cell[1]]')} a FROM structures WHERE cell IS NOT NULL")
def scale_cell(spark, d):
    return C.lattice(C.scale_cell(_s(spark, d), 1.1)).select("seq", F.round("a", 5).alias("a"))


_PH = """ph AS (SELECT label, energy * CASE WHEN lower(unit) LIKE 'r%' THEN 13.605693122994 WHEN lower(unit) LIKE 'h%' THEN 27.211386245988 WHEN lower(unit) LIKE 'm%' THEN 0.001 ELSE 1 END e,
  list_sort([k for k in map_keys(formula) if formula[k] > 0]) els, formula, list_sum(map_values(formula)) n, coalesce(excluded, false) x_ FROM phases WHERE energy IS NOT NULL),
p AS (SELECT * FROM ph WHERE len(els) > 0),
ref AS (SELECT els[1] el, min(e / n) r FROM p WHERE len(els) = 1 AND NOT x_ GROUP BY 1),
part AS (SELECT label, e, n, k.el el, formula[k.el] q FROM p, unnest(els) k(el)),
fe AS (SELECT label, CASE WHEN count(r) = count(*) THEN (e - sum(q * r)) / n END y FROM part LEFT JOIN ref USING (el) GROUP BY label, e, n),
b AS (SELECT els[1] el1, els[2] el2, label, formula[els[2]] / n x, y, x_ FROM p JOIN fe USING (label) WHERE len(els) = 2 AND y IS NOT NULL),
lo AS (SELECT el1, el2, x, min(y) y FROM b WHERE NOT x_ GROUP BY ALL UNION ALL SELECT DISTINCT el1, el2, t.x, 0.0 FROM b, (VALUES (0.0), (1.0)) t(x)),
ch AS (SELECT l.el1, l.el2, l.x x1, l.y y1, r.x x2, r.y y2 FROM lo l JOIN lo r ON l.el1 = r.el1 AND l.el2 = r.el2 AND l.x < r.x)"""


@query("SELECT label, round(energy * CASE WHEN lower(unit) LIKE 'r%' THEN 13.605693122994 WHEN lower(unit) LIKE 'h%' THEN 27.211386245988 WHEN lower(unit) LIKE 'm%' THEN 0.001 ELSE 1 END, 6) energy_ev FROM phases")
def unit_convert(spark, d):
    p = table(spark, d, "phases")
    return p.select("label", F.round(F.col("energy") * U.ev_factor(U.energy_word(F.coalesce("unit", F.lit("eV")))), 6).alias("energy_ev"))


@query(f"WITH {_PH} SELECT el element, round(r, 5) reference FROM ref")
def elemental_phase_min(spark, d):
    return S.elemental_references(S.phase_energies(table(spark, d, "phases"))).select("element", F.round("reference", 5).alias("reference"))


@query(f"WITH {_PH} SELECT label, round(y, 6) formation_energy FROM fe")
def formation_energy(spark, d):
    return S.formation_energies(table(spark, d, "phases")).select("label", F.round("formation_energy", 6).alias("formation_energy"))


@query(f"""WITH {_PH}, h AS (SELECT label, y, min(y1 + (y2 - y1) * (x - x1) / (x2 - x1)) hull FROM b JOIN ch USING (el1, el2) WHERE x >= x1 AND x <= x2 GROUP BY label, y)
SELECT label, round(fe.y, 6) formation_energy, round(CASE WHEN len(els) = 1 THEN fe.y ELSE h.y - hull END, 6) stability FROM p JOIN fe USING (label) LEFT JOIN h USING (label)""")
def stability(spark, d):
    s = S.stability(table(spark, d, "phases"))
    return s.select("label", F.round("formation_energy", 6).alias("formation_energy"), F.round("stability", 6).alias("stability"))


@query(f"""WITH {_PH}, o AS (SELECT DISTINCT l.el1, l.el2, l.x, l.y FROM lo l WHERE NOT EXISTS (SELECT 1 FROM ch c WHERE c.el1 = l.el1 AND c.el2 = l.el2 AND c.x1 < l.x AND c.x2 > l.x AND c.y1 + (c.y2 - c.y1) * (l.x - c.x1) / (c.x2 - c.x1) <= l.y))
SELECT el1, el2, round(x, 6) x, round(min(y), 6) y FROM o WHERE EXISTS (SELECT 1 FROM b WHERE b.el1 = o.el1 AND b.el2 = o.el2 AND NOT x_) GROUP BY el1, el2, x""")
def lower_hull(spark, d):
    """Corners of the lower hull of every system."""
    h = S.hull_lines(S.binary_points(table(spark, d, "phases")))
    return h.select("el1", "el2", F.explode(F.arrays_zip("xs", "ys")).alias("p")).select("el1", "el2", F.round("p.xs", 6).alias("x"), F.round("p.ys", 6).alias("y"))


@query(f"WITH {_PH} SELECT el1 || '-' || el2 system, round(x, 6) x, round(min(y), 6) low, round(max(y), 6) high FROM b GROUP BY el1, el2, round(x, 6)")
def min_max_hull(spark, d):
    p = S.binary_points(table(spark, d, "phases")).select(F.concat_ws("-", "el1", "el2").alias("system"), F.round("x", 6).alias("x"), "y")
    return SE.extremes(p, "system", "x", "y").select("system", "x", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""WITH s AS (SELECT event_type, epoch(ts) x, value y, lead(epoch(ts)) OVER w nx, lead(value) OVER w ny FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch(ts)))
SELECT event_type, round(sum((nx - x) * (ny + y) / 2), 1) area FROM s GROUP BY event_type""")
def series_area(spark, d):
    e = table(spark, d, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("x"), F.col("value").alias("y"))
    return B.trapezoid(e, "event_type", "x", "y").select("event_type", F.round("area", 1).alias("area"))


@query("""WITH s AS (SELECT event_type, ts x, value y, lag(value) OVER w p, lead(value) OVER w n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)) SELECT event_type, y FROM s WHERE y > p AND y > n AND y >= 100""")
def series_peaks(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("ts").alias("x"), F.col("value").alias("y"))
    return B.peaks(e, "event_type", "x", "y", 100.0).select("event_type", "y")
