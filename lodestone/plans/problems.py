"""Queries of the general data-processing problems: units, rows that fail to parse, nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions import units as U
from lodestone.operators import cif_rows, flatten, unit_repair
from lodestone.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_repair.off_scale(table(spark, sf_dir, "structures"), table(spark, sf_dir, "output_bands"))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the sources' histories and the units that their level shifts mark."""
    return unit_repair.segment_histories(table(spark, sf_dir, "structures"), table(spark, sf_dir, "output_bands"))


def p3_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formation energies in eV per atom and positions in angstrom."""
    return unit_repair.common_structures(table(spark, sf_dir, "structures"))


def p3_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All band energies in eV."""
    return unit_repair.common_bands(table(spark, sf_dir, "output_bands"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cif_rows.rejected_lines(table(spark, sf_dir, "cif_lines"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of all lines that can be read."""
    return cif_rows.clean_values(table(spark, sf_dir, "cif_lines"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.flatten_dumps(table(spark, sf_dir, "structure_dumps")).select("dump_id", "child_table", "parent_key", "child_key")


def _child(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten.child_table(flatten.flatten_dumps(table(spark, sf_dir, "structure_dumps")), name)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (p3_found, p3_segments, p3_structures, p3_bands, p4_found, p4_clean, p6_found)}
    return own | {f"p6_{n}": _child(n) for n in flatten.TABLES}


#: p4 in SQL. A quoted value ends where a run of its quotes is followed by a blank or the end of the line.
_P4 = r"""
WITH l AS (SELECT row_id, block_id, line_no, coalesce(raw_line, '') raw, coalesce(lag(line_no) OVER w = line_no, false) again FROM cif_lines WINDOW w AS (PARTITION BY block_id ORDER BY line_no, row_id)),
m AS (SELECT *, sum(CASE WHEN starts_with(raw, ';') AND NOT again THEN 1 ELSE 0 END) OVER (PARTITION BY block_id ORDER BY line_no, row_id) marks FROM l),
t AS (SELECT *, CASE WHEN NOT starts_with(raw, ';') AND marks % 2 = 0 THEN lower(regexp_extract(raw, '^\s*(\S+)', 1)) END tag FROM m),
e AS (SELECT *, CASE WHEN starts_with(tag, '_atom_site_') AND NOT starts_with(tag, '_atom_site_aniso') THEN 'header' WHEN starts_with(tag, '_') THEN 'tag'
  WHEN regexp_matches(tag, '^(loop_|data_|save_|stop_|global_)') THEN 'word' END event FROM t),
s AS (SELECT *, last_value(event IGNORE NULLS) OVER w state, sum(CASE WHEN event = 'word' AND NOT again THEN 1 ELSE 0 END) OVER w loop_no FROM e WINDOW w AS (PARTITION BY block_id ORDER BY line_no, row_id)),
heads AS (SELECT block_id, loop_no, list(tag ORDER BY line_no) hs FROM s WHERE event = 'header' AND NOT again GROUP BY ALL),
tok AS (SELECT s.*, regexp_matches(tag, '^_cell_length_[abc]$') is_cell,
  [regexp_replace(x, '\s+$', '') for x in regexp_extract_all(raw, '''(?:[^'']|''+[^''\s])*''+(?:\s|$)|"(?:[^"]|"+[^"\s])*"+(?:\s|$)|#.*|\S+') if NOT starts_with(x, '#')] toks FROM s
  WHERE regexp_matches(tag, '^_cell_length_[abc]$') OR (event IS NULL AND tag <> '' AND NOT starts_with(tag, '#') AND state = 'header')),
rd AS (SELECT row_id, tok.block_id, line_no, CASE WHEN is_cell THEN [tag] ELSE hs END hs, CASE WHEN is_cell THEN toks[2:] ELSE toks END cells FROM tok LEFT JOIN heads h ON h.block_id = tok.block_id AND h.loop_no = tok.loop_no),
sh AS (SELECT *, CASE WHEN len([x for x in cells if (x[1] = '''' AND NOT (len(x) > 1 AND x[-1] = '''')) OR (x[1] = '"' AND NOT (len(x) > 1 AND x[-1] = '"'))]) > 0 THEN 0 WHEN len(cells) <> len(hs) THEN 1 END shape FROM rd WHERE hs IS NOT NULL),
val AS (SELECT row_id, block_id, line_no, hs[i] col, cells[i] v FROM sh, unnest(range(1, len(hs) + 1)) q(i) WHERE shape IS NULL),
num AS (SELECT *, regexp_matches(v, '^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?(?:\([0-9]+\))?$') ok FROM val),
n2 AS (SELECT *, CASE WHEN ok THEN regexp_replace(v, '\([0-9]+\)$', '')::DOUBLE END x FROM num),
bad AS (SELECT row_id, shape sev FROM sh WHERE shape IS NOT NULL UNION ALL
  SELECT row_id, CASE WHEN NOT ok AND v NOT IN ('?', '.') THEN 2 WHEN starts_with(col, '_cell_length_') AND x <= 0 THEN 3 WHEN col = '_atom_site_occupancy' AND (x < 0 OR x > 1) THEN 3 END FROM n2
  WHERE regexp_matches(col, '^(_cell_length_[abc]|_atom_site_fract_[xyz]|_atom_site_occupancy)$')),
err AS (SELECT row_id, min(sev) sev FROM bad WHERE sev IS NOT NULL GROUP BY row_id)
"""


_ENERGY = r"(?:milli[\s-]?(?:ev|electron\s?volts?)|mev|electron\s?volts?|ev|hartrees?|ha|a\.u\.|rydbergs?|ryd|ry|kj|kcal|terahertz|thz|cm\s?\^?-1|cm\^\{-1\}|1\s?/\s?cm)"
_GONE_TEXT = ", ".join(f"'{t}'" for t in U.NO_TEXT)
_GONE = ", ".join(repr(x) for x in U.NO_NUMBER)
_REAL = f"CASE WHEN isnan({{0}}) OR isinf({{0}}) OR {{0}} IN ({_GONE}) THEN NULL ELSE {{0}} END"
_NUMBER_IN = r"try_cast(nullif(regexp_extract({0}, '([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)', 1), '') AS DOUBLE)"
#: Formation energies with their units in SQL: the first text that states a unit of energy, its word and the basis after it.
_P3 = f"""a AS (SELECT *, attributes['formation_energy'] fe FROM structures),
n0 AS (SELECT *, {_REAL.format('formation_energy')} c, {_REAL.format('fe.d')} dd, CASE WHEN lower(trim(fe.s)) IN ({_GONE_TEXT}) THEN NULL ELSE trim(fe.s) END st FROM a),
n1 AS (SELECT *, {_NUMBER_IN.format('st')} s0 FROM n0), n2 AS (SELECT *, {_REAL.format('s0')} ss FROM n1),
n3 AS (SELECT *, CASE WHEN ss IS NOT NULL THEN regexp_replace(fe.s, '(?i)^\\s*e_?f\\s*=', '') END ot FROM n2),
n4 AS (SELECT *, coalesce(c, dd, ss) energy, CASE WHEN c IS NOT NULL THEN [formation_energy_unit, fe.unit, ot, note] WHEN dd IS NOT NULL THEN [fe.unit, formation_energy_unit, note] ELSE [ot, fe.unit, formation_energy_unit, note] END ts FROM n3),
n5 AS (SELECT *, lower([t for t in ts if t IS NOT NULL AND regexp_matches(lower(t), '(?:^|[^a-z]){_ENERGY}(?:$|[^a-z])')][1]) t FROM n4),
n6 AS (SELECT *, regexp_replace(regexp_extract(t, '(?:^|[^a-z])({_ENERGY})(?:$|[^a-z])', 1), '[\\s^{{}}.-]', '', 'g') w, regexp_extract(regexp_extract(t, '(?s)(?:^|[^a-z]){_ENERGY}($|[^a-z].*)', 1), '^[\\s_]*(?:\\(ha\\))?[\\s_]*(?:per|/|\\()?[\\s_]*(atoms?|at\\b|unit\\s?cell|cell|mol)?', 1) basis FROM n5),
n7 AS (SELECT *, CASE WHEN w IN ('kj', 'kcal') THEN w || '_per_mol' ELSE (CASE WHEN w IN ('mev', 'milliev', 'millielectronvolt', 'millielectronvolts') THEN 'mev' WHEN w IN ('hartree', 'hartrees', 'ha', 'au') THEN 'ha' WHEN w IN ('rydberg', 'rydbergs', 'ryd', 'ry') THEN 'ry' WHEN w IN ('thz', 'terahertz') THEN 'thz'
  WHEN w IN ('cm1', '1/cm') THEN 'inv_cm' ELSE 'ev' END) || CASE WHEN basis LIKE '%cell' THEN '_per_cell' ELSE '_per_atom' END END un FROM n6),
n8 AS (SELECT *, CASE WHEN t IS NULL THEN 'ev_per_atom' ELSE un END u, len(cell) = 3 AND list_max([abs(x) for x in flatten(positions)]) <= 2.0 frac, greatest(coalesce(len(elements), 0), 0) nsites FROM n7)"""


def oracle_sql() -> dict[str, str]:
    from lodestone.plans.materials import BAND_UNITS, UNITS_SQL

    units = "[" + ", ".join(f"'{u}'" for u in BAND_UNITS) + "]"
    return {
        "p3_found": f"WITH {UNITS_SQL}, {_P3} SELECT 'structures' table_name, seq record_id, 'formation_energy' quantity, u found_unit FROM n8 WHERE energy IS NOT NULL AND u <> 'ev_per_atom' UNION ALL SELECT 'structures', seq, 'positions', 'fractional' FROM n8 WHERE frac"
        f" UNION ALL SELECT 'output_bands', bands_id, 'energy', {units}[u] FROM bu WHERE u <> 1",
        "p3_bands": f"WITH {UNITS_SQL} SELECT * EXCLUDE (e), e energy_ev FROM ob",
        "p4_found": _P4 + "SELECT row_id, ['quoting', 'column_count', 'bad_number', 'out_of_range'][sev + 1] reason FROM err",
        "p4_clean": _P4 + 'SELECT row_id, block_id, line_no, col "column", v "value", x number FROM n2 WHERE row_id NOT IN (SELECT row_id FROM err)',
    }
