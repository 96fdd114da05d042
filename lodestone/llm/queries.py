"""Queries of the training-data problems tagged llm: each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import entity_match, leakage, mixing, near_duplicates, reading_level, survivors
from lodestone.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.duplicate_pairs(table(spark, sf_dir, "structures"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with near-duplicates, and its group."""
    return near_duplicates.duplicate_groups(table(spark, sf_dir, "structures"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = survivors.surviving_values(table(spark, sf_dir, "structures"), table(spark, sf_dir, "sources"))
    return v.select("first_seq", F.col("field").alias("field_name"), "from_seq")


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "structures"), table(spark, sf_dir, "sources"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = entity_match.match_entities(table(spark, sf_dir, "structures"), table(spark, sf_dir, "measured_crystals"))
    return m.where(F.col("exact") & (F.col("confidence") >= entity_match.CERTAIN)).select("seq", "ref_id")


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs with their calibrated confidence."""
    return entity_match.match_entities(table(spark, sf_dir, "structures"), table(spark, sf_dir, "measured_crystals"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself: every copy of every text, with its shard and place."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares wanted and reached by the mix."""
    return mixing.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels")).select("doc_id", "reading_level")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_survivors, p5_found, p5_matches, p7_found, p8_found, p8_mix, p8_report, p9_found)}


#: p2 in SQL: the survivor under dominant weights is the best record's value.
P2 = r"""
WITH names AS (SELECT regexp_replace(lower(trim(source)), '[\s_-]+', '-', 'g') k, family, trust_rank FROM sources),
r AS (
  SELECT s.*, n.family, n.trust_rank, ltrim(regexp_extract(source_id, '([0-9]+)\s*$', 1), '0') entry
  FROM structures s JOIN names n ON n.k = regexp_replace(lower(trim(s.source)), '[\s_-]+', '-', 'g')
  WHERE regexp_matches(source_id, '[0-9]+\s*$')),
gone(t) AS (SELECT unnest(['', '-', '--', '?', 'n/a', 'na', 'nan', 'none', 'null', 'unknown', 'not computed', 'not available', 'missing'])),
v AS (
  SELECT family, entry, trust_rank, mtime, seq, 'formation_energy' field_name,
    coalesce(CASE WHEN isnan(formation_energy) OR formation_energy IN (-999, 999, 999.99, -999.99, 9999, -9999, 9999.99, -9999.99, 99999, -99999) THEN NULL ELSE formation_energy END,
      attributes['formation_energy'].d, try_cast(regexp_extract(attributes['formation_energy'].s, '[-+]?[0-9]*\.?[0-9]+', 0) AS DOUBLE)) IS NOT NULL ok FROM r
  UNION ALL SELECT family, entry, trust_rank, mtime, seq, 'band_gap',
    (attributes['band_gap'].d IS NOT NULL AND NOT isnan(attributes['band_gap'].d) AND attributes['band_gap'].d NOT IN (-1, 999)) OR coalesce(regexp_matches(attributes['band_gap'].s, '[0-9]'), false) FROM r
  UNION ALL SELECT family, entry, trust_rank, mtime, seq, 'space_group',
    coalesce(attributes['space_group'].d BETWEEN 1 AND 230, false) OR coalesce(lower(trim(attributes['space_group'].s)) NOT IN (SELECT t FROM gone), false) FROM r
  UNION ALL SELECT family, entry, trust_rank, mtime, seq, 'functional', coalesce(lower(trim(attributes['functional'].s)) NOT IN (SELECT t FROM gone), false) FROM r),
g AS (SELECT family, entry, min(seq) first_seq FROM r GROUP BY ALL HAVING count(*) >= 2)
SELECT first_seq, field_name, seq from_seq FROM (
  SELECT g.first_seq, v.field_name, v.seq, row_number() OVER (PARTITION BY v.family, v.entry, v.field_name ORDER BY trust_rank, mtime DESC NULLS LAST, seq) k
  FROM v JOIN g USING (family, entry) WHERE ok) WHERE k = 1
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force in tests/llm."""
    return {"p2_found": P2}
