"""Chemical formulas as Spark expressions: text to map, map to text and LaTeX, lists, reduction to whole numbers, comparison.

Formulas without brackets stay in the JVM; nested brackets need a stack and go through an Arrow UDF, a batch at a time. A formula is a map from symbol to
quantity; null stays null.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import gcd

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, MapType, StringType

from lodestone.functions.formula import parse_formula

def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


PIECE = r"([A-Z][a-z]?)([0-9]*(?:\.[0-9]+)?)"


def sum_by_key(entries: Column) -> Column:
    """array<struct<key, value>> to a map in which repeated keys are added up, in order of appearance."""

    def total(e: Column) -> Column:
        one = lambda k: F.struct(k.alias("key"), F.aggregate(F.filter(e, lambda x: x["key"] == k), F.lit(0.0), lambda a, x: a + x["value"]).alias("value"))
        return F.map_from_entries(F.transform(F.array_distinct(F.transform(e, lambda x: x["key"])), one))

    return let(entries, total)


def parse_flat(text: Column) -> Column:
    """'H2O', 'C.5H@3' to a map; quantities default to 1, repeated elements are added up, '@' and what is no symbol are skipped. No brackets."""
    clean = F.regexp_replace(text, "@", "")
    found = F.arrays_zip(F.regexp_extract_all(clean, F.lit(PIECE), F.lit(1)).alias("key"), F.regexp_extract_all(clean, F.lit(PIECE), F.lit(2)).alias("value"))
    return sum_by_key(F.transform(found, lambda p: F.struct(p["key"].alias("key"), F.coalesce(F.nullif(p["value"], F.lit("")).try_cast("double"), F.lit(1.0)).alias("value"))))


def _parse_nested(text: Column) -> Column:
    @F.pandas_udf(MapType(StringType(), DoubleType()))
    def nested(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else parse_formula(x.replace("@", "")) or {})

    return nested(text)


def parse(text: Column) -> Column:
    """A formula with any nesting of (), [] and {}; only texts with brackets leave the JVM. Unreadable text with brackets gives an empty map."""
    nested = text.rlike(r"[(\[{]")
    return F.when(nested, _parse_nested(F.when(nested, text))).otherwise(parse_flat(text))


def from_list(elements: Column) -> Column:
    """['H', 'O', 'H'] to {'H': 2, 'O': 1}, in order of appearance."""
    return sum_by_key(F.transform(F.array_compact(elements), lambda e: F.struct(e.alias("key"), F.lit(1.0).alias("value"))))


def _entries(formula: Column, alphabetic: bool) -> Column:
    e = F.map_entries(formula)
    return F.array_sort(e) if alphabetic else e


def quantity_text(q: Column) -> Column:
    """Nothing for 1, whole numbers without a point."""
    whole = q == F.floor(q)
    return F.when(q == 1, F.lit("")).when(whole, q.cast("long").cast("string")).otherwise(q.cast("string"))


def to_text(formula: Column, alphabetic: bool = False) -> Column:
    """{'Fe': 2.0, 'O': 3.0} to 'Fe2O3'."""
    return F.array_join(F.transform(_entries(formula, alphabetic), lambda e: F.concat(e["key"], quantity_text(e["value"].cast("double")))), "")


def to_latex(formula: Column) -> Column:
    r"""{'Fe': 2.0, 'O': 1.0} to '$\mathrm{Fe}_\mathrm{2}\mathrm{O}$'; quantities are rounded half to even, and those that begin with 1 before the point aren't written."""
    sub = lambda q: F.when(q.cast("long") == 1, F.lit("")).otherwise(F.concat(F.lit("_\\mathrm{"), F.bround(q, 0).cast("long").cast("string"), F.lit("}")))
    one = lambda e: F.concat(F.lit("\\mathrm{"), e["key"], F.lit("}"), sub(e["value"].cast("double")))
    return F.concat(F.lit("$"), F.array_join(F.transform(F.map_entries(formula), one), ""), F.lit("$"))


def list_to_text(elements: Column) -> Column:
    return to_text(from_list(elements))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm; 48 steps are enough for any two whole numbers below 2^31."""
    start = F.struct(a.alias("a"), b.alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.nullif(s["b"], F.lit(0).cast("long"))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, step)["a"]


def reduce_whole(formula: Column) -> Column:
    """Whole quantities divided by their greatest common divisor; one element alone counts 1."""

    def divided(f: Column) -> Column:
        divisor = F.aggregate(F.transform(F.map_values(f), lambda v: v.cast("long")), F.lit(0).cast("long"), _gcd)
        by = let(divisor, lambda g: F.transform_values(f, lambda _, v: F.when(F.size(f) == 1, F.lit(1).cast("long")).otherwise((v.cast("long") / F.nullif(g, F.lit(0).cast("long"))).cast("long"))))
        return by

    return let(formula, divided)


def reduce_quantities(values: list[float], tolerance: float = 1e-4) -> list[int]:
    """The smallest whole numbers in the ratio of the values, read as fractions of a denominator of at most 1 / tolerance."""
    if len(values) == 1:
        return [1]
    parts = [Fraction(v).limit_denominator(int(1 / tolerance)) for v in values]
    scale = 1
    for p in parts:
        scale = scale if scale % p.denominator == 0 else scale * p.denominator
    whole = [int(p * scale) for p in parts]
    return [w // (reduce(gcd, whole) or 1) for w in whole]


def reduce_formula(formula: Column, tolerance: float = 1e-4) -> Column:
    """Quantities as the smallest whole numbers in their ratio. Whole quantities stay in the JVM; fractions go through an Arrow UDF."""

    @F.pandas_udf(MapType(StringType(), LongType()))
    def fractions(f: pd.Series) -> pd.Series:
        return f.map(lambda m: None if m is None else dict(zip(m, reduce_quantities(list(m.values()), tolerance))) if len(m) else {})

    whole = F.forall(F.map_values(formula), lambda v: v == F.floor(v))
    return F.when(whole, reduce_whole(formula)).otherwise(fractions(F.when(~whole, F.transform_values(formula, lambda _, v: v.cast("double")))))


def canonical(formula: Column) -> Column:
    """The same text for equal formulas: a key to join on."""
    return to_text(formula, alphabetic=True)


def same_formula(a: Column, b: Column, reduced: bool = False) -> Column:
    """Whether two formulas have the same elements in the same quantities (or ratio)."""
    sorted_entries = lambda m: F.array_sort(F.map_entries(F.transform_values(m, lambda _, v: v.cast("double"))))
    return sorted_entries(reduce_formula(a) if reduced else a) == sorted_entries(reduce_formula(b) if reduced else b)
