"""Collections as wide tables, formula series and database filters, and nested configurations as paths."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import formula_columns as FC
from lodestone.functions.formula import parse_formula
from lodestone.functions.formula_columns import reduce_quantities
from lodestone.operators.access import attribute, elements_of
from lodestone.operators.collection import symbol


def wide_table(structures: DataFrame, attributes: Sequence[str] = (), elements: Sequence[str] | None = None) -> DataFrame:
    """(seq, label, nr_atoms, el_conc_X …, nr_atoms_X …, attribute …): one column a property of each element of the collection and of each named attribute.

    Columns that would be empty throughout are left out: only elements that occur have some, unless they are given.
    """
    names = sorted(r.element for r in elements_of(structures).collect()) if elements is None else list(elements)  # at most one row an element
    n = F.size("elements")
    with_map = structures.withColumn("_m", FC.from_list(F.transform("elements", symbol)))
    count = lambda e: F.coalesce(F.element_at("_m", e), F.lit(0.0))
    return with_map.select("seq", "label", F.greatest(n, F.lit(0)).alias("nr_atoms"), *[(count(e) / F.nullif(n, F.lit(0))).alias(f"el_conc_{e}") for e in names], *[count(e).cast("int").alias(f"nr_atoms_{e}") for e in names], *[attribute(a).alias(a) for a in attributes])


def to_pandas(structures: DataFrame, attributes: Sequence[str] = (), limit: int = 100_000):
    """The wide table as a pandas frame, for collections of at most `limit` rows; larger ones raise."""
    t = wide_table(structures, attributes)
    if t.limit(limit + 1).count() > limit:
        raise ValueError(f"the collection has more than {limit} rows; write wide_table() instead")
    return t.toPandas()


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """A collection from a pandas frame with label, elements, positions and cell columns; seq counts its rows."""
    d = frame.reset_index(drop=True)
    d.insert(0, "seq", range(len(d)))
    return spark.createDataFrame(d)


def element_subsets(elements: Sequence[str], least: int = 1) -> list[tuple[str, ...]]:
    """All subsets of some elements, the smallest first: the chemical systems within a system."""
    return [s for k in range(least, len(elements) + 1) for s in itertools.combinations(sorted(set(elements)), k)]


def subsystems(structures: DataFrame, elements: Sequence[str]) -> DataFrame:
    """(seq, system): structures whose elements are a subset of the given ones, with their chemical system."""
    sym = F.array_sort(F.array_distinct(F.array_compact(F.transform("elements", symbol))))
    d = structures.select("seq", sym.alias("s"), F.size("elements").alias("n")).where(F.forall("s", lambda e: e.isin(*elements)) & (F.size("s") > 0))
    return d.select("seq", F.array_join("s", "-").alias("system"))


def formula_series(elements: Sequence[str], most: int = 4) -> list[str]:
    """Reduced formulas of all elements with 1 to `most` atoms each, in alphabetical order of elements: what a query by composition asks for."""
    names, out = sorted(set(elements)), {}
    for counts in itertools.product(range(1, most + 1), repeat=len(names)):
        whole = reduce_quantities([float(c) for c in counts])
        out["".join(e + ("" if c == 1 else str(c)) for e, c in zip(names, whole))] = None
    return list(out)


def optimade_filter(formula: str) -> str:
    """A filter in the OPTIMADE language: an exact reduced formula, or, for 'Cs-Te', structures of those elements alone."""
    if "-" in formula:
        names = sorted(p for p in formula.split("-") if p)
        return "elements HAS ONLY " + ", ".join(f'"{e}"' for e in names)
    f = parse_formula(formula) or {}
    whole = dict(zip(sorted(f), reduce_quantities([f[k] for k in sorted(f)]))) if f else {}
    return 'chemical_formula_reduced="' + "".join(e + ("" if n == 1 else str(n)) for e, n in whole.items()) + '"'


def read_optimade(spark: SparkSession, path: str) -> DataFrame:
    """Structures from saved OPTIMADE responses (JSON with a list `data`), every page and entry: (id, elements, positions, cell, attributes)."""
    ddl = "data array<struct<id: string, attributes: struct<lattice_vectors: array<array<double>>, cartesian_site_positions: array<array<double>>, species_at_sites: array<string>, chemical_formula_reduced: string, nsites: int>>>"
    rows = spark.read.schema(ddl).option("multiLine", "true").json(path).select(F.explode("data").alias("d"))
    a = F.col("d.attributes")
    return rows.select(F.col("d.id").alias("label"), a["species_at_sites"].alias("elements"), a["cartesian_site_positions"].alias("positions"), a["lattice_vectors"].alias("cell"), a["chemical_formula_reduced"].alias("formula"))


# nested configurations: {'a': {'b': 1}} and paths ['a', 'b']


def set_path(tree: dict, path: Sequence[str], value) -> dict:
    """A copy of the tree with the value at the path; what is missing on the way is made."""
    if not path:
        return value
    out = dict(tree)
    below = out.get(path[0])
    out[path[0]] = set_path(below if isinstance(below, dict) else {}, path[1:], value)
    return out


def get_path(tree: dict, path: Sequence[str], default=None):
    at = tree
    for p in path:
        if not isinstance(at, dict) or p not in at:
            return default
        at = at[p]
    return at


def paths(tree: dict, before: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], object]]:
    """(path, value) of every leaf; empty branches are leaves."""
    out = []
    for k, v in tree.items():
        out += paths(v, (*before, k)) if isinstance(v, dict) and v else [((*before, k), v)]
    return out


def merge_trees(a: dict, b: dict) -> dict:
    """Both trees in one; where both have a leaf, that of b counts."""
    out = dict(a)
    for k, v in b.items():
        out[k] = merge_trees(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def with_case(tree: dict, upper: bool = False) -> dict:
    """Keys in lower (or upper) case throughout."""
    change = str.upper if upper else str.lower
    return {change(k): with_case(v, upper) if isinstance(v, dict) else v for k, v in tree.items()}
