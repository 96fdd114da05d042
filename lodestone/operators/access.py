"""Keyed access to collections, constraints on structures, attributes, and the registry of operators.

A collection is a DataFrame with a key (label) and an order of arrival (seq). Access by key or place is a filter; nothing here brings rows to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import formula_columns as FC
from lodestone.functions.formula import parse_formula
from lodestone.operators.collection import latest, symbol


def get_structures(structures: DataFrame, keys: Sequence[str], key: str = "label") -> DataFrame:
    """The rows of some keys."""
    return structures.where(F.col(key).isin(*keys))


def numbered(structures: DataFrame, order: str = "seq", blocks: int = 256) -> DataFrame:
    """With `place`, from 0, in order of arrival. Rows are numbered within ranges of the order, and ranges by their sizes: no window takes all rows."""
    part = structures.withColumn("_b", F.spark_partition_id()) if structures.isStreaming else structures.repartitionByRange(blocks, order).withColumn("_b", F.spark_partition_id())
    inner = part.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(order)))
    sizes = inner.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row a range
    return inner.join(before, "_b").withColumn("place", F.col("_before") + F.col("_r") - 1).drop("_b", "_r", "_before")


def slice_structures(structures: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, order: str = "seq") -> DataFrame:
    """Rows start, start + step, … before stop, in order of arrival."""
    d = numbered(structures, order)
    d = d.where((F.col("place") >= start) & ((F.col("place") - start) % step == 0))
    return d if stop is None else d.where(F.col("place") < stop)


def delete_structures(structures: DataFrame, keys: Sequence[str], key: str = "label") -> DataFrame:
    return structures.where(~F.coalesce(F.col(key).isin(*keys), F.lit(False)))


def union(a: DataFrame, b: DataFrame, key: str = "label", keep: str = "first") -> DataFrame:
    """Both collections; of rows with a key that both have, those of the first (or 'last') stay. Keys of the side that gives way are looked up, not its rows."""
    first, last = (a, b) if keep == "first" else (b, a)
    left = last.join(first.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return first.unionByName(left, allowMissingColumns=True)


def duplicate_structure(structures: DataFrame, label: str, new_label: str) -> DataFrame:
    """The collection and a copy of one key's rows under another."""
    return structures.unionByName(structures.where(F.col("label") == label).withColumn("label", F.lit(new_label)))


def elements_of(structures: DataFrame) -> DataFrame:
    """(element) of all structures; each row's own list is made distinct before the shuffle."""
    return structures.select(F.explode(F.array_distinct(F.transform("elements", symbol))).alias("element")).where("element is not null").distinct()


def kinds_of(structures: DataFrame) -> DataFrame:
    return structures.select(F.explode(F.array_distinct("kinds")).alias("kind")).where("kind is not null").distinct()


def attribute_keys(structures: DataFrame) -> DataFrame:
    return structures.select(F.explode(F.map_keys("attributes")).alias("attribute")).distinct()


def attribute(name: str) -> Column:
    """Number of an attribute, else the number in its text."""
    a = F.col("attributes")[name]
    return F.coalesce(a["d"], a["s"].try_cast("double"))


def set_attribute(structures: DataFrame, name: str, value: Column, unit: str | None = None) -> DataFrame:
    """With one attribute added or replaced by a number."""
    kind = structures.schema["attributes"].dataType.valueType.simpleString()  # type: ignore[attr-defined]
    fields = {"d": value.cast("double"), "s": F.lit(None), "b": F.lit(None), "j": F.lit(None), "unit": F.lit(unit)}
    new = F.create_map(F.lit(name), F.struct(*[v.alias(k) for k, v in fields.items()]).cast(kind))
    old = F.coalesce(F.map_filter("attributes", lambda k, _: k != name), F.create_map().cast(f"map<string,{kind}>"))
    return structures.withColumn("attributes", F.map_concat(old, new))


def _one_of(elements: list[str]) -> Callable[[Column], Column]:
    return lambda e: F.coalesce(e.isin(*elements), F.lit(False))


class Constraints:
    """Conditions that structures must meet: formulas (any of them), concentrations (all), attributes (all), no elemental structures.

    Bounds of concentrations are exclusive and only count where the element is present; those of attributes are inclusive, and a structure without the attribute fails.
    A formula with '-' for a quantity stands for any amount of that element: structures with a subset of the elements pass.
    """

    def __init__(self) -> None:
        self.formulas: list[dict[str, float | str]] = []
        self.concentrations: dict[str, tuple[float, float]] = {}
        self.attributes: dict[str, tuple[float | None, float | None]] = {}
        self.no_elemental = False

    def formula(self, *formulas: str | dict[str, float | str]) -> Constraints:
        for f in formulas:
            self.formulas.append(f if isinstance(f, dict) else parse_formula(f) or {})
        return self

    def concentration(self, element: str, low: float = 0.0, high: float = 1.0) -> Constraints:
        self.concentrations[element] = (low, high)
        return self

    def attribute(self, name: str, low: float | None = None, high: float | None = None) -> Constraints:
        self.attributes[name] = (low, high)
        return self

    def neglect_elemental(self, on: bool = True) -> Constraints:
        self.no_elemental = on
        return self

    def remove(self) -> Constraints:
        self.__init__()  # type: ignore[misc]
        return self

    def condition(self) -> Column:
        """The whole as one filter, so that it reaches the scan where it can."""
        sym = F.transform("elements", symbol)
        out = F.lit(True)
        if self.formulas:
            any_of = F.lit(False)
            key = FC.canonical(FC.reduce_whole(FC.from_list(sym)))
            for f in self.formulas:
                if "-" in f.values():
                    ok = F.forall(sym, _one_of(list(f)))
                else:
                    values = FC.reduce_quantities([float(v) for v in f.values()])
                    text = "".join(k + ("" if v == 1 else str(v)) for k, v in sorted(zip(f, values)))
                    ok = key == text
                any_of = any_of | ok
            out = out & any_of
        for e, (low, high) in self.concentrations.items():
            share = F.size(F.filter(sym, _one_of([e]))) / F.nullif(F.size("elements"), F.lit(0))
            out = out & ((share == 0) | ((share > low) & (share < high)))
        for name, (low, high) in self.attributes.items():
            v = attribute(name)
            out = out & v.isNotNull()
            out = out & (v >= low) if low is not None else out
            out = out & (v <= high) if high is not None else out
        if self.no_elemental:
            out = out & (F.size(F.array_distinct(sym)) > 1)
        return F.coalesce(out, F.lit(False))

    def apply(self, structures: DataFrame) -> DataFrame:
        return structures.where(self.condition())


def distance_problems(pairs: DataFrame, least: float) -> DataFrame:
    """(seq): structures with two sites nearer than `least`. pairs: `neighbours.pairs` with a radius of at least that."""
    return pairs.where(F.col("distance") < least).select("seq").distinct()


def overwrite(structures: DataFrame, new: DataFrame, key: str = "label") -> DataFrame:
    """Upsert: rows of `new` replace those of their key."""
    return union(latest(new, key), structures, key)


REGISTRY: dict[str, dict[str, Callable]] = {"analysis": {}, "manipulation": {}}


def register(kind: str, f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Makes an operator (structures, **arguments) -> DataFrame known under its name; also a decorator's inner half."""
    REGISTRY[kind][f.__name__] = f
    return f


def external_analysis(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    return register("analysis", f)


def external_manipulation(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    return register("manipulation", f)


def list_methods(kind: str) -> list[str]:
    return sorted(REGISTRY[kind])


def perform(structures: DataFrame, kind: str, name: str, **how) -> DataFrame:
    """A registered operator by name."""
    if name not in REGISTRY[kind]:
        raise ValueError(f"{name!r} is none of the {kind} operators: {', '.join(list_methods(kind))}")
    return REGISTRY[kind][name](structures, **how)


def _fill() -> None:
    from lodestone.operators import compare, manipulate, neighbours, site_geometry

    for f in (neighbours.coordination_sites, neighbours.coordination_statistics, neighbours.pair_distribution, neighbours.fingerprints, neighbours.site_fingerprints, neighbours.order_parameter, neighbours.warren_cowley,
              site_geometry.site_distances, site_geometry.site_angles, site_geometry.site_dihedrals, compare.equivalent_sites, compare.equivalent_sites_by_fingerprint, compare.find_duplicates_by_fingerprint):
        register("analysis", f)
    for f in (manipulate.delete_atoms, manipulate.substitute_elements, manipulate.scale_unit_cell, manipulate.create_supercell, manipulate.translate_structure, manipulate.rotate_structure, manipulate.add_structure_position, manipulate.add_structure_random):
        register("manipulation", f)


_fill()
