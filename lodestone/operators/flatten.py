"""Deeply nested structure dumps to flat tables with links from child to parent.

Spark's JSON reader turns each layout of a payload into one nested, typed form; the nesting is then undone on Arrow buffers: list offsets give the
children, parent-index kernels give the row each child came from, and keys are carried down with vectorised takes. No record is parsed in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHILD = pa.schema([
    ("dump_id", pa.int64()), ("child_table", pa.string()), ("parent_key", pa.string()), ("child_key", pa.string()), ("value", pa.string()), ("unit", pa.string()),
    ("element", pa.string()), ("position", pa.list_(pa.float64())), ("site_index", pa.string()), ("distance", pa.float64()), ("weight", pa.float64()),
])
CHILD_DDL = "dump_id long, child_table string, parent_key string, child_key string, value string, unit string, element string, position array<double>, site_index string, distance double, weight double"


def snake(c: F.Column) -> F.Column:
    """'formationEnergy', 'Formation Energy', 'formation-energy' to 'formation_energy'."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"[\s\-.]+", "_"), r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def _obj(text: F.Column) -> F.Column:
    """A JSON object (or one written as text) as a map of JSON texts with keys in snake form; null if it is none."""
    pairs = F.map_entries(F.from_json(text, "map<string,string>"))
    # two spellings of one key: the first counts
    named = F.transform(pairs, lambda e: F.struct(snake(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(named, lambda e, i: F.coalesce(F.array_position(F.transform(named, lambda x: x["key"]), e["key"]), F.lit(0)) == i + 1)
    return F.when(F.ltrim(text).startswith("{"), F.map_from_entries(first))


def _neighbours(text: F.Column) -> F.Column:
    """A list, an object numbered '0', '1', …, a single neighbour or null to an array of neighbours with their places."""
    shape = "struct<element:string,site_index:string,siteIndex:string,distance:double,weight:double>"
    listed = F.from_json(text, f"array<{shape}>")
    by_number = F.from_json(text, f"map<string,{shape}>")
    numbered = F.transform(F.array_sort(F.map_entries(by_number), lambda a, b: F.coalesce(a["key"].try_cast("long") - b["key"].try_cast("long"), F.lit(0)).cast("int")), lambda e: e["value"])
    is_obj, digits = F.ltrim(text).startswith("{"), F.ltrim(text).rlike(r'^\{\s*("-?[0-9]+"|\})')
    arr = F.when(F.ltrim(text).startswith("["), listed).when(is_obj & digits, numbered).when(is_obj, F.array(F.from_json(text, shape)))
    return F.transform(
        arr,
        lambda n, i: F.struct(i.cast("string").alias("place"), n["element"].alias("element"), F.coalesce(n["site_index"], n["siteIndex"]).alias("site_index"), n["distance"].alias("distance"), n["weight"].alias("weight")),
    )


def typed_dumps(dumps: DataFrame) -> DataFrame:
    """(dump_id, attributes, sites, site_attributes, coordination): every layout in one nested form."""
    d = dumps.select(F.col("dump_id").cast("long").alias("dump_id"), _obj(F.col("payload")).alias("top")).where("top is not null")
    d = d.select("dump_id", "top", F.coalesce(_obj(F.col("top")["structure"]), F.create_map().cast("map<string,string>")).alias("inner"), _obj(F.col("top")["extras"]).alias("extras"))
    pick = lambda k: F.coalesce(F.col("top")[k], F.col("inner")[k])
    d = d.select(
        "dump_id", pick("attributes").alias("attributes"), pick("sites").alias("sites"), pick("site_attributes").alias("site_attributes"), pick("elements").alias("elements"), pick("positions").alias("positions"),
        F.coalesce(_obj(F.col("extras")["coordination"])["sites"], _obj(pick("coordination"))["sites"]).alias("coordination"),
    )

    # attributes: an object of values or {value, unit}, or a list of {name, value, unit}
    value = lambda t: F.when(F.ltrim(t).startswith("{"), F.coalesce(F.from_json(t, "struct<value:string,unit:string>"), F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("unit")))).otherwise(
        F.struct(t.alias("value"), F.lit(None).cast("string").alias("unit"))
    )
    as_map = F.transform(F.map_entries(F.from_json("attributes", "map<string,string>")), lambda e: F.struct(snake(e["key"]).alias("name"), value(e["value"]).alias("v")))
    as_list = F.transform(
        F.from_json("attributes", "array<struct<name:string,key:string,value:string,unit:string>>"),
        lambda e: F.struct(snake(F.coalesce(e["name"], e["key"])).alias("name"), F.when(F.ltrim(e["value"]).startswith("{"), value(e["value"])).otherwise(F.struct(e["value"].alias("value"), e["unit"].alias("unit"))).alias("v")),
    )
    attributes = F.when(F.ltrim("attributes").startswith("["), as_list).otherwise(as_map)

    site = "struct<element:string,position:array<double>,site_index:string,siteIndex:string,index:string,properties:map<string,string>,attributes:map<string,string>,neighbours:string,neighbors:string>"
    nested = F.transform(
        F.from_json("sites", f"array<{site}>"),
        lambda s, i: F.struct(
            F.coalesce(s["site_index"], s["siteIndex"], i.cast("string")).alias("key"), s["element"].alias("element"), s["position"].alias("position"),
            F.map_entries(F.coalesce(s["properties"], s["attributes"])).alias("values"), _neighbours(F.coalesce(s["neighbours"], s["neighbors"])).alias("neighbours"),
        ),
    )
    nothing = F.lit(None)
    plain = F.transform(
        F.arrays_zip(F.from_json("elements", "array<string>").alias("e"), F.from_json("positions", "array<array<double>>").alias("p")),
        lambda s, i: F.struct(i.cast("string").alias("key"), s["e"].alias("element"), s["p"].alias("position"), nothing.cast("array<struct<key:string,value:string>>").alias("values"), nothing.cast("array<struct<place:string,element:string,site_index:string,distance:double,weight:double>>").alias("neighbours")),
    )
    bare = F.coalesce(plain, F.transform(F.from_json("elements", "array<string>"), lambda e, i: F.struct(i.cast("string").alias("key"), e.alias("element"), nothing.cast("array<double>").alias("position"), nothing.cast("array<struct<key:string,value:string>>").alias("values"), nothing.cast("array<struct<place:string,element:string,site_index:string,distance:double,weight:double>>").alias("neighbours"))))
    coordination = F.transform(
        F.from_json("coordination", "array<struct<site_index:string,siteIndex:string,neighbours:string,neighbors:string>>"),
        lambda s, i: F.struct(F.coalesce(s["site_index"], s["siteIndex"], i.cast("string")).alias("key"), _neighbours(F.coalesce(s["neighbours"], s["neighbors"])).alias("neighbours")),
    )
    table = F.transform(F.map_entries(F.from_json("site_attributes", "map<string,array<string>>")), lambda e: F.struct(snake(e["key"]).alias("name"), e["value"].alias("values")))
    return d.select("dump_id", attributes.alias("attributes"), F.coalesce(nested, bare).alias("sites"), table.alias("site_attributes"), coordination.alias("coordination"))


def _take(a: pa.Array, i: pa.Array) -> pa.Array:
    return a.take(i)


def _kids(lists: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Children of a list array and the row of each, from the offsets."""
    return pc.list_flatten(lists), pc.list_parent_indices(lists)


def _place(parents: pa.Array) -> np.ndarray:
    p = np.asarray(parents, np.int64)
    new = np.append(True, p[1:] != p[:-1]) if len(p) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0)) if len(p) else p
    return np.arange(len(p)) - first


def _batch(n: int, table: str, **cols: pa.Array) -> pa.RecordBatch:
    blank = lambda f: cols[f.name].cast(f.type) if f.name in cols else pa.nulls(n, f.type)
    arrays = [pa.array([table] * n, pa.string()) if f.name == "child_table" else blank(f) for f in CHILD]
    return pa.RecordBatch.from_arrays(arrays, schema=CHILD)


def _snake_all(names: pa.Array) -> pa.Array:
    """The same rule as `snake`, on the distinct names only."""
    d = names.dictionary_encode()
    t = pc.replace_substring_regex(pc.utf8_trim_whitespace(d.dictionary), r"[\s\-.]+", "_")
    t = pc.utf8_lower(pc.replace_substring_regex(t, r"([a-z0-9])([A-Z])", r"\1_\2"))
    return t.take(d.indices)


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def text(a):
        return pc.fill_null(a, "")

    def neighbours(ids, keys, lists):
        kid, at = _kids(lists)
        if len(kid):
            f = lambda c: pc.struct_field(kid, c)
            yield _batch(len(kid), "neighbour", dump_id=ids.take(at), parent_key=keys.take(at), child_key=f("place"), element=f("element"), site_index=f("site_index"), distance=f("distance"), weight=f("weight"))

    for b in batches:
        ids, attributes, sites, table, coordination = (b.column(i) for i in range(5))
        kid, at = _kids(attributes)
        v = pc.struct_field(kid, ["v", "value"])
        keep = pc.is_valid(v)
        kid, at = kid.filter(keep), at.filter(keep)
        yield _batch(len(kid), "attribute", dump_id=ids.take(at), parent_key=pa.array([""] * len(kid), pa.string()), child_key=pc.struct_field(kid, "name"), value=pc.struct_field(kid, ["v", "value"]), unit=pc.struct_field(kid, ["v", "unit"]))

        site, row = _kids(sites)
        key, owner = pc.struct_field(site, "key"), ids.take(row)
        yield _batch(len(site), "site", dump_id=owner, parent_key=pa.array([""] * len(site), pa.string()), child_key=key, element=pc.struct_field(site, "element"), position=pc.struct_field(site, "position"))
        val, s = _kids(pc.struct_field(site, "values"))
        if len(val):
            keep = pc.is_valid(pc.struct_field(val, "value"))
            val, s = val.filter(keep), s.filter(keep)
            yield _batch(len(val), "site_value", dump_id=owner.take(s), parent_key=key.take(s), child_key=_snake_all(pc.struct_field(val, "key")), value=pc.struct_field(val, "value"))
        yield from neighbours(owner, key, pc.struct_field(site, "neighbours"))

        # one list a name: the place in the list is the site's index
        named, row = _kids(table)
        if len(named):
            val, n = _kids(pc.struct_field(named, "values"))
            place = pa.array(_place(n)).cast(pa.string())
            keep = pc.is_valid(val)
            val, n, place = val.filter(keep), n.filter(keep), place.filter(keep)
            yield _batch(len(val), "site_value", dump_id=ids.take(row).take(n), parent_key=place, child_key=pc.struct_field(named, "name").take(n), value=val)
        coord, row = _kids(coordination)
        if len(coord):
            yield from neighbours(ids.take(row), pc.struct_field(coord, "key"), pc.struct_field(coord, "neighbours"))


def flatten_dumps(dumps: DataFrame) -> DataFrame:
    """All children of all dumps in one long table, see CHILD; `child_table` tells which columns apply, (dump_id, parent_key) is the link to the parent.

    Null, empty or unreadable payloads have no children; null lists, empty lists and null values have none either, empty texts do. Repeated dumps give
    repeated children. Other columns are ignored. Needs no shuffle, so one huge source can't overload a task.
    """
    return typed_dumps(dumps).mapInArrow(_flatten, CHILD_DDL)


#: Flat tables and their columns.
TABLES = {
    "attribute": ["dump_id", "child_key as name", "value", "unit"],
    "site": ["dump_id", "child_key as site", "element", "position"],
    "site_value": ["dump_id", "parent_key as site", "child_key as name", "value"],
    "neighbour": ["dump_id", "parent_key as site", "child_key as place", "element", "site_index", "distance", "weight"],
}


def child_table(children: DataFrame, name: str) -> DataFrame:
    """One flat table of `flatten_dumps`."""
    return children.where(F.col("child_table") == name).selectExpr(*TABLES[name])
