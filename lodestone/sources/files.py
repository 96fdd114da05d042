"""Structure files as tables, and tables as structure files. Files are read by Spark's own reader, so any file system it knows will do, and parsed in Arrow batches.

A frame that can't be read becomes a row with `problem` set and no structure; the frames before it in its file are kept, and other files aren't affected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.formats import WRITERS, cube_values, parser_for

SCHEMA = pa.schema([
    ("path", pa.string()), ("frame", pa.int32()), ("label", pa.string()), ("elements", pa.list_(pa.string())), ("kinds", pa.list_(pa.string())), ("positions", pa.list_(pa.list_(pa.float64()))),
    ("is_cartesian", pa.bool_()), ("pbc", pa.list_(pa.bool_())), ("cell", pa.list_(pa.list_(pa.float64()))), ("attributes", pa.map_(pa.string(), pa.string())), ("site_attributes", pa.map_(pa.string(), pa.list_(pa.string()))), ("problem", pa.string()),
])
DDL = "path string, frame int, label string, elements array<string>, kinds array<string>, positions array<array<double>>, is_cartesian boolean, pbc array<boolean>, cell array<array<double>>, attributes map<string,string>, site_attributes map<string,array<string>>, problem string"


def _rows(path: str, text: str, fmt: str | None) -> Iterator[dict]:
    frame = 0
    try:
        for s in parser_for(path, fmt)(text):
            yield {
                "path": path, "frame": frame, "label": s.get("label"), "elements": s["elements"], "kinds": s.get("kinds"), "positions": s["positions"], "is_cartesian": s.get("is_cartesian", True), "pbc": s.get("pbc"),
                "cell": s.get("cell"), "attributes": [(k, str(v)) for k, v in (s.get("attributes") or {}).items()], "site_attributes": list((s.get("site_attributes") or {}).items()), "problem": None,
            }
            frame += 1
    except (ValueError, KeyError, IndexError) as e:
        yield {"path": path, "frame": frame, "problem": str(e) or type(e).__name__}


def _parse(fmt: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[dict] = []
                for r in _rows(path, (content or b"").decode("utf-8", "replace"), fmt):
                    rows.append(r)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return run


def _files(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select("path", "content")


def read_structures(spark: SparkSession, path: str, fmt: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows of SCHEMA from a file, folder or glob; the format follows from each file's name unless given (see formats.PARSERS). pattern filters file names."""
    return _files(spark, path, pattern).mapInArrow(_parse(fmt), DDL)


def read_cube_values(spark: SparkSession, path: str) -> DataFrame:
    """(path, ix, iy, iz, value): the grids of cube files, one row a point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ix, iy, iz, v = zip(*cube_values(content.decode()))
                for a in range(0, len(v), 50_000):
                    s = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(v[s])), pa.array(ix[s], pa.int32()), pa.array(iy[s], pa.int32()), pa.array(iz[s], pa.int32()), pa.array(v[s])], names=["path", "ix", "iy", "iz", "value"])

    return _files(spark, path, "*.cube").mapInArrow(run, "path string, ix int, iy int, iz int, value double")


def structure_text(fmt: str) -> Callable:
    """An Arrow function: batches of (key, label, elements, kinds, positions, is_cartesian, pbc, cell) to (key, text); rows that can't be written have null text."""
    write = WRITERS[fmt]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s in b.to_pylist():
                try:
                    out.append(write(s) if s["elements"] and len(s["elements"]) == len(s["positions"] or []) else None)
                except (TypeError, ValueError, KeyError, AttributeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["key", "text"])

    return run


def to_text(structures: DataFrame, fmt: str, key: str = "seq") -> DataFrame:
    """(key, text): each structure in a format of formats.WRITERS; null where it has no sites, or no cell and the format needs one."""
    have = structures.columns
    cols = [F.col(key).cast("string").alias("key")] + [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("label", "elements", "kinds", "positions", "is_cartesian", "pbc", "cell")]
    return structures.select(*cols).mapInArrow(structure_text(fmt), "key string, text string")


def write_structures(structures: DataFrame, path: str, fmt: str, key: str = "seq") -> None:
    """Text files in a folder: formats of many frames (xyz, xsf, cif) as one file a task, others with a folder `key=…` for each structure."""
    text = to_text(structures, fmt, key).where("text is not null")
    if fmt in ("xyz", "cif"):
        text.select("text").write.text(path)
    else:
        text.write.partitionBy("key").text(path)
