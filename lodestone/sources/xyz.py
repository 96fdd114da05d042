"""XYZ files as a Spark data source: one row a frame."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, frame int, elements array<string>, positions array<array<double>>, cell array<array<double>>, comment string"
_LATTICE = re.compile(r'Lattice\s*=\s*"([^"]+)"', re.I)


def parse_frames(lines: Iterator[str], path: str) -> Iterator[tuple]:
    """Frames of an XYZ text; a lattice in the comment gives the cell. A frame that is cut off or holds bad numbers raises with its place."""
    frame, at = 0, 0
    lines = iter(lines)
    for line in lines:
        at += 1
        if not line.strip():
            continue
        try:
            n = int(line)
            comment = next(lines).rstrip("\n")
            body = [next(lines).split() for _ in range(n)]
            elements, positions = [b[0] for b in body], [[float(x) for x in b[1:4]] for b in body]
            if any(len(p) != 3 for p in positions):
                raise ValueError("a site has fewer than three coordinates")
            m = _LATTICE.search(comment)
            v = [float(x) for x in m[1].split()] if m else None
            if v is not None and len(v) != 9:
                raise ValueError("a lattice has nine numbers")
        except (ValueError, StopIteration, IndexError) as e:
            raise ValueError(f"{path}, frame {frame}, from line {at}: {e or 'the file ends too early'}") from None
        at += n + 1
        yield path, frame, elements, positions, [v[0:3], v[3:6], v[6:9]] if v else None, comment
        frame += 1


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern = options.get("path", "")

    def partitions(self) -> list[_File]:
        p = self.pattern.removeprefix("file://")
        return [_File(x) for x in sorted(glob.glob(os.path.join(p, "*.xyz") if os.path.isdir(p) else p))]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path) as f:
            yield from parse_frames(f, partition.path)


class XyzDataSource(DataSource):
    """spark.read.format("xyz").load(folder, file or glob): each file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "xyz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XyzDataSource)


def to_xyz(elements: list[str], positions: list[list[float]], cell=None, comment: str = "") -> str:
    """The text of one frame."""
    head = f'Lattice="{" ".join(repr(float(x)) for r in cell for x in r)}" {comment}'.strip() if cell else comment
    return "\n".join([str(len(elements)), head, *(f"{e} {' '.join(repr(float(x)) for x in p)}" for e, p in zip(elements, positions))]) + "\n"
