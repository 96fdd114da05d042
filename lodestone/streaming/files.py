"""Structures from a growing folder of XYZ files, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.xyz import SCHEMA, parse_frames


def stream_xyz(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming DataFrame with one row a frame; each file is read whole once, when it appears."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder).select("value", F.input_file_name().alias("path"))

    def frames(batches):
        import pandas as pd

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            yield pd.DataFrame([f for text, path in zip(b.value, b.path) for f in parse_frames(iter(text.splitlines()), path)], columns=names)

    return files.mapInPandas(frames, SCHEMA)
