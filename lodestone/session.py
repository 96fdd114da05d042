"""Session helpers: the shared folder, cutting lineage through written tables, reading the input tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir; a folder of its own only where that is unset (tests on one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


_kept: dict[str, tuple] = {}


def _forget() -> None:
    """At the end of the program: what it wrote to the shared folder goes. The JVM outlives the session, so this works after spark.stop(), too."""
    for root, (jvm, conf) in list(_kept.items()):
        try:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the JVM is gone: nothing more can be done
            return


atexit.register(_forget)


class Scratch:
    """Written tables in the shared folder; `keep` cuts the lineage, `drop` removes a table that nothing reads any more, `clear` all of them. What a result still reads
    stays until the program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        _kept[self.root] = (spark._jvm, spark._jsc.hadoopConfiguration())

    def clear(self) -> None:
        jvm, conf = _kept.pop(self.root)
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(conf).delete(path, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and read it back: what follows survives the loss of executors without computing df again."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lodestone_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_lodestone_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
