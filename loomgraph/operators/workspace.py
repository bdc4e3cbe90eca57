"""Durable intermediate tables.

A job that loses executors must not lose finished work, so lineage is cut by
writing Parquet into the shared folder the cluster names in
``spark.checkpoint.dir``.  Nothing is kept in executor-local storage.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: list["Workspace"] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; only where it is unset (tests), a local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """A folder of Parquet tables that live as long as the result that reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/loomgraph/{name}-{uuid.uuid4().hex[:12]}"
        self._made = 0
        _OPEN.append(self)

    def path(self, label: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made:04d}-{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back."""
        path = self.path(label)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loom_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables nothing reads any more."""
        for f in frames:
            delete(self.spark, f._loom_path)

    def tidy(self) -> None:
        """Let Spark's cleaner remove shuffle files of plans that are gone."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        delete(self.spark, self.root)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _close_all() -> None:
    for w in _OPEN:
        try:
            if w.spark.sparkContext._jsc is not None:
                w.close()
        except Exception:  # the JVM may be gone already
            pass
