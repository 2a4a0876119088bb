"""Cutting lineage with written tables.

A cut table lies in the shared folder (`spark.checkpoint.dir`), so it outlives any executor. The
tables of earlier rounds of a loop are dropped by the caller, the rest when the driver ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyloom.session import shared_dir

_live: dict[str, SparkSession] = {}


class CutTable:
    """A DataFrame that was written once, with the path it was written to."""

    def __init__(self, df: DataFrame, path: str):
        self.df, self.path = df, path

    def drop(self) -> None:
        remove(self.df.sparkSession, self.path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _live.pop(path, None)


def cut(df: DataFrame, label: str = "cut") -> CutTable:
    """Write `df` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _live[path] = spark
    return CutTable(spark.read.schema(df.schema).parquet(path), path)


@atexit.register
def _clean() -> None:
    for path, spark in list(_live.items()):
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already
            pass
