"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of our own, but only if all executors run on this machine."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fidelis-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def path_of(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = path_of(spark, path)
    return bool(system.exists(where))


def delete_path(spark: SparkSession, path: str) -> None:
    where, system = path_of(spark, path)
    system.delete(where, True)


class Scratch:
    """Tables written as Parquet below the shared folder; a lost executor costs no recomputation past them.

    drop() removes what is no longer read. The table that a lazy result still reads stays until the
    session's end, when it is removed too.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/fidelis-{label}-{uuid.uuid4().hex}", 0
        atexit.register(self._sweep)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str, **sums: Column) -> DataFrame:
        """The table written and read back; `said` has its number of rows, `n`, and the given aggregates, all seen in passing.

        They are collected in the job's last stage, whose partitions count once each however often a task is run.
        """
        seen = Observation()
        rows = df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in sums.items()))
        rows.write.option("compression", "zstd").parquet(where := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(where)
        out.scratch_path, out.said = where, seen.get
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if where := getattr(df, "scratch_path", None):
                delete_path(self.spark, where)

    def _sweep(self) -> None:
        with contextlib.suppress(Exception):
            if self.spark.sparkContext._jsc is not None:
                delete_path(self.spark, self.root)
