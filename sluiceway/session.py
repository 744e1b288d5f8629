"""Helpers around the SparkSession: table access, checkpoints, size checks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows below which a side may be broadcast without further thought.
SMALL_ROWS = 100_000


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that they need no path of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_sluiceway_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # already an archive on a worker otherwise
        path = os.path.join(tempfile.mkdtemp(prefix="sluiceway-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        sc.addPyFile(path)
    sc._sluiceway_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small scan dealt out over all cores; larger scans, which have partitions enough, stay as they are.

    What is moved is less than a partition's size times the cores. Plans with a shuffle stay as they
    are too: counting their partitions would run them.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode; on a cluster that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "sluiceway-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the checkpoint folder once and read them from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
