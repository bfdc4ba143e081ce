"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys that a round of a loop may send to all executors.
FEW = 20_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; one of our own only in a local session (a test) that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factweave-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write once, read back: cuts the lineage of loops and survives lost executors."""
    path = os.path.join(shared_dir(df.sparkSession), f"factweave-{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """To be joined by sorting both sides, however small its files are.

    Spark goes by the size of the files, and facts repeat few values: ten megabytes of them, which it would send whole
    through the driver, hold millions of rows.
    """
    return df.hint("merge")


def counted(df: DataFrame, rows: int) -> DataFrame:
    """To be joined by sending it to all executors if it has few rows, else as ``large``."""
    return F.broadcast(df) if rows <= FEW else large(df)


def importable(spark: SparkSession) -> None:
    """Let Python workers that share the driver's files find this package (else ship it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
