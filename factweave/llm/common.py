"""Pieces shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words: the ASCII white space of the contracts.
SPACE = r"[\x20\x09-\x0D]+"
#: The same characters, for trimming.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """A top-level column, whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (a test) that names none gets one of our own; on a cluster that would be a folder of one machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factweave-"))
    return spark.sparkContext.getCheckpointDir()


#: Seconds between two collections of the driver's garbage, and when the last one was.
TIDY_SECONDS = 8
_tidied = [time.monotonic()]


def tidy(spark: SparkSession) -> None:
    """Let the driver forget finished plans, so that Spark's cleaner drops their shuffle files and broadcasts.

    Spark itself does so every half hour or where the heap is full; operators of many steps need it sooner.
    """
    if time.monotonic() - _tidied[0] >= TIDY_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _trim(spark)
        _tidied[0] = time.monotonic()


def _trim(spark: SparkSession) -> None:
    """Give back to the system what the driver's JVM has freed outside its heap (compiling takes most of it).

    The C library keeps that for its many threads otherwise, hundreds of megabytes in a session of many plans. JVMs that lack the
    command (before 17.0.9, or not on glibc) go without.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds, given = array(jvm.Class, 4), array(jvm.Object, 4)
    try:
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.Class.forName(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By the interface's method: the server's own class isn't open to calls.
        jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        pass


class Kept:
    """A table written to the shared folder: its rows are computed once and survive lost executors."""

    def __init__(self, df: DataFrame, tag: str, partition_by: Sequence[str] = ()):
        self.spark = df.sparkSession
        self.path = os.path.join(shared_dir(self.spark), f"factweave-{tag}-{uuid.uuid4().hex}")
        df.write.parquet(self.path, partitionBy=list(partition_by) or None)
        self.schema = df.schema
        tidy(self.spark)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files; only once no plan will read them again."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and read back (cuts the lineage without executor-local blocks)."""
    return Kept(df, tag).df


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where they share the driver's files but not its ``sys.path``.

    Elsewhere the package is shipped with ``--py-files``; the extra path then does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def extend_rows(df: DataFrame, inputs: Sequence[str], outputs: Sequence[T.StructField], make: Callable[[], Callable[[list[list]], list[list]]], rows_at_once: int = 256) -> DataFrame:
    """Add Python-computed columns to every row, Arrow batch by Arrow batch.

    ``make()`` runs once a task and returns ``fn``: lists of the input columns' values in, lists of the
    output columns' values out, for ``rows_at_once`` rows at a time, so memory stays bounded by a few rows.
    An existing column of an output's name is replaced, as ``withColumn`` would.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = {f.name for f in outputs}
    kept = [c for c in df.columns if c not in names]
    moved = [c for c in dict.fromkeys(inputs) if c in names]
    importable(df.sparkSession)
    source = df.select(*[col(c) for c in kept], *[col(c).alias(f"__in_{k}") for k, c in enumerate(moved)])
    at = [kept.index(c) if c in kept else len(kept) + moved.index(c) for c in inputs]
    types = [to_arrow_type(f.dataType) for f in outputs]
    n_kept, out_names = len(kept), kept + [f.name for f in outputs]
    schema = T.StructType([df.schema[c] for c in kept] + list(outputs))

    def run(batches):
        import pyarrow as pa

        fn = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(start, rows_at_once)
                made = fn([part.column(i).to_pylist() for i in at])
                arrays = [part.column(i) for i in range(n_kept)] + [pa.array(v, type=t) for v, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=out_names)

    return source.mapInArrow(run, schema)
