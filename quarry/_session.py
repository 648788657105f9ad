"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Tables a data folder holds, one Parquet file or folder each.
TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def workers_see_package(spark: SparkSession) -> None:
    """Put the repository on the Python path of the workers of ``spark``.

    Functions of the package are pickled by reference, so workers import them; a driver that was
    started from another folder would otherwise leave them without the package.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark's own reader, so that any store Spark knows will do."""
    workers_see_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``; a temporary one only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return sc.getCheckpointDir()


#: Bytes for each core below which a table is dealt over all cores before work in Python.
SMALL_SHARE = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt over all cores; larger tables keep their splits, so no text is shuffled.

    A small table is often one file with one row group, which only one task can read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_SHARE else df
