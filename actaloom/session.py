"""Session helpers: tables, the shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of text in one Arrow batch; bounds the memory of a Python worker.
ARROW_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a context, unless their PYTHONPATH has it already."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_actaloom_shipped", False):
        return
    if str(root.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        path = Path(tempfile.mkdtemp(prefix="actaloom-")) / "actaloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(path))
    sc._actaloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores.

    Only inputs of fewer partitions than cores are moved, that is small ones; larger
    inputs keep the partitions of their scan and pay no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder takes its place, but only on one machine (tests);
    on a cluster each executor would write to its own disk, so that raises an error.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or os.environ.get("ACTALOOM_SHARED_DIR")
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="actaloom-")
        os.environ["ACTALOOM_SHARED_DIR"] = where
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, below the shared one; see clear."""
    return f"{shared_dir(spark)}/actaloom-{spark.sparkContext.applicationId}"


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path) of the JVM for a path on any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application. Results that were not yet written are lost."""
    fs, path = file_system(spark, run_dir(spark))
    fs.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as parquet in the run's folder and read again (column pruning holds for later readers)."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
