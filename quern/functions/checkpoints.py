"""The folder that all executors share: lineage cuts and intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder that goes with the process if Spark is local, else an error."""
    sc = spark.sparkContext
    own = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quern-")
        _OWN.append(own)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(own)
    return own


@atexit.register
def _drop_own() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, below a folder of this application."""
    return f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back, so that plans that use it twice don't compute it twice."""
    df.write.parquet(path := table_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; DataFrames that read them are of no use after that."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}")
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
