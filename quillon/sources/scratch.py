"""Tables in the shared folder that the cluster names in spark.checkpoint.dir.

A table written here cuts the lineage of an iterative or expensive step: executors that are lost later
cost a re-read, not a re-run. Nothing is written to a machine-local folder on a cluster.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode with none set."""
    jsc = spark.sparkContext._jsc
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, freed: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back. freed: the write's shuffle files go as soon as it is over."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP)
    try:
        if freed:
            spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def remove_all(spark: SparkSession) -> None:
    """Delete every scratch table of this library; call when no DataFrame that reads one is still in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillon")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
