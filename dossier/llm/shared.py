"""What several operators of this package need: the shared folder, written tables, value binding."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from dossier.functions.places import bind

__all__ = ["bind", "clear", "fresh", "scratch", "shared_dir", "written"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The part of the shared folder that holds what this application has written between its steps."""
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has written between its steps; DataFrames made of it cannot be read after."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet to the shared folder and read from there, until ``clear``."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, for a helper column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
