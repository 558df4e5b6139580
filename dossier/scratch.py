"""One folder for what an application writes between its steps, below ``spark.checkpoint.dir``; ``clear`` deletes it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that a folder of the machine is shared by all."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def base(spark: SparkSession) -> str:
    """The application's folder; local sessions without ``spark.checkpoint.dir`` get one of the machine, clusters must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    application = spark.sparkContext.applicationId
    if not folder:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if application not in _local:
            _local[application] = "file://" + tempfile.mkdtemp(prefix="spark-")
        folder = _local[application]
    return f"{folder.rstrip('/')}/steps-{application}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder of the application."""
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once and read from there until ``clear``: for what several branches use."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that the application has written between its steps; DataFrames and indexes made of it cannot be read after."""
    from dossier.operators import index, vectors

    index.forget(spark)
    vectors.forget(spark)
    delete(spark, base(spark))


def store(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = store(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, at = store(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = store(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that is there as a whole or not at all; an error if it is there already."""
    fs, at = store(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise FileExistsError(f"{path} has been published by another writer")
