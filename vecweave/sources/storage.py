"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Of narrow rows, such as pairs of numbers, a file has so many before there are more files than cores: 1 to 4 MB.
ROWS_PER_FILE = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors and the driver must reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return folder


def run_folder(spark: SparkSession) -> str:
    """Where everything is written that this application needs on the way."""
    return f"{shared_folder(spark).rstrip('/')}/vecweave-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """An unused place in the folder of this application."""
    return f"{run_folder(spark)}/{uuid.uuid4()}"


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` once and go on from the written table: nothing is computed twice, and lost executors cost only
    reading. The table stays until :func:`remove_intermediate`.

    ``rows`` is about how many narrow rows there are, if that is known. A small table is then not written as a file for
    each partition of the shuffle, but by a task for each core; a large one by more."""
    path = new_path(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_intermediate(spark: SparkSession) -> bool:
    """Remove what this application has written on the way. Frames that read it can no longer be used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
