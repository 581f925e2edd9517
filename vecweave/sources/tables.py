"""Reading tables of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def spread(scan: DataFrame) -> DataFrame:
    """Share the rows of a small input among all cores.

    A table of a few files is read by a few tasks, which is too few for embedding. An input with at least one read
    task per core is left alone, so what is moved is never more than one read task's worth per core.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
