"""The vector table: vectors by model and id, newest row wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.operators.dedup import first_by_key


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Add rows {id, model, embedding, version}; files are kept apart by model, so a search reads only its own."""
    vectors.write.mode("append").partitionBy("model").parquet(path)


def latest_vectors(vectors: DataFrame, id_column: str = "id", version: str = "version") -> DataFrame:
    """Newest row per (model, id); of rows with the same version, the one with the greater vector."""
    order = [F.col(version).desc(), F.col("embedding").desc()]
    return first_by_key(vectors, ["model", id_column], order)


def read_vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Current vectors; with ``model``, only that folder is read."""
    vectors = spark.read.parquet(path)
    if model is not None:
        vectors = vectors.filter(F.col("model") == model)
    return latest_vectors(vectors)
