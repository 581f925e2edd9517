"""The list of models, and which model a row is for."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.constants import DECLARED_DIMENSION, MAX_INPUT_BYTES
from vecweave.operators.embedders import Embedder
from vecweave.operators.joins import broadcast_if_small


def models_table(spark: SparkSession, embedders: Iterable[Embedder]) -> DataFrame:
    """One row per model: name, declared dimension, input limit."""
    rows = [(e.name, e.dimension, e.max_bytes) for e in embedders]
    return spark.createDataFrame(rows, "model string, dimension bigint, max_bytes bigint")


def list_models(named: DataFrame, model: str = "model") -> DataFrame:
    """The models a table names, with the limits every model is declared to have."""
    return (
        named.select(F.col(model).alias("model"))
        .filter(F.col("model").isNotNull())
        .distinct()
        .withColumn("dimension", F.lit(DECLARED_DIMENSION).cast("bigint"))
        .withColumn("max_bytes", F.lit(MAX_INPUT_BYTES).cast("bigint"))
    )


def route_models(df: DataFrame, models: DataFrame, default: str, strict: bool = False) -> DataFrame:
    """Fill in the default model and look the name up. Unknown names are accepted with the declared limits, or,
    if ``strict``, get an ``error``. A name that ``models`` repeats counts once, with its smallest limits. A default that
    most rows use stays spread out: the list of models is broadcast, after a check of its bytes."""
    named = df.withColumn("model", F.coalesce(F.col("model"), F.lit(default)))
    models = models.groupBy("model").agg(*[F.min(c).alias(c) for c in models.columns if c != "model"])
    models = models.withColumn("_known", F.lit(True))
    joined = named.join(broadcast_if_small(models), "model", "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    if strict:
        joined = joined.withColumn("error", F.when(~known, F.lit("model not found")))
    else:
        joined = joined.withColumn(
            "dimension", F.coalesce("dimension", F.lit(DECLARED_DIMENSION).cast("bigint"))
        ).withColumn("max_bytes", F.coalesce("max_bytes", F.lit(MAX_INPUT_BYTES).cast("bigint")))
    return joined.withColumn("known", known).drop("_known")
