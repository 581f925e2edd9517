"""Counts of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_metrics(processed: DataFrame) -> DataFrame:
    """Events, chunks in, vectors out, and failed chunks per source.

    Takes embedded events (``chunks`` and ``failed`` as arrays) or processed messages (``vectors_out`` as a count).
    """
    vectors = (
        F.col("vectors_out") if "vectors_out" in processed.columns else F.size("chunks")
    )
    return processed.groupBy("source_id").agg(
        F.count("*").alias("events"),
        F.sum("chunks_in").alias("chunks_in"),
        F.sum(vectors).cast("bigint").alias("vectors_out"),
        F.sum(F.size("failed")).cast("bigint").alias("chunks_failed"),
    )
