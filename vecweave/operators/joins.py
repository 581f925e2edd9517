"""Choosing how to join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A side is sent to every task up to so many bytes.
MAX_BROADCAST_BYTES = 32 << 20
# What a row and a value of fixed size take, about.
_ROW_BYTES = 16


def size_in_bytes(df: DataFrame) -> int:
    """About how many bytes all rows take: texts by their length, other values by a fixed size. Only strings and plain
    values are meant."""
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if isinstance(f.dataType, StringType)]
    fixed = F.lit(_ROW_BYTES * (1 + len(df.columns))).cast("bigint")
    return df.agg(F.sum(sum(texts, fixed)).alias("bytes")).first()["bytes"] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcasting if it has at most ``max_bytes``; otherwise leave the join to Spark, which shuffles
    and splits hot keys at run time. Rows are the same either way. ``df`` is read for it, so give a written table."""
    return F.broadcast(df) if size_in_bytes(df) <= max_bytes else df
