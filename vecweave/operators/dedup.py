"""One row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from vecweave.operators.joins import MAX_BROADCAST_BYTES, size_in_bytes
from vecweave.sources.storage import materialize


def first_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row per key. Spark keeps only the first row per key of every task before the shuffle, so a key that
    holds a large part of all rows sends one row per task, not all of them."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(window)).filter("_row = 1").drop("_row")


def _whole_order(events: DataFrame, order: list[str]) -> list[Column]:
    """``order``, nulls first, and then a hash of the whole row: rows that still tie are equal."""
    hashable = [f"`{f.name}`" for f in events.schema if not isinstance(f.dataType, (MapType, VariantType))]
    return [*[F.col(column).asc_nulls_first() for column in order], F.xxhash64(*hashable)]


def dedup_events(
    events: DataFrame,
    order: list[str],
    event_id: str = "event_id",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Suppress repeated events: of equal ids the first in ``order`` stays, exactly one row.

    Nulls in ``order`` come first; rows with equal id and order, as a replayed event has, are put in order by a hash of
    the row. A null id is an id like any other.

    Ids are counted first, over the id column alone. If the list of repeated ones is small in bytes, events that do not
    repeat stay where they are and only the others are ranked; otherwise all are. The rows are the same.
    """
    ranking = _whole_order(events, order)
    repeated = materialize(events.groupBy(F.col(event_id).alias("_id")).count().filter("count > 1").select("_id"))
    if size_in_bytes(repeated) > max_broadcast_bytes:
        return first_by_key(events, [event_id], ranking)
    same = F.col(event_id).eqNullSafe(F.col("_id"))
    alone = events.join(F.broadcast(repeated), same, "left_anti")
    copies = events.join(F.broadcast(repeated), same, "left_semi")
    return alone.union(first_by_key(copies, [event_id], ranking))
