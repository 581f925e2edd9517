"""Small DataFrame helpers of the operators in this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key with more rows than this is split before it meets the one row of the other side. At most (all rows / this)
# keys can be that large, which bounds the list of them.
ROWS_PER_SPLIT = 200_000
# What regular expressions and Python's bytes.split() agree on as white space in ASCII.
WHITE_SPACE = " \t\n\x0b\x0c\r"


@contextmanager
def small_batches(spark: SparkSession, size: str = "16m"):
    """Arrow batches of at most ``size`` for what is run inside, whatever the session has: half a dozen copies of a batch
    are alive at a time, in Spark's buffers and in Python. The session has its own setting again afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh_names(df: DataFrame, count: int = 1) -> list[str]:
    """Column names that ``df`` does not have, whatever its own are called."""
    taken = {c.lower() for c in df.columns}
    found: list[str] = []
    while len(found) < count:
        name = f"_{uuid.uuid4().hex[:12]}"
        if name not in taken:
            found.append(name)
    return found


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``value`` bound to ``name``: it is computed once, also where lambdas use it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def split_join(many: DataFrame, one: DataFrame, key: str, size: str, how: str = "left", spread_by: Column | None = None, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Join ``many`` rows per key with ``one`` row per key, which knows in ``size`` how many rows the key has.

    Keys with more than ``rows_per_split`` rows are dealt over several tasks, each with its own copy of the one row.
    ``spread_by`` deals them; without it the other columns of ``many`` do. ``size`` is dropped.
    """
    splits, part = fresh_names(many.select(*many.columns, *[F.lit(0).alias(c) for c in one.columns if c not in many.columns]), 2)
    hot = F.broadcast(
        one.filter(F.col(size) > rows_per_split).select(key, F.ceil(F.col(size) / rows_per_split).alias(splits))
    )
    number = F.coalesce(F.col(splits), F.lit(1).cast("bigint"))
    dealt = F.xxhash64(*[c for c in many.columns if c != key]) if spread_by is None else spread_by
    left = many.join(hot, key, "left").withColumn(part, F.pmod(dealt, number)).drop(splits)
    right = (
        one.join(hot, key, "left")
        .withColumn(part, F.explode(F.sequence(F.lit(0).cast("bigint"), number - 1)))
        .drop(splits, size)
    )
    return left.join(right, [key, part], how).drop(part)
