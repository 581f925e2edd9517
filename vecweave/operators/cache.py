"""Reuse of known vectors: embed only texts the cache does not hold.

The cache is a table {key, model, embedding} with unique keys (``text_key``). Copies of one text may make up a large
part of all rows. Keys are therefore counted with partial aggregation, each missing text is embedded once, and the
join back splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.functions.text import text_key
from vecweave.operators.embed import embed_rows
from vecweave.operators.embedders import Embedder
from vecweave.operators.joins import MAX_BROADCAST_BYTES, broadcast_if_small, size_in_bytes
from vecweave.sources.cache_table import CacheTable
from vecweave.sources.storage import materialize

# A key with more rows than this is split. At most (all rows / this) keys can be, so their list is safe to broadcast:
# for 10^12 rows, 10^6 keys of under 100 bytes.
ROWS_PER_SPLIT = 1_000_000


def keyed_rows(rows: DataFrame, embedder: Embedder, row_id: str, text: str = "text") -> DataFrame:
    return rows.selectExpr(row_id, f"{text_key(embedder.name, text, embedder.max_bytes)} AS key")


def count_keys(keyed: DataFrame, row_id: str) -> DataFrame:
    """Per key: how many rows, and the one that stands for them."""
    return keyed.groupBy("key").agg(
        F.min(row_id).alias(row_id), F.count("*").alias("copies")
    )


def cache_misses(counted: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys the cache does not hold. Both sides have every key once, so no key is hot."""
    return counted.join(cache.select("key"), "key", "left_anti")


def join_vectors(
    keyed: DataFrame,
    counted: DataFrame,
    known: DataFrame,
    row_id: str,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Give every row the vector of its key. Rows of a hot key are spread over several partitions, each with its
    own copy of the vector."""
    splits = F.ceil(F.col("copies") / rows_per_split)
    hot = F.broadcast(
        counted.filter(F.col("copies") > rows_per_split).select("key", splits.alias("splits"))
    )
    many = F.coalesce(F.col("splits"), F.lit(1).cast("bigint"))
    rows = keyed.join(hot, "key", "left").select(
        row_id, "key", F.pmod(F.xxhash64(row_id), many).alias("split")
    )
    vectors = known.join(hot, "key", "left").select(
        "key", "embedding", F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1)).alias("split")
    )
    return rows.join(vectors, ["key", "split"], "left").drop("split")


def _rows_to_embed(rows: DataFrame, keyed: DataFrame, missing: DataFrame, row_id: str, max_bytes: int) -> DataFrame:
    """The rows that stand for missing keys. Texts stay where they are if either these rows or all others are few enough
    for a list of their ids to be sent to every task; the choice does not change the rows."""
    wanted = missing.select(row_id)
    if size_in_bytes(wanted) <= max_bytes:
        return rows.join(F.broadcast(wanted), row_id, "left_semi")
    others = materialize(keyed.join(wanted, row_id, "left_anti").select(row_id))
    if size_in_bytes(others) <= max_bytes:
        return rows.join(F.broadcast(others), row_id, "left_anti")
    return rows.join(wanted, row_id, "left_semi")


def _embed_missing(
    rows: DataFrame, keyed: DataFrame, missing: DataFrame, embedder: Embedder, row_id: str, text: str, on_error: str, max_bytes: int
) -> DataFrame:
    """New entries for missing keys, written once, so that the model is called once for each."""
    texts = _rows_to_embed(rows.select(row_id, text), keyed, missing, row_id, max_bytes).withColumn(
        "key", F.expr(text_key(embedder.name, text, embedder.max_bytes))
    )
    found = embed_rows(texts, embedder, text, on_error=on_error)
    return materialize(found.filter("error is null").select("key", "model", "embedding"))


def embed_with_table(
    rows: DataFrame,
    table: CacheTable,
    embedder: Embedder,
    row_id: str,
    text: str = "text",
    on_error: str = "row",
    rows_per_split: int = ROWS_PER_SPLIT,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """(row id, key, embedding) for every row; what was not known is in ``table`` afterwards.

    Keys move to the buckets of the table, and what is found there moves to the rows; other entries stay where they are.
    Row ids must be unique. Rows whose text failed have no embedding.
    """
    keyed = materialize(keyed_rows(rows, embedder, row_id, text))
    counted = materialize(count_keys(keyed, row_id))
    missing = materialize(cache_misses(counted, table.lookup(counted.select("key"))).select(row_id, "key"))
    table.append(_embed_missing(rows, keyed, missing, embedder, row_id, text, on_error, max_broadcast_bytes))
    return join_vectors(keyed, counted, table.lookup(counted.select("key")), row_id, rows_per_split)


def embed_with_cache(
    rows: DataFrame,
    cache: DataFrame,
    embedder: Embedder,
    row_id: str,
    text: str = "text",
    on_error: str = "row",
    rows_per_split: int = ROWS_PER_SPLIT,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Returns (row id, key, embedding) for every row, and the new cache entries to append.

    Row ids must be unique. Rows whose text failed have no embedding. New entries are written once and read back, so
    the model is called once per missing text.
    """
    keyed = materialize(keyed_rows(rows, embedder, row_id, text))
    counted = materialize(count_keys(keyed, row_id))
    missing = materialize(cache_misses(counted, cache).select(row_id, "key"))
    fresh = _embed_missing(rows, keyed, missing, embedder, row_id, text, on_error, max_broadcast_bytes)
    # Of the cache, only vectors that are wanted take part in what follows.
    wanted = broadcast_if_small(materialize(counted.join(missing, "key", "left_anti").select("key")), max_broadcast_bytes)
    known = cache.select("key", "model", "embedding").join(wanted, "key", "left_semi").unionByName(fresh)
    return join_vectors(keyed, counted, known, row_id, rows_per_split), fresh
