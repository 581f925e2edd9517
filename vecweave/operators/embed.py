"""Embedding of tables and streams of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.constants import DEFAULT_BATCH_SIZE
from vecweave.functions.text import column, quoted, truncate_all
from vecweave.operators.embedders import Embedder, check_batch_size, check_scope

# Rows are put together to batches so many bytes at a time.
_PART_BYTES = 8 << 20


def with_outcomes(
    df: DataFrame,
    texts: str,
    embedder: Embedder,
    batch_size: int | str = DEFAULT_BATCH_SIZE,
    on_error: str = "row",
    name: str = "outcomes",
) -> DataFrame:
    """Add an array of outcomes for an array of texts (a SQL expression). Every row stays whole and in place, so
    regrouping is free."""
    cut = truncate_all(texts, embedder.max_bytes)
    return df.withColumn(name, embedder.outcomes(cut, batch_size, on_error))


def embed_rows(
    df: DataFrame,
    embedder: Embedder,
    text: str = "text",
    batch_size: int = DEFAULT_BATCH_SIZE,
    on_error: str = "row",
) -> DataFrame:
    """Embed one text per row (``text`` is a column or a SQL expression): adds ``embedding``, ``model``, ``dimension`` (the real length) and ``error``.

    Rows whose text failed stay, with an error and no vector; see :func:`embedded` and :func:`failures`. Empty
    texts are embedded like any other.
    """
    df = with_outcomes(df, f"array({text})", embedder, batch_size, on_error, "_outcomes")
    return df.selectExpr(
        *[column(c) for c in df.columns if c != "_outcomes"],
        "_outcomes[0].embedding AS embedding",
        f"{quoted(embedder.name)} AS model",
        "CAST(size(_outcomes[0].embedding) AS BIGINT) AS dimension",
        "_outcomes[0].error AS error",
    )


def embedded(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNull()).drop("error")


def failures(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNotNull()).drop("embedding", "dimension")


def check_positions(df: DataFrame, position: str) -> None:
    """Positions must be 0, 1, 2, ... without gaps or repeats; one pass over that column, and nothing is shuffled.

    As many positions as rows that hash to what 0 to the last one hash to are all of these: one that is missing, or there
    twice, would change what is left of the exclusive or of all hashes.
    """
    digest = F.bit_xor(F.xxhash64(F.col(position).cast("bigint"))).alias("digest")
    found = df.agg(F.count("*").alias("rows"), F.min(position).alias("least"), F.max(position).alias("most"), digest).first()
    if not found["rows"]:
        return
    want = df.sparkSession.range(found["rows"]).select(F.bit_xor(F.xxhash64("id"))).first()[0]
    if (found["least"], found["most"], found["digest"]) != (0, found["rows"] - 1, want):
        raise ValueError(f"{position} must number the rows from 0 without gaps or repeats: {found.asDict()}")


def embed_numbered(
    df: DataFrame,
    text: str,
    position: str,
    embedder: Embedder,
    batch_size: int = DEFAULT_BATCH_SIZE,
    check: bool = True,
) -> DataFrame:
    """Embed a table in batches by a unique position without gaps: ``batch_no``, ``embeddings`` in order or an ``error``
    for the whole batch. Every batch has ``batch_size`` texts, but for the last.

    Texts are embedded where they are, in calls of neighbouring rows; only vectors move to their batch. ``check`` makes
    sure of the positions.
    """
    check_batch_size(batch_size)
    if check:
        check_positions(df, position)
    rows = embed_rows(df.select(position, text), embedder, text, batch_size)
    grouped = rows.groupBy(F.floor(F.col(position) / batch_size).alias("batch_no")).agg(
        F.array_sort(F.collect_list(F.struct(position, "embedding"))).alias("_items"), F.max("error").alias("error")
    )
    return grouped.select(
        "batch_no", F.when(F.col("error").isNull(), F.col("_items.embedding")).alias("embeddings"), "error"
    )


def _parts(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``_PART_BYTES``, at least ``least`` rows each: parts are copied, the batch is not."""
    step = max(least, int(batch.num_rows * _PART_BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def filled_batches(
    df: DataFrame, text: str, batch_size: int = DEFAULT_BATCH_SIZE, row_id: str | None = None
) -> DataFrame:
    """Cut every partition into batches of ``batch_size`` as the rows come; only its last may be short.

    ``row_id`` carries a column along as ``ids``, in the order of ``texts``. Works on streams, where a batch is filled
    from one micro-batch, and shuffles nothing.
    """
    check_batch_size(batch_size)
    chosen = df.select(*([F.col(row_id).alias("ids")] if row_id else []), F.col(text).alias("texts"))
    names = chosen.columns
    schema = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in chosen.schema)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def cut(rows: pa.RecordBatch) -> pa.RecordBatch:
            offsets = pa.array([*range(0, rows.num_rows, batch_size), rows.num_rows], pa.int32())
            columns = [pa.ListArray.from_arrays(offsets, column) for column in rows.columns]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in (part for whole in batches for part in _parts(whole, batch_size)):
            kept.append(batch)
            size = sum(one.num_rows for one in kept)
            if size < batch_size:
                continue
            rows = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            whole = size - size % batch_size
            yield cut(rows.slice(0, whole))
            kept = [rows.slice(whole)] if whole < size else []
        if kept and (rest := pa.Table.from_batches(kept).combine_chunks().to_batches()):
            yield cut(rest[0])

    return chosen.mapInArrow(fill, schema)


def embed_batches(batches: DataFrame, embedder: Embedder, on_error: str = "batch") -> DataFrame:
    """One model call per row of ``texts``: ``embeddings`` in order, or an ``error`` for the whole batch.

    Later batches still come after a failed one. Other columns are kept. Works on streams.
    """
    check_scope(on_error)
    size = "greatest(size(texts), 1)"
    df = with_outcomes(batches, "texts", embedder, size, on_error, "_outcomes")
    error = "get(filter(_outcomes.error, error -> error IS NOT NULL), 0)"
    return df.selectExpr(
        *[column(c) for c in df.columns if c not in ("_outcomes", "texts")],
        f"CASE WHEN {error} IS NULL THEN _outcomes.embedding END AS embeddings",
        f"{error} AS error",
    )


def reorder_by_index(data: str) -> str:
    """SQL of the vectors of a model answer array<struct<index, embedding>>, in index order."""
    return (
        f"transform(array_sort({data}, (a, b) -> CASE WHEN a.index < b.index THEN -1 WHEN a.index > b.index THEN 1 "
        "ELSE 0 END), item -> item.embedding)"
    )
