"""Events, their chunks, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.constants import DEFAULT_BATCH_SIZE
from vecweave.functions.text import column, quoted, rfc3339
from vecweave.operators.embed import with_outcomes
from vecweave.operators.embedders import Embedder


def explode_chunks(events: DataFrame) -> DataFrame:
    """One row per chunk with its position; an event without chunks gives none."""
    others = [column(c) for c in events.columns if c != "chunks"]
    return events.select(*others, F.posexplode("chunks").alias("pos", "chunk")).select(
        *others, "pos", "chunk.*"
    )


def assemble_events(
    rows: DataFrame, key: list[str], model: str, now: str = "current_timestamp()"
) -> DataFrame:
    """Regroup embedded chunk rows to events, chunks in order of ``pos``.

    For chunk rows that were stored as a table. ``key`` must tell messages apart; event ids may repeat. Group size is
    bounded by the size of a message. Events still in one row need no regrouping, see :func:`embed_events`.
    """
    chunk = F.struct(
        "pos", "id", "file_id", "chunk_type", "language", "embedding", "model", "dimension"
    )
    carried = [c for c in ("headers", "metadata", "source_id", "repo_name") if c not in key]
    return (
        rows.groupBy(*key)
        .agg(
            *[F.first(c).alias(c) for c in carried],
            F.array_sort(F.collect_list(chunk)).alias("_chunks"),
        )
        .select(
            *key,
            *carried,
            F.transform("_chunks", lambda c: c.dropFields("pos")).alias("chunks"),
            F.lit(model).alias("model"),
            F.expr(rfc3339(now)).alias("timestamp"),
        )
    )


def embed_events(
    events: DataFrame,
    embedder: Embedder,
    now: str = "current_timestamp()",
    batch_size: int = DEFAULT_BATCH_SIZE,
    on_error: str = "row",
) -> DataFrame:
    """Embed the chunks of every event in place.

    ``chunks`` becomes the embedded chunks in order; what failed goes to ``failed``. Headers, metadata and other
    columns pass unchanged. ``chunks_in`` keeps the count before. An event may end up with no chunks: see
    :func:`publishable`.
    """
    df = with_outcomes(events, "chunks.content", embedder, batch_size, on_error, "_outcomes")
    model = quoted(embedder.name)
    joined = (
        "zip_with(chunks, _outcomes, (chunk, outcome) -> named_struct('chunk', chunk, 'outcome', outcome))"
    )
    embedded = (
        "named_struct('id', item.chunk.id, 'file_id', item.chunk.file_id, 'chunk_type', item.chunk.chunk_type, "
        "'language', item.chunk.language, 'embedding', item.outcome.embedding, "
        f"'model', {model}, 'dimension', CAST(size(item.outcome.embedding) AS BIGINT))"
    )
    failed = (
        f"transform({joined}, (item, pos) -> "
        "named_struct('id', item.chunk.id, 'pos', pos, 'error', item.outcome.error))"
    )
    return df.selectExpr(
        *[column(c) for c in events.columns if c not in ("chunks", "timestamp")],
        f"transform(filter({joined}, item -> item.outcome.error IS NULL), item -> {embedded}) AS chunks",
        f"filter({failed}, item -> item.error IS NOT NULL) AS failed",
        "CAST(size(chunks) AS BIGINT) AS chunks_in",
        f"{model} AS model",
        f"{rfc3339(now)} AS timestamp",
    )


def publishable(events: DataFrame) -> DataFrame:
    """Events with at least one vector."""
    return events.filter(F.size("chunks") > 0)
