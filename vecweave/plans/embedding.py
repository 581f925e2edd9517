"""From message to message: decode, embed, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.constants import DEFAULT_BATCH_SIZE, EMBEDDING_TOPIC, MAX_MESSAGE_BYTES
from vecweave.functions.wire import dead_letter, encode_embedding_event, message_pointer
from vecweave.operators.chunks import embed_events
from vecweave.operators.decode import decode_events
from vecweave.operators.embedders import Embedder

PUBLISHED, DEAD_LETTER, REJECTED, EMPTY = "published", "dead_letter", "rejected", "empty"


def process_messages(
    messages: DataFrame,
    embedder: Embedder,
    now: str = "current_timestamp()",
    topic: str = EMBEDDING_TOPIC,
    max_bytes: int = MAX_MESSAGE_BYTES,
    batch_size: int = DEFAULT_BATCH_SIZE,
    on_error: str = "row",
    value: str = "value",
) -> DataFrame:
    """Chunk-event messages to embedding-event messages, one row per message and nothing lost.

    ``outcome`` says where a row goes: ``published`` (``value`` is the event), ``dead_letter`` (too large; ``value`` is
    the envelope, with digests that point to the message, which is in ``message``), ``rejected`` (undecodable;
    ``message`` and ``value`` are the message as it came), ``empty`` (no vectors, nothing to send). A letter always holds
    the same and is short, so it can be sent whatever the event was. The whole flow is narrow: a message never leaves its
    partition, so no source or event can become hot.
    """
    decoded = decode_events(messages.select(value), value)
    return process_decoded(decoded, embedder, now, topic, max_bytes, batch_size, on_error, value)


def process_decoded(
    decoded: DataFrame,
    embedder: Embedder,
    now: str = "current_timestamp()",
    topic: str = EMBEDDING_TOPIC,
    max_bytes: int = MAX_MESSAGE_BYTES,
    batch_size: int = DEFAULT_BATCH_SIZE,
    on_error: str = "row",
    value: str = "value",
) -> DataFrame:
    """:func:`process_messages` from decoded messages on."""
    # Rejected messages have no chunks; they pass the embedder as empty lists.
    chunks = F.coalesce(F.col("chunks"), F.array().cast(decoded.schema["chunks"].dataType))
    events = embed_events(
        decoded.withColumn("chunks", chunks), embedder, now, batch_size, on_error
    )
    # A number takes at least four bytes of JSON; what is too large by that alone is not encoded at all, as its text
    # could be hundreds of times the limit. Its letter is that of any event that is too large.
    least = "aggregate(chunks, 0L, (total, chunk) -> total + chunk.dimension) * 4"
    events = events.withColumn("vectors_out", F.size("chunks").cast("bigint")).withColumn(
        "_event",
        F.expr(
            f"CASE WHEN vectors_out > 0 AND {least} <= {max_bytes} THEN {encode_embedding_event()} END"
        ),
    )
    events = events.withColumn(
        "outcome",
        F.when(F.col("reject_reason").isNotNull(), REJECTED)
        .when(F.col("vectors_out") == 0, EMPTY)
        .when(F.octet_length("_event") <= max_bytes, PUBLISHED)
        .otherwise(DEAD_LETTER),
    )
    too_large = f"'message of more than {max_bytes} bytes'"
    return events.selectExpr(
        "outcome",
        "source_id AS key",
        f"""CASE outcome WHEN '{PUBLISHED}' THEN _event
            WHEN '{DEAD_LETTER}' THEN {dead_letter(topic, too_large, message_pointer(value), now)}
            WHEN '{REJECTED}' THEN CAST({value} AS STRING) END AS value""",
        f"CASE WHEN outcome IN ('{DEAD_LETTER}', '{REJECTED}') THEN CAST({value} AS STRING) END AS message",
        f"""CASE outcome WHEN '{REJECTED}' THEN reject_reason
            WHEN '{DEAD_LETTER}' THEN {too_large} END AS error""",
        "source_id",
        "headers.event_id AS event_id",
        "chunks_in",
        "vectors_out",
        "failed",
    )
