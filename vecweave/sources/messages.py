"""Message streams and tables: anything with a ``value`` column of JSON text or bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.constants import (
    CHUNK_TOPIC,
    EMBEDDING_TOPIC,
    MAX_MESSAGE_BYTES,
    PUBLISH_ATTEMPTS,
    PUBLISH_FIRST_WAIT_MS,
    PUBLISH_LAST_WAIT_MS,
)
from vecweave.functions.wire import dead_letter, encode_embedding_event


def kafka_source(
    servers: str, max_offsets_per_trigger: int, topic: str = CHUNK_TOPIC, **options: str
) -> dict[str, str]:
    """Options to read a topic from its beginning, at most so many messages in a micro-batch: the backlog of a topic is
    not one batch. Needs the public Kafka connector on the class path."""
    return {
        "maxOffsetsPerTrigger": str(max_offsets_per_trigger),
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        **options,
    }


def kafka_sink(servers: str, topic: str = EMBEDDING_TOPIC, **options: str) -> dict[str, str]:
    """Options to write ``key`` and ``value`` to a topic, in batches of one megabyte or 50 ms; a failed send is tried
    again with growing waits."""
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.max.request.size": str(MAX_MESSAGE_BYTES),
        "kafka.batch.size": str(1 << 20),
        "kafka.linger.ms": "50",
        "kafka.enable.idempotence": "true",
        "kafka.retries": str(PUBLISH_ATTEMPTS - 1),
        "kafka.retry.backoff.ms": str(PUBLISH_FIRST_WAIT_MS),
        "kafka.retry.backoff.max.ms": str(PUBLISH_LAST_WAIT_MS),
        **options,
    }


def read_chunk_events(
    spark: SparkSession,
    fmt: str,
    options: dict[str, str] | None = None,
    schema: str | None = None,
    streaming: bool = False,
) -> DataFrame:
    """Open a source of messages, as a table or as a stream. ``text`` gives one message per line."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(fmt).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    messages = reader.load()
    if "value" not in messages.columns:
        raise ValueError("a message source needs a value column")
    return messages


def encode_events(events: DataFrame, key: str = "source_id") -> DataFrame:
    """Embedded events as ``key`` and ``value``. The key is the source unless given; a constant one would send
    every message to the same partition of the topic."""
    return events.selectExpr(f"{key} AS key", f"{encode_embedding_event()} AS value")


def split_oversize(
    messages: DataFrame, max_bytes: int = MAX_MESSAGE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(messages that can be sent, messages too large to send)."""
    too_large = F.octet_length("value") > max_bytes
    return messages.filter(~too_large), messages.filter(too_large)


def dead_letters(
    messages: DataFrame, topic: str, error: str, failed_at: str = "current_timestamp()"
) -> DataFrame:
    """Envelopes for messages that could not be sent to ``topic``; the event in them is its JSON text. ``error`` is a
    SQL expression."""
    return messages.selectExpr("key", f"{dead_letter(topic, error, 'value', failed_at)} AS value")


def write_messages(
    messages: DataFrame, fmt: str, options: dict[str, str] | None = None, mode: str = "append"
) -> None:
    """Write messages; failed tasks are tried again by Spark."""
    messages.write.format(fmt).options(**(options or {})).mode(mode).save()
