"""Continuous embedding of a message stream."""

from __future__ import annotations

import json
import time

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecweave.constants import EMBEDDING_TOPIC, PUBLISH_ATTEMPTS, PUBLISH_FIRST_WAIT_MS
from vecweave.functions.text import quoted
from vecweave.operators.decode import decode_events
from vecweave.operators.embedders import Embedder
from vecweave.operators.metrics import run_metrics
from vecweave.plans.embedding import REJECTED, process_decoded
from vecweave.sources.messages import dead_letters, write_messages
from vecweave.sources.publish import Publisher, publish


def drop_repeats(decoded: DataFrame, window: str, received: str, salt: str | None = None) -> DataFrame:
    """Pass each event id once within ``window`` of ``received`` (a timestamp column).

    ``decoded`` is a stream with ``reject_reason`` and ``headers``. Only valid events are suppressed: what was rejected
    has no id, passes always, and never stands in the way of a corrected message with the same id. How many were dropped
    is in the progress of the query (``numDroppedDuplicateRows``). With ``salt`` (a column that differs between copies,
    such as the offset), copies of a very frequent event are first thinned out over several partitions.
    """
    key = F.when(F.col("reject_reason").isNull(), F.concat(F.lit("event "), F.col("headers.event_id")))
    stream = decoded.withColumn("_event_id", F.coalesce(key, F.expr("concat('message ', uuid())")))
    stream = stream.withWatermark(received, window)
    if salt is not None:
        stream = stream.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(64)))
        stream = stream.dropDuplicatesWithinWatermark(["_event_id", "_salt"])
    return stream.dropDuplicatesWithinWatermark(["_event_id"]).drop("_event_id", "_salt")


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query a checkpoint belongs to: kept in it, and another one in another checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"])["id"]


def send(
    rows: DataFrame,
    fmt: str,
    options: dict[str, str],
    unsent: str,
    topic: str = EMBEDDING_TOPIC,
    attempts: int = PUBLISH_ATTEMPTS,
    first_wait: float = PUBLISH_FIRST_WAIT_MS / 1000,
) -> bool:
    """Send ``key`` and ``value`` through a format of Spark, all together, at most ``attempts`` times with waits that
    double. What cannot be sent is written as dead letters to the folder ``unsent``, and the caller goes on. Only errors of
    the write count; rows that cannot be read cannot be written as letters either, so that is an error here."""
    error = None
    for attempt in range(attempts):
        try:
            write_messages(rows, fmt, options)
            return True
        except (PySparkException, Py4JError) as failure:
            error = " ".join(str(failure).split())[:500] or type(failure).__name__
            time.sleep(first_wait * 2**attempt)
    letters = dead_letters(rows, topic, quoted(error))
    letters.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(unsent)
    return False


def run_stream(
    stream: DataFrame,
    embedder: Embedder,
    sink_path: str,
    checkpoint: str,
    dedup_window: str | None = None,
    received: str = "received",
    salt: str | None = None,
    trigger: dict | None = None,
    send_to: dict[str, tuple[str, dict[str, str]] | Publisher] | None = None,
    send_wait: float = PUBLISH_FIRST_WAIT_MS / 1000,
    **options,
) -> StreamingQuery:
    """Start the stream. Messages are decoded, repeated events are dropped if ``dedup_window`` is given, and each
    micro-batch is written to ``sink_path/messages/query_id=Q/batch_id=N/outcome=...``. Tried again after a failure, it
    overwrites its own folder, so a restart adds nothing twice; another checkpoint has another query id and overwrites
    nothing. Counts per source are in ``sink_path/metrics``. The checkpoint keeps the position.

    ``send_to`` also passes ``key`` and ``value`` of an outcome on to another sink, for example published events and dead
    letters to their topics. As {outcome: Publisher} every message is sent by itself, and only those that are refused are
    letters, in the folder of the publisher. As {outcome: (format, options)} a micro-batch is sent as a whole; one that
    cannot be sent is in ``sink_path/unsent`` as dead letters. Either way the stream goes on, and a batch that is tried
    again is sent again.
    """
    value = options.get("value", "value")
    decoded = decode_events(stream, value)
    if dedup_window is not None:
        decoded = drop_repeats(decoded, dedup_window, received, salt)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = f"query_id={query_id(spark, checkpoint)}/batch_id={batch_id}"
        target = f"{sink_path}/messages/{place}"
        processed = process_decoded(batch, embedder, **options)
        writer = processed.write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy("outcome").parquet(target)
        # Read back: the model is called once per batch, whatever is counted or sent on.
        written = spark.read.schema(processed.schema).parquet(target)
        counted = run_metrics(written.filter(F.col("outcome") != REJECTED))
        counted.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{sink_path}/metrics/{place}")
        for outcome, sink in (send_to or {}).items():
            chosen = written.filter(F.col("outcome") == outcome).select("key", "value")
            if isinstance(sink, Publisher):
                publish(chosen, sink, f"{query_id(spark, checkpoint)}-{batch_id}-{outcome}")
                continue
            fmt, sink_options = sink
            send(chosen, fmt, sink_options, f"{sink_path}/unsent/{place}/sink={outcome}", first_wait=send_wait)

    writer = decoded.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_outcome(spark: SparkSession, sink_path: str, outcome: str) -> DataFrame:
    """Everything written so far with one outcome, e.g. the published events."""
    return spark.read.parquet(f"{sink_path}/messages").filter(F.col("outcome") == outcome)
