"""Dead letters back into the flow.

A letter holds its event, or digests that point to the message it was made of, which is kept. Its message is found again,
says in ``metadata`` that it is tried once more and which event it was at first, and goes through the flow anew. What is
published leaves the loop; what is a letter again goes round until its message has been tried often enough.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.operators.decode import decode_events
from vecweave.operators.joins import broadcast_if_small
from vecweave.plans.embedding import REJECTED
from vecweave.sources.storage import materialize

MAX_RETRIES = 3
LIMIT_REACHED = "no further attempt"
NOT_KEPT = "message not kept"


def letter_events(letters: DataFrame, value: str = "value") -> DataFrame:
    """(error, event, message_sha256, message_bytes) of letters: ``event`` is the text in the letter, and null if the letter
    points to a kept message by the other two."""
    said = letters.select(F.from_json(value, "error string, event string").alias("letter")).select("letter.*")
    pointer = said.withColumn("to", F.from_json("event", "message_sha256 string, message_bytes bigint"))
    points = F.col("to.message_sha256").isNotNull()
    return pointer.select(
        "error",
        F.when(~F.coalesce(points, F.lit(False)), F.col("event")).alias("event"),
        F.col("to.message_sha256").alias("message_sha256"),
        F.col("to.message_bytes").alias("message_bytes"),
    )


def letter_messages(letters: DataFrame, kept: DataFrame, message: str = "message", value: str = "value") -> DataFrame:
    """(value, error) of every letter: the message it stands for, or none and an error if that is not among ``kept``.

    Of equal kept messages one is enough. Only the digests of kept messages meet the letters, whose own are sent to every
    task if they are few in bytes; only messages that a letter asks for are moved.
    """
    events = materialize(letter_events(letters, value))
    pointers = events.filter("message_sha256 IS NOT NULL")
    key = ["message_sha256", "message_bytes"]
    asked = broadcast_if_small(materialize(pointers.select(*key).distinct()))
    known = kept.filter(F.col(message).isNotNull()).select(
        F.sha2(F.col(message).cast("binary"), 256).alias("message_sha256"),
        F.octet_length(message).cast("bigint").alias("message_bytes"),
        F.col(message).cast("string").alias("message"),
    )
    wanted = materialize(known.join(asked, key, "left_semi").groupBy(*key).agg(F.first("message").alias("message")))
    found = pointers.join(wanted, key, "left").select(
        F.col("message").alias("value"), F.when(F.col("message").isNull(), F.lit(NOT_KEPT)).otherwise(F.col("error")).alias("error")
    )
    return found.union(events.filter("message_sha256 IS NULL").select(F.col("event").alias("value"), "error"))


def raised(decoded: DataFrame) -> DataFrame:
    """Decoded events as messages that are tried once more: ``retry_count`` is one higher, and ``original_event_id`` is that
    of the first attempt. Fields that the format does not know are left out."""
    metadata = (
        "named_struct('retry_count', metadata.retry_count + 1, 'original_event_id', "
        "coalesce(metadata.original_event_id, headers.event_id), 'user_id', metadata.user_id, 'tenant_id', metadata.tenant_id)"
    )
    fields = ["headers", f"{metadata} AS metadata", "source_id", "repo_name", "chunks", "timestamp"]
    return decoded.selectExpr(f"to_json(struct({', '.join(fields)})) AS value")


def redrive(messages: DataFrame, process: Callable[[DataFrame], DataFrame], max_retries: int = MAX_RETRIES) -> tuple[DataFrame, DataFrame]:
    """Messages (value, error) through ``process`` until they are published or were tried ``max_retries`` times.

    ``process`` takes messages (``value``) and gives outcomes, as ``process_messages`` does. Returns what was published or
    needs no publishing, as outcomes, and the final rows (value, error): messages that cannot be decoded or were not kept,
    and those with no attempt left, each with its last error. Every message is in one of the two. As the count is in the
    message, it goes on in later calls; a round is written before the next, so a lost executor costs one at most.
    """
    if max_retries < 0:
        raise ValueError("max_retries must not be negative")
    done, final = [], []
    pending = messages.select(F.col("value").cast("string").alias("value"), "error")
    while True:
        decoded = materialize(decode_events(pending))
        valid = F.col("reject_reason").isNull()
        spent = valid & (F.col("metadata.retry_count") >= max_retries)
        reason = F.when(F.col("value").isNull(), F.coalesce("error", F.lit(NOT_KEPT))).otherwise(F.col("reject_reason"))
        final.append(decoded.filter(~valid).select("value", reason.alias("error")))
        final.append(decoded.filter(spent).select("value", F.concat_ws(": ", F.lit(LIMIT_REACHED), "error").alias("error")))
        again = decoded.filter(valid & ~spent)
        if again.isEmpty():
            break
        outcomes = materialize(process(raised(again)))
        letters = outcomes.filter(F.col("message").isNotNull() & (F.col("outcome") != REJECTED))
        done.append(outcomes.filter(F.col("message").isNull()))
        final.append(outcomes.filter(F.col("outcome") == REJECTED).select(F.col("message").alias("value"), "error"))
        pending = letters.select(F.col("message").alias("value"), "error")
    if not done:
        nothing = process(messages.select("value").limit(0))
        done.append(nothing)
    return reduce(DataFrame.union, done), reduce(DataFrame.union, final)
