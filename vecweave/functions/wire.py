"""JSON text of outgoing events."""

from __future__ import annotations

from vecweave.functions.text import quoted


def encode_embedding_event(event: str = "") -> str:
    """JSON of an event held in columns (or in the struct ``event``). Absent optional fields are left out, except
    ``repo_name``, which is written as null: it is rendered by itself, and the parts are joined without their outer
    braces."""
    at = f"{event}." if event else ""

    def part(*names: str) -> str:
        return "named_struct(" + ", ".join(f"'{name}', {at}{name}" for name in names) + ")"

    head = f"to_json({part('headers', 'metadata', 'source_id')})"
    repo = f"to_json({part('repo_name')}, map('ignoreNullFields', 'false'))"
    tail = f"to_json({part('chunks', 'model', 'timestamp')})"
    return (
        f"concat(substring({head}, 1, length({head}) - 1), ',', "
        f"substring({repo}, 2, length({repo}) - 2), ',', substring({tail}, 2))"
    )


def message_pointer(message: str) -> str:
    """What a dead letter says of an event that is too large to be sent: where it came from and the digest and size of
    the message it was made of, which is kept. Always a few hundred bytes."""
    return (
        f"to_json(named_struct('source_id_sha256', sha2(source_id, 256), 'event_id_sha256', sha2(headers.event_id, 256), "
        f"'message_sha256', sha2(CAST({message} AS BINARY), 256), 'message_bytes', octet_length({message})))"
    )


def dead_letter(topic: str, error: str, event: str, failed_at: str = "current_timestamp()") -> str:
    """Envelope of a message that could not be sent; all but ``topic`` are SQL expressions."""
    return (
        f"to_json(named_struct('failedTopic', {quoted(topic)}, 'failedAt', unix_millis({failed_at}), "
        f"'error', {error}, 'event', {event}), map('ignoreNullFields', 'false'))"
    )
