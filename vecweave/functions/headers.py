"""Event headers."""

from __future__ import annotations

from vecweave.functions.text import rfc3339


def key_uuid(key: str) -> str:
    """UUID text (version 8, custom) made from ``key``, so a re-run gives the same id."""
    digest = f"sha2({key}, 256)"
    return (
        f"concat(substring({digest}, 1, 8), '-', substring({digest}, 9, 4), '-8', substring({digest}, 14, 3), "
        f"'-8', substring({digest}, 18, 3), '-', substring({digest}, 21, 12))"
    )


def make_headers(
    key: str,
    event_type: str,
    source_service: str,
    now: str = "current_timestamp()",
    correlation_id: str = "CAST(NULL AS STRING)",
    trace_id: str = "CAST(NULL AS STRING)",
) -> str:
    """Headers of a new event; the id follows from ``key``."""
    return (
        f"named_struct('event_id', {key_uuid(key)}, 'event_type', {event_type}, 'timestamp', {rfc3339(now)}, "
        f"'source_service', {source_service}, 'correlation_id', {correlation_id}, 'trace_id', {trace_id})"
    )


def correlation_id(headers: str = "headers") -> str:
    """The id that ties log lines and events together: the given one, or the event's own."""
    return f"coalesce({headers}.correlation_id, {headers}.event_id)"
