"""Column types of the messages, as DDL."""

HEADERS = (
    "struct<event_id: string, event_type: string, timestamp: string, source_service: string, "
    "correlation_id: string, trace_id: string>"
)
METADATA = (
    "struct<retry_count: bigint, original_event_id: string, user_id: string, tenant_id: string>"
)
CHUNK = (
    "struct<id: string, file_id: string, chunk_type: string, content: string, language: string, "
    "start_line: bigint, end_line: bigint, confidence: float, quality_score: float>"
)
EMBEDDED_CHUNK = (
    "struct<id: string, file_id: string, chunk_type: string, language: string, "
    "embedding: array<float>, model: string, dimension: bigint>"
)
EMBEDDING_EVENT = (
    f"struct<headers: {HEADERS}, metadata: {METADATA}, source_id: string, repo_name: string, "
    f"chunks: array<{EMBEDDED_CHUNK}>, model: string, timestamp: string>"
)
# What an embedder says about one text: a vector, or the reason there is none; and its share of the time taken.
OUTCOME = "struct<embedding: array<float>, error: string, millis: double>"
FAILED_CHUNK = "struct<id: string, pos: int, error: string>"
