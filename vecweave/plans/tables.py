"""Messages, requests and the like, made from the tables of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.schemas import CHUNK, METADATA

# Documents per event and per request are bounded by the width of an id range, never by how many share a source.
EVENT_RANGE = 100
REQUEST_RANGE = 1000
EVENT_TIME = "2024-01-01T00:00:00+00:00"
_CHUNK_FIELDS = (
    "struct(item.id, item.file_id, item.chunk_type, item.content, item.language, item.start_line, item.end_line, "
    "item.confidence, item.quality_score)"
)


def chunk_events(documents: DataFrame, content: str = "text") -> DataFrame:
    """Documents of one source and id range as the chunks of one event, in order of doc_id."""
    grouped = documents.groupBy("source", F.expr(f"doc_id div {EVENT_RANGE}").alias("bucket")).agg(
        F.expr(
            f"""array_sort(collect_list(named_struct(
                'doc_id', doc_id, 'id', CAST(doc_id AS STRING), 'file_id', source, 'chunk_type', 'document',
                'content', {content}, 'language', nullif(lang, 'fr'), 'start_line', 1L,
                'end_line', CAST(NULL AS BIGINT), 'confidence', 0.5F, 'quality_score', CAST(NULL AS FLOAT))))"""
        ).alias("items")
    )
    return grouped.selectExpr(
        f"""named_struct('event_id', concat_ws('-', source, bucket), 'event_type', 'chunks.raw',
            'timestamp', '{EVENT_TIME}', 'source_service', 'loader',
            'correlation_id', CASE WHEN bucket % 2 = 0 THEN concat('corr-', source) END,
            'trace_id', CAST(NULL AS STRING)) AS headers""",
        f"""CASE WHEN bucket % 3 > 0
            THEN CAST(named_struct('a', bucket % 3, 'b', NULL, 'c', NULL, 'd', NULL) AS {METADATA}) END AS metadata""",
        "source AS source_id",
        "CASE WHEN source RLIKE '[13579]$' THEN concat('repo-', source) END AS repo_name",
        f"CAST(transform(items, item -> {_CHUNK_FIELDS}) AS ARRAY<{CHUNK}>) AS chunks",
        f"'{EVENT_TIME}' AS timestamp",
    )


def event_messages(documents: DataFrame, content: str = "text") -> DataFrame:
    """The same events as JSON messages; absent fields are left out."""
    events = chunk_events(documents, content)
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def damaged_messages(documents: DataFrame) -> DataFrame:
    """One message per document, most of them broken in a way told by doc_id: doc_id, value."""
    kind = "doc_id % 12"

    def damage(number: int, broken: str, sound: str) -> str:
        return f"CASE {kind} WHEN {number} THEN '{broken}' ELSE '{sound}' END"

    parts = [
        "'{\"headers\":{'",
        damage(7, "", '"event_id":"e",'),
        "'\"event_type\":\"t\",\"timestamp\":\"now\",\"source_service\":\"loader\"},'",
        f"""CASE {kind} WHEN 1 THEN '"metadata":null,' WHEN 6 THEN '"metadata":{{"retry_count":1.5}},'
            WHEN 10 THEN '' ELSE '"metadata":{{"retry_count":2}},' END""",
        damage(3, '"source_id":7,', '"source_id":"s",'),
        damage(9, '"source_id":"again",', ""),
        damage(11, '"unknown":{"a":[1,2]},', ""),
        "'\"chunks\":[{\"id\":\"', doc_id, '\",\"file_id\":\"', source",
        "'\",\"chunk_type\":\"document\",\"start_line\":'",
        damage(4, "-1", "1"),
        "','",
        "substring(to_json(named_struct('content', text, 'language', lang)), 2)",
        "'],\"timestamp\":\"now\"'",
        damage(8, "", "}"),
        damage(2, " and more", ""),
    ]
    return documents.selectExpr(
        "doc_id", f"CASE WHEN {kind} <> 5 THEN concat({', '.join(parts)}) END AS value"
    )


def odd_sized_messages(documents: DataFrame) -> DataFrame:
    """Sound messages: without chunks for every seventh document, with a name of 20,000 letters for every eleventh."""
    head = (
        """'{"headers":{"event_id":"e","event_type":"t","timestamp":"now","source_service":"loader"},"source_id":"s",'"""
    )
    chunk = """'"chunks":[{"id":"1","file_id":"f","chunk_type":"document","content":"short"}],"timestamp":"now"}'"""
    empty = f"""CASE WHEN doc_id % 7 = 0 THEN concat({head}, '"chunks":[],"timestamp":"now"}}') END"""
    large = (
        f"""CASE WHEN doc_id % 11 = 0 THEN concat({head}, '"repo_name":"', repeat('r', 20000), '",', {chunk}) END"""
    )
    made = documents.selectExpr("doc_id", f"explode(array({empty}, {large})) AS value")
    return made.filter("value IS NOT NULL")


def request_messages(documents: DataFrame) -> DataFrame:
    """Batch requests, one per source and id range; every other source leaves the batch size out."""
    grouped = documents.groupBy("source", F.expr(f"doc_id div {REQUEST_RANGE}").alias("bucket")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("items")
    )
    return grouped.select(
        F.concat_ws("-", "source", "bucket").alias("request_id"),
        F.to_json(
            F.struct(
                F.col("items.text").alias("texts"),
                F.concat(F.lit("model-"), F.col("source")).alias("model"),
                F.when(F.col("source").rlike("[13579]$"), F.lit(20)).alias("batch_size"),
            )
        ).alias("value"),
    )


def checksum(embedding: str) -> str:
    """A whole number that depends on every component of a vector and its place."""
    millionths = f"transform({embedding}, (x, place) -> CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) * (place + 1))"
    return f"aggregate({millionths}, 0L, (total, x) -> total + x)"


def checksum_all(embeddings: str) -> str:
    """The same for a list of vectors."""
    marks = f"transform({embeddings}, (vector, at) -> {checksum('vector')} * (at + 1))"
    return f"aggregate({marks}, 0L, (total, x) -> total + x)"
