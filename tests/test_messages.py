"""Encoding, size limit, dead letters, and the whole flow from message to message."""

import hashlib
import json

import pytest
from test_decode import CHUNK, EVENT, REJECTED, event

from vecweave.functions.wire import encode_embedding_event
from vecweave.operators.embedders import CallableEmbedder, HashingEmbedder, ModelCallError, from_function
from vecweave.plans.embedding import process_messages
from vecweave.schemas import EMBEDDED_CHUNK, HEADERS, METADATA
from vecweave.sources.messages import (
    dead_letters,
    kafka_sink,
    kafka_source,
    read_chunk_events,
    split_oversize,
    write_messages,
)

NOW = "timestamp_micros(1500000)"


def messages(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize("repo", [None, "r", '}"\\{}', ""])
def test_nulls_are_left_out_except_the_repo_name(spark, repo):
    row = (("e", "t", "x", "s", None, "tr"), (1, None, None, "te"), 's"}', repo, [("1", "f", "c", None, [0.5, -1e-7], "m", 2)], "m", "now")
    df = spark.createDataFrame(
        [row],
        f"headers {HEADERS}, metadata {METADATA}, source_id string, repo_name string, "
        f"chunks array<{EMBEDDED_CHUNK}>, model string, timestamp string",
    )
    got = json.loads(df.selectExpr(encode_embedding_event()).first()[0])
    assert list(got) == ["headers", "metadata", "source_id", "repo_name", "chunks", "model", "timestamp"]
    assert list(got["headers"]) == ["event_id", "event_type", "timestamp", "source_service", "trace_id"]
    assert got["metadata"] == {"retry_count": 1, "tenant_id": "te"}
    assert (got["source_id"], got["repo_name"]) == ('s"}', repo)
    assert list(got["chunks"][0]) == ["id", "file_id", "chunk_type", "embedding", "model", "dimension"]
    assert got["chunks"][0]["embedding"] == [0.5, pytest.approx(-1e-7)]


def test_every_message_has_one_outcome(spark):
    rejected = [value for value, _ in REJECTED]
    df = messages(spark, event(), event(chunks=[]), *rejected)
    done = process_messages(df, HashingEmbedder(4), NOW).collect()
    assert len(done) == len(rejected) + 2
    by_outcome = {}
    for row in done:
        by_outcome.setdefault(row["outcome"], []).append(row)
    assert {k: len(v) for k, v in by_outcome.items()} == {"published": 1, "empty": 1, "rejected": len(rejected)}
    assert {(r["value"], r["error"]) for r in by_outcome["rejected"]} == set(REJECTED)
    sent = json.loads(by_outcome["published"][0]["value"])
    assert by_outcome["published"][0]["key"] == "s"
    assert sent["headers"] == EVENT["headers"] and sent["metadata"] == {"retry_count": 0}
    assert sent["timestamp"] == "1970-01-01T00:00:01.500000+00:00"
    assert sent["chunks"][0]["dimension"] == 4 and "content" not in sent["chunks"][0]
    assert by_outcome["empty"][0]["value"] is None


def test_all_chunks_failed_means_nothing_to_send(spark):
    def refuse(texts):
        raise ModelCallError(400, "refused")

    embedder = CallableEmbedder("m", 1, call=from_function(refuse), max_parallel=None)
    row = process_messages(messages(spark, event(chunks=[CHUNK, CHUNK])), embedder, NOW).first()
    assert (row["outcome"], row["chunks_in"], row["vectors_out"], len(row["failed"])) == ("empty", 2, 0, 2)


@pytest.mark.parametrize("dimension", [4, 64])
@pytest.mark.parametrize("size", [1, 100_000])
def test_large_messages_become_dead_letters(spark, dimension, size):
    """Whatever the size, a letter holds the same: it points to the message, which is kept."""
    value = event(source_id="s" * size)
    row = process_messages(messages(spark, value), HashingEmbedder(dimension), NOW, topic="out", max_bytes=100).first()
    letter = json.loads(row["value"])
    assert row["outcome"] == "dead_letter" and letter["failedTopic"] == "out" and letter["failedAt"] == 1500
    assert letter["error"] == row["error"] == "message of more than 100 bytes"
    pointer = json.loads(letter["event"])
    assert pointer["message_sha256"] == hashlib.sha256(value.encode()).hexdigest()
    assert pointer["message_bytes"] == len(value.encode()) and len(row["value"]) < 700
    assert row["message"] == value


def test_flow_is_narrow_and_parses_once(spark):
    plan = process_messages(messages(spark, event()), HashingEmbedder(4))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("maxStringLen") == 1 and plan.count("ArrowEvalPython") == 1


def test_size_is_counted_in_bytes(spark):
    df = spark.createDataFrame([("k", "éé"), ("k", "aaaa"), ("k", "ééa")], "key string, value string")
    small, large = split_oversize(df, 4)
    assert small.count() == 2 and [r["value"] for r in large.collect()] == ["ééa"]
    letter = json.loads(dead_letters(large, "it's", "'why'", NOW).first()["value"])
    assert letter == {"failedTopic": "it's", "failedAt": 1500, "error": "why", "event": "ééa"}


def test_files_as_source_and_sink(spark, tmp_path):
    path = str(tmp_path / "messages")
    write_messages(messages(spark, "a", "b"), "text", {"path": path})
    read = read_chunk_events(spark, "text", {"path": path})
    assert sorted(r["value"] for r in read.collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        write_messages(spark.range(3), "parquet", {"path": path + "2"})
        read_chunk_events(spark, "parquet", {"path": path + "2"})


def test_connector_options():
    source = kafka_source("host:1", 5000, failOnDataLoss="false")
    assert source["maxOffsetsPerTrigger"] == "5000"
    assert source["startingOffsets"] == "earliest" and source["subscribe"] == "chunks.raw"
    sink = kafka_sink("host:1", "out")
    assert sink["topic"] == "out" and sink["kafka.max.request.size"] == "10485760"
