"""Dead letters back into the flow."""

import json
from collections import Counter

import pytest

from vecweave.functions.wire import dead_letter, message_pointer
from vecweave.operators.embedders import HashingEmbedder
from vecweave.operators.redrive import LIMIT_REACHED, NOT_KEPT, letter_messages, redrive
from vecweave.plans.embedding import process_messages

EMBEDDER = HashingEmbedder(4)


def message(event_id, size=1, **metadata):
    headers = {"event_id": event_id, "event_type": "t", "timestamp": "x", "source_service": "s"}
    chunk = {"id": "1", "file_id": "f", "chunk_type": "c", "content": "some text"}
    told = {"headers": headers, "source_id": "s", "repo_name": "r" * size, "chunks": [chunk], "timestamp": "t"}
    return json.dumps(told | ({"metadata": metadata} if metadata else {}))


def process(limit):
    return lambda rows: process_messages(rows, EMBEDDER, "timestamp_micros(0)", max_bytes=limit)


def rows(spark, values, error="before"):
    return spark.createDataFrame([(v, error) for v in values], "value string, error string")


def test_every_message_ends_in_one_place_and_the_counter_rises(spark):
    values = [message("small"), message("large", 3000), message("tried", 3000, retry_count=2, original_event_id="o"), message("spent", retry_count=3), "broken", None]
    published, final = redrive(rows(spark, values), process(1000), 3)
    got = {json.loads(r.value)["headers"]["event_id"]: json.loads(r.value)["metadata"] for r in published.collect()}
    assert got == {"small": {"retry_count": 1, "original_event_id": "small"}}
    ended = {(json.loads(r.value)["headers"]["event_id"] if r.value and r.value != "broken" else r.value): r for r in final.collect()}
    assert set(ended) == {"large", "tried", "spent", "broken", None} and final.count() == 5
    assert json.loads(ended["large"].value)["metadata"] == {"retry_count": 3, "original_event_id": "large"}
    assert json.loads(ended["tried"].value)["metadata"] == {"retry_count": 3, "original_event_id": "o"}
    assert ended["large"].error == f"{LIMIT_REACHED}: message of more than 1000 bytes"
    assert ended["spent"].error == f"{LIMIT_REACHED}: before"
    assert ended["broken"].error == "not one JSON value" and ended[None].error == "before"
    # What ended can be redriven with a higher limit, from where its counter is.
    published, final = redrive(final, process(10_000), 4)
    assert published.count() == 3 and {json.loads(r.value)["metadata"]["retry_count"] for r in published.collect()} == {4}
    assert final.count() == 2


def test_rounds_end_when_nothing_is_left(spark):
    calls = []

    def counting(messages):
        calls.append(messages.count())
        return process(1000)(messages)

    published, final = redrive(rows(spark, [message("a"), message("b", 5000)]), counting, 2)
    assert calls == [2, 1] and published.count() == 1 and final.count() == 1
    published, final = redrive(rows(spark, []), counting)
    assert published.count() == final.count() == 0
    with pytest.raises(ValueError):
        redrive(rows(spark, []), counting, -1)


@pytest.mark.parametrize("limit", [None, 0])
def test_letters_find_their_messages(spark, monkeypatch, limit):
    import vecweave.operators.redrive as module

    if limit is not None:
        monkeypatch.setattr(module, "broadcast_if_small", lambda df: df)
    kept = spark.createDataFrame([(m, "s", {"event_id": "e"}) for m in ("one", "one", "two", "three", None)], "message string, source_id string, headers struct<event_id: string>")
    pointing = kept.filter("message IS NOT NULL").selectExpr("'k' AS key", f"{dead_letter('t', chr(39) + 'big' + chr(39), message_pointer('message'))} AS value", "message")
    letters = pointing.filter("message <> 'three'").drop("message")
    lost = spark.createDataFrame([("gone", "s", {"event_id": "e"})], kept.schema).selectExpr("'k' AS key", f"{dead_letter('t', chr(39) + 'big' + chr(39), message_pointer('message'))} AS value")
    whole = spark.createDataFrame([("k", json.dumps({"failedTopic": "t", "failedAt": 1, "error": "refused", "event": '{"a":1}'}))], "key string, value string")
    got = letter_messages(letters.union(lost).union(whole), kept)
    assert Counter(map(tuple, got.collect())) == Counter({("one", "big"): 2, ("two", "big"): 1, (None, NOT_KEPT): 1, ('{"a":1}', "refused"): 1})
