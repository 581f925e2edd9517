"""Publishing message by message: refused ones become letters, their neighbours arrive."""

import json
import uuid
from collections import Counter

import pytest

from vecweave.operators.embedders import HashingEmbedder
from vecweave.plans.tables import event_messages
from vecweave.sources.files import NewFile
from vecweave.sources.messages import read_chunk_events
from vecweave.sources.publish import Publisher, deliver, publish, publish_stream, read_letters
from vecweave.streaming.run import read_outcome, run_stream


class Sink:
    """Keeps what arrives; ``errors`` tells how often a value is refused."""

    def __init__(self, errors=None):
        self.errors, self.arrived, self.tried = dict(errors or {}), [], Counter()

    def __call__(self, key, value):
        self.tried[value] += 1
        if self.errors.get(value, 0) > 0:
            self.errors[value] -= 1
            raise ConnectionError(f"not now: {value}")
        self.arrived.append((key, value))


def run(messages, errors, **options):
    sink, letters, waits = Sink(errors), [], []
    counts = deliver(messages, sink, lambda *letter: letters.append(letter), sleep=waits.append, **options)
    return sink, letters, waits, counts


def test_one_refused_message_costs_its_neighbours_nothing():
    messages = [("k", f"m{i}") for i in range(10)]
    sink, letters, waits, counts = run(messages, {"m4": 99})
    assert counts == (9, 1) and [(k, v) for k, v, _ in letters] == [("k", "m4")]
    assert sink.arrived == [m for m in messages if m[1] != "m4"]
    assert sink.tried["m4"] == 3 and waits == [0.5, 1.0]
    assert all(sink.tried[v] == 1 for _, v in sink.arrived)


def test_what_passes_at_last_is_published_in_the_order_of_its_key():
    messages = [(k, f"{k}{i}") for i in range(4) for k in "abc"] + [(None, "n0"), (None, "n1")]
    sink, letters, _, counts = run(messages, {"a1": 2, "b0": 1, "n0": 1, "c2": 3})
    assert counts == (13, 1) and [v for _, v, _ in letters] == ["c2"]
    for key in "abc":
        want = [m for m in messages if m[0] == key and m[1] != "c2"]
        assert [m for m in sink.arrived if m[0] == key] == want
    # Messages of other keys do not wait.
    assert sink.arrived.index(("c", "c0")) < sink.arrived.index(("a", "a1"))
    assert [v for k, v in sink.arrived if k is None] == ["n1", "n0"]


def test_an_outage_costs_the_waits_of_one_message():
    messages = [(f"k{i}", f"m{i}") for i in range(900)]
    _, letters, waits, counts = run(messages, {v: 99 for _, v in messages})
    assert counts == (0, 900) and len(letters) == 900 and waits == [0.5, 1.0]


def test_errors_that_will_not_pass_are_not_tried_again():
    sink, letters, waits, _ = run([("k", "m")], {"m": 99}, retryable=lambda error: False)
    assert sink.tried["m"] == 1 and waits == [] and len(letters) == 1
    with pytest.raises(ValueError):
        run([], {}, attempts=0)


def test_errors_of_reading_are_raised():
    def broken():
        yield "k", "m0"
        raise OSError("disk")

    with pytest.raises(OSError):
        run(broken(), {})


def sink_to(folder, refuse):
    def open_sink():
        class Lines:
            def __init__(self):
                self.file = NewFile(f"{folder}/{uuid.uuid4()}.json")

            def __call__(self, key, value):
                if refuse in value:
                    raise ValueError("refused")
                self.file.write(json.dumps({"key": key, "value": value}).encode() + b"\n")

            def close(self):
                self.file.close()

        return Lines()

    return open_sink


def test_table_is_published_once(spark, tmp_path):
    rows = [(f"k{i % 5}", f"message {i}") for i in range(200)] + [(None, "message x7"), ("k1", "é 7\n")]
    messages = spark.createDataFrame(rows, "key string, value string").repartition(4)
    publisher = Publisher(sink_to(f"{tmp_path}/out", "7"), f"{tmp_path}/letters", topic="t", first_wait=0.0, now=lambda: 5.0)
    want = Counter(v for _, v in rows if "7" in v)
    for run_name in ("one", "one", "two"):
        assert publish(messages, publisher, run_name) == {"sent": 202 - want.total(), "refused": want.total()}
    letters = read_letters(spark, f"{tmp_path}/letters").collect()
    # The run that was repeated has replaced its letters.
    assert Counter(json.loads(r.value)["event"] for r in letters) == want + want
    assert {(x["failedTopic"], x["failedAt"], x["error"]) for x in (json.loads(r.value) for r in letters)} == {("t", 5000, "refused")}
    sent = spark.read.json(f"{tmp_path}/out")
    assert sent.count() == 3 * (202 - want.total()) and sent.filter("value LIKE '%7%'").count() == 0
    assert read_letters(spark, f"{tmp_path}/none").count() == 0


def test_an_error_of_the_rows_fails_the_job_and_leaves_no_letters(spark, tmp_path):
    messages = spark.range(10).selectExpr("CAST(id AS STRING) AS key", "IF(id = 9, raise_error('bad row'), 'bad') AS value")
    publisher = Publisher(sink_to(f"{tmp_path}/out", "bad"), f"{tmp_path}/letters", first_wait=0.0)
    with pytest.raises(Exception, match="bad row"):
        publish(messages.coalesce(1), publisher)
    assert read_letters(spark, f"{tmp_path}/letters").count() == 0


def test_stream_of_messages_is_published(spark, tmp_path):
    for part in range(3):
        rows = [(f"k{part}", f"message {part}-{i}") for i in range(20)]
        spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    publisher = Publisher(sink_to(f"{tmp_path}/out", "-7"), f"{tmp_path}/letters", first_wait=0.0)
    for _ in range(2):
        publish_stream(stream, publisher, f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == 57
    assert read_letters(spark, f"{tmp_path}/letters").count() == 3
    assert [publisher.counts(f"stream-{n}") for n in range(3)] == [{"sent": 19, "refused": 1}] * 3


def test_events_of_the_flow_are_published_one_by_one(spark, tmp_path):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    event_messages(documents).coalesce(1).write.text(f"{tmp_path}/in")
    stream = read_chunk_events(spark, "text", {"path": f"{tmp_path}/in"}, streaming=True)
    some = event_messages(documents).selectExpr("get_json_object(value, '$.headers.event_id') AS id").first()["id"]
    publisher = Publisher(sink_to(f"{tmp_path}/out", f'"{some}"'), f"{tmp_path}/letters", first_wait=0.0)
    run_stream(stream, HashingEmbedder(8), f"{tmp_path}/sink", f"{tmp_path}/c", send_to={"published": publisher}, now="timestamp_micros(0)").awaitTermination()
    published = {r["value"] for r in read_outcome(spark, f"{tmp_path}/sink", "published").collect()}
    sent = {r["value"] for r in spark.read.json(f"{tmp_path}/out").collect()}
    letters = {json.loads(r["value"])["event"] for r in read_letters(spark, f"{tmp_path}/letters").collect()}
    assert sent | letters == published and not sent & letters
    assert [json.loads(x)["headers"]["event_id"] for x in letters] == [some]
