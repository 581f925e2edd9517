"""Streams give what tables give, also after a restart."""

import json

from pyspark.sql import functions as F

from vecweave.operators.embed import embed_batches, embed_rows, filled_batches
from vecweave.operators.embedders import HashingEmbedder
from vecweave.plans.embedding import process_messages
from vecweave.plans.tables import event_messages
from vecweave.sources.messages import read_chunk_events
from vecweave.operators.decode import decode_events
from vecweave.streaming.run import drop_repeats, query_id, read_outcome, run_stream

NOW = "timestamp_micros(0)"
EMBEDDER = HashingEmbedder(16)


def write(df, path):
    df.coalesce(1).write.mode("append").text(path)


def stream(spark, path):
    return read_chunk_events(spark, "text", {"path": path, "maxFilesPerTrigger": "1"}, streaming=True)


def published(df):
    return sorted(r["value"] for r in df.collect())


def test_stream_equals_table_and_restart_adds_nothing(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("source", "sink", "checkpoint"))
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    messages = event_messages(documents).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(3)))
    bad = spark.createDataFrame([("not json",)], "value string")
    for part in range(2):
        write(messages.filter(F.col("part") == part).select("value"), source)
    write(bad, source)

    def run():
        run_stream(stream(spark, source), EMBEDDER, sink, checkpoint, now=NOW).awaitTermination()

    run()
    first = published(read_outcome(spark, sink, "published"))
    run()
    assert published(read_outcome(spark, sink, "published")) == first
    write(messages.filter("part = 2").select("value"), source)
    run()
    whole = process_messages(event_messages(documents), EMBEDDER, NOW)
    assert published(read_outcome(spark, sink, "published")) == published(whole.filter("outcome = 'published'"))
    assert [r["error"] for r in read_outcome(spark, sink, "rejected").collect()] == ["not one JSON value"]
    counted = spark.read.parquet(f"{sink}/metrics").agg(F.sum("vectors_out"), F.sum("chunks_failed")).first()
    assert tuple(counted) == (documents.count(), 0)


def test_failed_batch_is_done_again_over_its_own_folder(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("source", "sink", "checkpoint"))
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    write(event_messages(documents), source)
    # Half a batch is left over from a run that was lost before its commit.
    left = process_messages(event_messages(documents), EMBEDDER, NOW).limit(2)
    run_stream(stream(spark, source), EMBEDDER, sink, checkpoint, now=NOW).awaitTermination()
    folder = f"{sink}/messages/query_id={query_id(spark, checkpoint)}/batch_id=0"
    left.write.mode("append").partitionBy("outcome").parquet(folder)
    # Its commit is lost, too.
    (tmp_path / "checkpoint" / "commits" / "0").unlink()
    (tmp_path / "checkpoint" / "commits" / ".0.crc").unlink()
    run_stream(stream(spark, source), EMBEDDER, sink, checkpoint, now=NOW).awaitTermination()
    whole = process_messages(event_messages(documents), EMBEDDER, NOW)
    assert published(read_outcome(spark, sink, "published")) == published(whole)


def test_outcomes_are_sent_on(spark, tmp_path):
    source, sink, checkpoint, out, dead = (str(tmp_path / n) for n in ("source", "sink", "checkpoint", "out", "dead"))
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    write(event_messages(documents), source)
    sizes = process_messages(event_messages(documents), EMBEDDER, NOW).selectExpr("octet_length(value) AS n")
    limit = int(sizes.approxQuantile("n", [0.5], 0.0)[0])
    run_stream(
        stream(spark, source),
        EMBEDDER,
        sink,
        checkpoint,
        send_to={"published": ("json", {"path": out}), "dead_letter": ("json", {"path": dead})},
        now=NOW,
        max_bytes=limit,
    ).awaitTermination()
    sent, letters = spark.read.json(out), spark.read.json(dead)
    assert sent.count() > 0 and letters.count() > 0
    assert sent.count() + letters.count() == sizes.count()
    assert published(sent) == published(read_outcome(spark, sink, "published"))
    assert sent.filter(F.octet_length("value") > limit).count() == 0
    assert letters.filter("get_json_object(value, '$.failedTopic') = 'embedding.generated'").count() == letters.count()


def test_repeated_events_pass_once(spark, tmp_path):
    """Only valid events are suppressed; a rejected message leaves the way free for its correction."""
    values = [event(e) for e in ["a", "b", "a", "a", "c", "b"]] + [None, None, "broken", "broken", event("d", source_id=3), event("d")]
    rows = [(n, f"2024-01-01 00:00:{n:02d}", value) for n, value in enumerate(values)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "n long, at string, value string").selectExpr(
        "n", "CAST(at AS TIMESTAMP) AS received", "value"
    ).write.parquet(path)
    for salt in (None, "n"):
        name = f"repeats_{salt}"
        source = spark.readStream.schema("n long, received timestamp, value string").parquet(path)
        query = (
            drop_repeats(decode_events(source), "1 hour", "received", salt)
            .select("reject_reason", "headers.event_id")
            .writeStream.format("memory")
            .queryName(name)
            .option("checkpointLocation", str(tmp_path / name))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        got = [tuple(r) for r in spark.table(name).collect()]
        assert sorted(e for reason, e in got if reason is None) == ["a", "b", "c", "d"]
        assert sorted(reason for reason, _ in got if reason) == [
            "bad source_id", "empty payload", "empty payload", "not one JSON value", "not one JSON value"
        ]


def event(event_id, **changes):
    headers = {"event_id": event_id, "event_type": "t", "timestamp": "x", "source_service": "s"}
    chunk = {"id": "1", "file_id": "f", "chunk_type": "c", "content": "some text"}
    return json.dumps({"headers": headers, "source_id": "s", "chunks": [chunk], "timestamp": "t", **changes})


def test_corrected_message_is_published(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("2024-01-01 00:00:00", event("a", source_id=3)), ("2024-01-01 00:00:01", event("a"))]
    spark.createDataFrame(rows, "at string, value string").selectExpr("CAST(at AS TIMESTAMP) AS received", "value").write.parquet(path)
    source = spark.readStream.schema("received timestamp, value string").parquet(path)
    sink = str(tmp_path / "sink")
    run_stream(source, EMBEDDER, sink, str(tmp_path / "c"), dedup_window="1 hour", now=NOW).awaitTermination()
    found = {(r["outcome"], r["event_id"]) for r in spark.read.parquet(f"{sink}/messages").collect()}
    assert found == {("rejected", None), ("published", "a")}


def test_another_checkpoint_overwrites_nothing(spark, tmp_path):
    sink = str(tmp_path / "sink")
    for name, ids in (("one", "abcde"), ("two", "xyz")):
        source = str(tmp_path / name)
        write(spark.createDataFrame([(event(e),) for e in ids], "value string"), source)
        run_stream(stream(spark, source), EMBEDDER, sink, str(tmp_path / f"c-{name}"), now=NOW).awaitTermination()
    ids = {r["event_id"] for r in read_outcome(spark, sink, "published").collect()}
    assert ids == set("abcdexyz")


def test_stream_goes_on_if_nothing_can_be_sent(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    for e in "ab":
        write(spark.createDataFrame([(event(e),)], "value string"), source)
    where = {"published": ("no-such-format", {})}
    run_stream(
        stream(spark, source), EMBEDDER, sink, str(tmp_path / "c"), send_to=where, send_wait=0.0, now=NOW
    ).awaitTermination()
    assert read_outcome(spark, sink, "published").count() == 2
    letters = [json.loads(r["value"]) for r in spark.read.parquet(f"{sink}/unsent").collect()]
    assert sorted(json.loads(x["event"])["headers"]["event_id"] for x in letters) == ["a", "b"]
    assert all("no-such-format" in x["error"] for x in letters), letters


def test_unbounded_texts(spark, tmp_path):
    source = str(tmp_path / "texts")
    texts = [f"text {i}" for i in range(70)]
    for start in (0, 40):
        write(spark.createDataFrame([(t,) for t in texts[start : start + 40 if start == 0 else 70]], "value string"), source)
    batches = embed_batches(filled_batches(stream(spark, source), "value"), EMBEDDER)
    query = (
        batches.writeStream.format("memory")
        .queryName("unbounded")
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = [tuple(v) for r in spark.table("unbounded").collect() for v in r["embeddings"]]
    want = embed_rows(spark.createDataFrame([(t,) for t in texts], "text string"), EMBEDDER)
    assert sorted(got) == sorted(tuple(r["embedding"]) for r in want.collect())
    assert sorted(len(r["embeddings"]) for r in spark.table("unbounded").collect()) == [8, 30, 32]
