"""Operators that remember: batches over micro-batches and restarts, and a record of repeats."""

from collections import Counter

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import vecweave.plans.catalog as catalog
from vecweave.plans.oracles import ORACLES
from vecweave.streaming.state import filled_across, mark_repeats, rocksdb_state

START = 1_704_067_200


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("received", F.timestamp_seconds(F.col("at") + START)).drop("at").coalesce(1).write.mode("append").parquet(path)


def run(spark, stream, target):
    with rocksdb_state(spark):
        query = (
            stream.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/c")
            .trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/out").collect()


def test_batches_fill_over_micro_batches_and_restarts(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "id bigint, text string, at bigint"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def batches():
        stream = spark.readStream.schema("id bigint, text string, received timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        return run(spark, filled_across(stream, "text", "id", "received", batch_size=10, wait="100 seconds", shards=2), tmp_path)

    # Seven rows at a time: no micro-batch fills a batch of a shard by itself.
    for part in range(9):
        add(spark, source, [(part * 7 + i, None if i == 3 else f"text {part * 7 + i}", part) for i in range(7)], schema)
        if part == 4:
            halfway = batches()  # a restart lies between
            assert all(r.reason == "full" and len(r.ids) == 10 for r in halfway)
    whole = batches()
    assert {r.reason for r in whole} == {"full"} and len(whole) > len(halfway)
    # Time goes on without rows: what waits is due, one short batch a shard.
    add(spark, source, [(None, None, 99)], schema)
    assert len(batches()) == len(whole)
    add(spark, source, [(None, None, 1000)], schema)
    last = batches()
    short = [r for r in last if len(r.ids) < 10]
    assert Counter(r.shard for r in short) == {0: 1, 1: 1} and {r.reason for r in short} == {"due"}
    texts = {i: t for r in last for i, t in zip(r.ids, r.texts)}
    assert sum(len(r.ids) for r in last) == 63 and texts == {i: None if i % 7 == 3 else f"text {i}" for i in range(63)}
    # The next texts wait anew.
    add(spark, source, [(100, "x", 1001)], schema)
    assert len(batches()) == len(last)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_repeats_are_recorded_and_forgotten(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "event string, place string, at bigint"
    rows = [("a", "0", 0), ("b", "1", 1), ("a", "2", 2), ("a", "3", 2), (None, "4", 3), (None, "5", 3)]

    def marked():
        stream = spark.readStream.schema("event string, place string, received timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        found = run(spark, mark_repeats(stream, "event", "place", "received", "60 seconds"), tmp_path)
        return {r.place: (r.event_id, r.repeat_no, r.first_place) for r in found}

    add(spark, source, rows, schema)
    want = {"0": ("a", 0, "0"), "1": ("b", 0, "1"), "2": ("a", 1, "0"), "3": ("a", 2, "0"), "4": (None, 0, "4"), "5": (None, 1, "4")}
    assert marked() == want
    add(spark, source, [("a", "6", 50), ("c", "7", 50)], schema)
    want |= {"6": ("a", 3, "0"), "7": ("c", 0, "7")}
    assert marked() == want
    # A minute after it was first the event is forgotten.
    add(spark, source, [("c", "8", 100)], schema)
    assert marked() == want | {"8": ("c", 1, "7")}
    add(spark, source, [("a", "9", 101), ("b", "10", 101)], schema)
    assert marked() == want | {"8": ("c", 1, "7"), "9": ("a", 0, "9"), "10": ("b", 0, "10")}


def test_repeats_cost_calls_by_bucket_not_by_event(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "event string, place string, at bigint"
    add(spark, source, [(f"e{i % 500}", str(i), i) for i in range(1500)], schema)
    stream = spark.readStream.schema("event string, place string, received timestamp").parquet(source)
    found = run(spark, mark_repeats(stream, "event", "place", "received", "1 day", buckets=2), tmp_path)
    assert Counter((r.event_id, r.repeat_no) for r in found) == Counter((f"e{i % 500}", i // 500) for i in range(1500))
    assert {(r.event_id, r.first_place) for r in found} == {(f"e{i}", str(i)) for i in range(500)}


@pytest.mark.parametrize("name", ["stream_filled_across", "stream_restarted", "event_repeats"])
def test_a_table_that_many_tasks_read_makes_many_files(spark, monkeypatch, name):
    folder, write, made = "/root/testdata/sf0.001", catalog._write_files, []
    monkeypatch.setattr(catalog, "_write_files", lambda rows, path, files: made.append(files) or write(rows, path, files))
    for setting, value in (("maxPartitionBytes", "64k"), ("openCostInBytes", "0")):
        spark.conf.set(f"spark.sql.files.{setting}", value)
    try:
        tasks = catalog._documents(spark, folder).rdd.getNumPartitions()
        got = catalog.QUERIES[name](spark, folder).toPandas()
    finally:
        for setting in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{setting}")
    assert tasks > 2 and max(made) >= tasks
    assert differences(got, connect(folder).execute(ORACLES[name]).fetchdf()) is None
