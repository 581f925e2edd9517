"""Chunks, batches, requests, models, metrics, repeats, the vector table."""

import pytest
from pyspark.sql import functions as F

from vecweave.operators.chunks import assemble_events, embed_events, explode_chunks, publishable
from vecweave.operators.dedup import dedup_events, first_by_key
from vecweave.operators.embed import (
    embed_batches,
    embed_rows,
    embedded,
    filled_batches,
    check_positions,
    embed_numbered,
    reorder_by_index,
)
from vecweave.operators.embedders import CallableEmbedder, HashingEmbedder, ModelCallError, from_function
from vecweave.operators.joins import broadcast_if_small, size_in_bytes
from vecweave.operators.metrics import run_metrics
from vecweave.operators.models import models_table, route_models
from vecweave.operators.requests import batch_plan, embed_requests
from vecweave.schemas import CHUNK, HEADERS, METADATA
from vecweave.sources.vectors import append_vectors, latest_vectors, read_vectors


def lengths(texts):
    if any("bad" in text for text in texts):
        raise ModelCallError(400, "refused")
    return [[float(len(text))] for text in texts]


NUMBERS = CallableEmbedder("numbers", 1, call=from_function(lambda texts: [[float(t)] for t in texts]))
LENGTHS = CallableEmbedder("lengths", 7, call=from_function(lengths), max_parallel=None)


def events(spark, *contents):
    """One event per list of texts; event ids repeat."""
    rows = [
        (
            i,
            ("e", "t", "x", "s", None, None),
            (0, None, None, None),
            "src",
            None,
            [(f"{i}.{n}", "f", "c", text, None, None, None, None, None) for n, text in enumerate(texts)],
            "then",
        )
        for i, texts in enumerate(contents)
    ]
    schema = (
        f"at int, headers {HEADERS}, metadata {METADATA}, source_id string, repo_name string, "
        f"chunks array<{CHUNK}>, timestamp string"
    )
    return spark.createDataFrame(rows, schema)


def test_event_failures(spark):
    df = events(spark, ["a", "bad", "ccc"], ["bad"], [])
    done = embed_events(df, LENGTHS, "timestamp_micros(0)")
    first, second, third = sorted(done.collect())
    assert [c["id"] for c in first["chunks"]] == ["0.0", "0.2"]
    assert [c["embedding"] for c in first["chunks"]] == [[1.0], [3.0]]
    assert [c["dimension"] for c in first["chunks"]] == [1, 1]
    assert [tuple(f) for f in first["failed"]] == [("0.1", 1, "model returned 400: refused")]
    assert first["timestamp"] == "1970-01-01T00:00:00.000000+00:00" and first["model"] == "lengths"
    assert (second["chunks"], len(second["failed"]), third["chunks_in"]) == ([], 1, 0)
    assert [r["at"] for r in publishable(done).collect()] == [0]
    counted = run_metrics(done).first().asDict()
    assert counted == {"source_id": "src", "events": 3, "chunks_in": 4, "vectors_out": 2, "chunks_failed": 2}


def test_rows_and_events_agree(spark):
    df = events(spark, ["a b", "c", "d e f"], ["x"] * 40, [])
    embedder = HashingEmbedder(16)
    in_place = publishable(embed_events(df, embedder, "timestamp_micros(0)"))
    rows = embedded(embed_rows(explode_chunks(df).repartition(7), embedder, "content"))
    regrouped = assemble_events(rows, ["at"], embedder.name, "timestamp_micros(0)")
    columns = ["at", "headers", "metadata", "source_id", "repo_name", "chunks", "model", "timestamp"]
    assert sorted(in_place.select(columns).collect()) == sorted(regrouped.select(columns).collect())


def test_events_are_embedded_without_shuffle(spark):
    plan = embed_events(events(spark, ["a"]), HashingEmbedder(16))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("count, sizes", [(0, []), (1, [1]), (32, [32]), (33, [32, 1]), (70, [32, 32, 6])])
def test_batches(spark, count, sizes):
    texts = spark.range(0, count, 1, 3).selectExpr("id", "CAST(id AS STRING) AS text")
    done = embed_numbered(texts, "text", "id", NUMBERS)
    batches = done.orderBy("batch_no").collect()
    assert [len(b["embeddings"]) for b in batches] == sizes
    assert [int(v[0]) for b in batches for v in b["embeddings"]] == list(range(count))
    filled = filled_batches(texts.coalesce(1), "text", row_id="id").collect()
    assert [len(b["texts"]) for b in filled] == sizes
    assert [i for b in filled for i in b["ids"]] == [int(t) for b in filled for t in b["texts"]] == list(range(count))
    requests = spark.createDataFrame([(1, ["t"] * count, None)], "id int, texts array<string>, batch_size int")
    assert [r["texts_in_batch"] for r in batch_plan(requests).orderBy("batch_no").collect()] == sizes


@pytest.mark.parametrize("positions", [[1, 2], [0, 2], [0, 0], [-1, 0], [0, None]])
def test_positions_must_have_no_gaps(spark, positions):
    df = spark.createDataFrame([(p, "x") for p in positions], "id int, text string")
    with pytest.raises(ValueError):
        check_positions(df, "id")


def test_numbered_batches_move_no_text(spark):
    texts = spark.range(0, 100, 1, 3).selectExpr("id", "CAST(id AS STRING) AS text")
    plan = embed_numbered(texts, "text", "id", NUMBERS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("ArrowEvalPython")


def test_several_embedders_are_one_stage(spark):
    three = [CallableEmbedder(name, 1, call=from_function(lambda texts: [[1.0] for _ in texts])) for name in "abc"]
    df = spark.createDataFrame([(1, ["x"], name, None) for name in "abc"], "id int, texts array<string>, model string, batch_size int")
    answers = embed_requests(df, three)
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    assert answers.filter("total_texts = 1").count() == 3


def test_filled_batches_ignore_arrow_batch_size(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        texts = spark.range(0, 50, 1, 1).selectExpr("CAST(id AS STRING) AS text")
        assert [len(b["texts"]) for b in filled_batches(texts, "text").collect()] == [32, 18]
    finally:
        spark.conf.set(name, before)


def test_later_batches_come_after_a_failed_one(spark):
    texts = spark.createDataFrame([(i, "bad" if i == 1 else "x") for i in range(5)], "id long, text string")
    done = embed_numbered(texts, "text", "id", LENGTHS, 2).orderBy("batch_no").collect()
    assert [(r["embeddings"], r["error"]) for r in done] == [
        (None, "model returned 400: refused"),
        ([[1.0], [1.0]], None),
        ([[1.0]], None),
    ]


def test_batch_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        filled_batches(spark.range(1).selectExpr("'a' AS text"), "text", 0)


def test_reorder(spark):
    df = spark.createDataFrame([([(2, [3.0]), (0, [1.0]), (1, [2.0])],)], "data array<struct<index int, embedding array<float>>>")
    assert df.select(F.expr(reorder_by_index("data"))).first()[0] == [[1.0], [2.0], [3.0]]


def requests(spark):
    return spark.createDataFrame(
        [
            (0, ["a", "bb", "ccc"], "lengths", 2),
            (1, ["a", "bad"], "lengths", None),
            (2, [], "hash", 1),
            (3, ["a"], None, None),
            (4, ["a"], "other", None),
            (5, ["a"], "lengths", 0),
        ],
        "id int, texts array<string>, model string, batch_size int",
    )


def test_requests(spark):
    answers = embed_requests(requests(spark), [LENGTHS, HashingEmbedder(8, "hash")])
    got = [r.asDict() for r in answers.orderBy("id").collect()]
    assert got[0]["embeddings"] == [[1.0], [2.0], [3.0]] and got[0]["total_texts"] == 3
    assert got[0]["dimension"] == 7  # the declared one, whatever the vectors are
    assert got[0]["processing_time_ms"] >= 0
    assert (got[1]["embeddings"], got[1]["error"]) == (None, "model returned 400: refused")
    assert (got[2]["embeddings"], got[2]["dimension"], got[2]["total_texts"]) == ([], 8, 0)
    assert (got[3]["model"], got[3]["embeddings"]) == ("lengths", [[1.0]])
    assert (got[4]["model"], got[4]["embeddings"]) == ("other", [[1.0]])
    assert got[5]["error"] == "batch_size must be at least 1"


def test_requests_for_unknown_models_can_be_refused(spark):
    answers = embed_requests(requests(spark), [LENGTHS, HashingEmbedder(8, "hash")], strict=True)
    assert [r["id"] for r in answers.filter("error = 'model not found'").collect()] == [4]


def test_model_routing(spark):
    models = models_table(spark, [LENGTHS, HashingEmbedder(8, "hash")])
    df = spark.createDataFrame([(0, None), (1, "hash"), (2, "other")], "id int, model string")
    models = models.union(models)  # a repeated name multiplies no rows
    got = [tuple(r) for r in route_models(df, models, "lengths").select("id", "model", "known", "dimension").orderBy("id").collect()]
    assert got == [(0, "lengths", True, 7), (1, "hash", True, 8), (2, "other", False, 1024)]
    strict = route_models(df, models, "lengths", strict=True)
    assert [r["id"] for r in strict.filter("error IS NOT NULL").collect()] == [2]


def test_long_model_lists_are_not_broadcast(spark):
    models = spark.range(100).selectExpr("CAST(id AS STRING) AS model")
    size = size_in_bytes(models)
    assert "strategy=broadcast" in broadcast_if_small(models, size)._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in broadcast_if_small(models, size - 1)._jdf.queryExecution().analyzed().toString()


def test_first_by_key_thins_out_before_the_shuffle(spark):
    df = spark.range(0, 1000, 1, 4).selectExpr("IF(id % 3 = 0, 0, id) AS key", "id")
    first = first_by_key(df, ["key"], [F.col("id").desc()])
    assert first.filter("key = 0").first()["id"] == 999
    assert first.count() == 1 + 1000 - 334
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


@pytest.mark.parametrize("order", [["at"], ["part", "at"]])
def test_repeated_events(spark, order):
    # One id holds a third of all events, another is null, most are alone.
    df = spark.range(0, 600, 1, 4).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('e', id) END AS event_id",
        "id AS at",
        "id % 4 AS part",
        "repeat('payload', 10) AS payload",
    )
    few, many = dedup_events(df, order), dedup_events(df, order, max_broadcast_bytes=0)
    assert sorted(few.collect(), key=str) == sorted(many.collect(), key=str)
    assert few.filter("event_id = 'hot'").count() == 1 and few.filter("event_id IS NULL").count() == 1
    assert few.filter("event_id = 'hot'").first()["at"] == 0
    assert few.count() == 2 + df.filter("event_id LIKE 'e%'").count()
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_repeated_events_with_ties_and_nulls(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("b", 2, "x"), ("b", None, "y"), ("c", 1, "z"), ("c", 1, "z"), ("d", 5, "w")]
    df = spark.createDataFrame(rows, "event_id string, at int, payload string")
    few, many = dedup_events(df, ["at"]), dedup_events(df, ["at"], max_broadcast_bytes=0)
    assert sorted(few.collect(), key=str) == sorted(many.collect(), key=str)
    got = {r["event_id"]: (r["at"], r["payload"]) for r in few.collect()}
    assert few.count() == 4 and got["b"] == (None, "y") and got["c"] == (1, "z")


def test_vector_table(spark, tmp_path):
    path = str(tmp_path / "vectors")
    schema = "id int, model string, embedding array<float>, version long"
    append_vectors(spark.createDataFrame([(1, "a", [1.0], 1), (2, "a", [2.0], 1), (1, "b", [3.0], 1)], schema), path)
    append_vectors(spark.createDataFrame([(1, "a", [9.0], 2)], schema), path)
    append_vectors(spark.createDataFrame([(1, "a", [9.0], 2)], schema), path)  # a task tried twice
    got = {(r["model"], r["id"]): r["embedding"] for r in read_vectors(spark, path).collect()}
    assert got == {("a", 1): [9.0], ("a", 2): [2.0], ("b", 1): [3.0]}
    only = read_vectors(spark, path, "b")
    assert [r["id"] for r in only.collect()] == [1]
    assert "PartitionFilters: [isnotnull(model" in only._jdf.queryExecution().executedPlan().toString()
    assert latest_vectors(spark.read.parquet(path)).count() == 3
