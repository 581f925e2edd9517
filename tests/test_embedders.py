"""Model calls: retry, order, failure scope. Fakes count on the driver; the same code runs in tasks."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecweave.operators.embed import embed_rows, embedded, failures
from vecweave.operators.embedders import (
    CallableEmbedder,
    HashingEmbedder,
    ModelCallError,
    call_with_retry,
    from_function,
    in_windows,
    is_retryable,
    vectors_in_order,
)


class Flaky:
    def __init__(self, *errors):
        self.errors, self.calls, self.waits = list(errors), 0, []

    def __call__(self):
        self.calls += 1
        if self.errors:
            raise self.errors.pop(0)
        return "ok"

    def run(self, attempts=3):
        return call_with_retry(self, attempts, 1.5, self.waits.append)


def test_works_after_one_failure():
    flaky = Flaky(ModelCallError(503))
    assert flaky.run() == "ok" and flaky.waits == [1.5]


def test_gives_up_after_three_attempts():
    flaky = Flaky(*[ModelCallError(503)] * 5)
    with pytest.raises(ModelCallError):
        flaky.run()
    assert flaky.calls == 3 and flaky.waits == [1.5, 3.0]


@pytest.mark.parametrize("error", [ModelCallError(400), ValueError("bad body"), KeyError("data")])
def test_no_second_attempt(error):
    flaky = Flaky(error)
    with pytest.raises(type(error)):
        flaky.run()
    assert flaky.calls == 1 and flaky.waits == []


def test_what_may_pass():
    assert all(map(is_retryable, [ModelCallError(429), ModelCallError(500), ConnectionError(), TimeoutError()]))
    assert not any(map(is_retryable, [ModelCallError(404), ValueError(), FileNotFoundError(), OSError()]))


def test_order_and_length_of_answers():
    data = [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]
    assert [vector.tolist() for vector in vectors_in_order({"data": data}, 2)] == [[1.0], [2.0]]
    with pytest.raises(ValueError, match="2 vectors for 3 texts"):
        vectors_in_order({"data": data}, 3)


def lengths(texts):
    return [[float(len(text)), 1.0] for text in texts]


def local(call, **options):
    return CallableEmbedder("m", 2, call=call, max_parallel=None, sleep=lambda _: None, **options)


def table(spark, texts, partitions=2):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(partitions)


def test_request_and_shuffled_answer(spark):
    def call(request):
        assert set(request) == {"model", "input", "input_type"}
        assert request["model"] == "m" and request["input_type"] == "query"
        items = [{"index": i, "embedding": v} for i, v in enumerate(lengths(request["input"]))]
        return {"data": items[::-1]}

    rows = embedded(embed_rows(table(spark, ["a", "bb", "", "dddd"]), local(call))).orderBy("id").collect()
    assert [row["embedding"][0] for row in rows] == [1, 2, 0, 4]
    assert {(row["model"], row["dimension"]) for row in rows} == {("m", 2)}


def refuse(word, status=400):
    def function(texts):
        if any(word in text for text in texts):
            raise ModelCallError(status, "refused")
        return lengths(texts)

    return from_function(function)


def test_one_bad_text_costs_only_itself(spark):
    texts = ["good"] * 40 + ["bad"] + ["good"] * 9
    rows = embed_rows(table(spark, texts, 1), local(refuse("bad")))
    assert embedded(rows).count() == 49
    assert [(r["id"], r["error"]) for r in failures(rows).collect()] == [(40, "model returned 400: refused")]


def test_batch_scope(spark):
    texts = ["good"] * 5 + ["bad"] + ["good"] * 6
    rows = embed_rows(table(spark, texts, 1), local(refuse("bad")), batch_size=4, on_error="batch")
    assert failures(rows).count() == 4 and embedded(rows).count() == 8


def test_fail_scope_stops_the_job(spark):
    rows = embed_rows(table(spark, ["bad"]), local(refuse("bad")), on_error="fail")
    with pytest.raises(Exception, match="refused"):
        rows.collect()


@pytest.mark.parametrize("kind", [np.float32, np.float64, list])
def test_kinds_of_vectors(spark, kind):
    def function(texts):
        return [v if kind is list else np.array(v, dtype=kind) for v in lengths(texts)]

    rows = embedded(embed_rows(table(spark, ["a", "bb"], 1), local(from_function(function))))
    assert sorted(r["embedding"] for r in rows.collect()) == [[1.0, 1.0], [2.0, 1.0]]


@pytest.mark.parametrize("bad", [None, "text", [[1.0]], 3.0])
def test_what_is_not_a_vector_is_an_error(spark, bad):
    call = from_function(lambda texts: [bad if text == "x" else [1.0] for text in texts])
    rows = embed_rows(table(spark, ["a", "x", "b"], 1), local(call))
    assert [r["id"] for r in failures(rows).collect()] == [1] and embedded(rows).count() == 2


def test_short_answer_is_an_error(spark):
    call = from_function(lambda texts: lengths(texts)[1:])
    rows = embed_rows(table(spark, ["a", "b"], 1), local(call), on_error="batch")
    assert {r["error"] for r in failures(rows).collect()} == {"model returned 1 vectors for 2 texts"}


def test_null_text_is_a_failure_and_empty_text_is_not(spark):
    for embedder in (HashingEmbedder(8), local(from_function(lengths))):
        rows = embed_rows(table(spark, [None, "", "x"]), embedder)
        assert [r["id"] for r in failures(rows).collect()] == [0]
        assert sorted(r["id"] for r in embedded(rows).collect()) == [1, 2]
    empty = embedded(embed_rows(table(spark, [""]), HashingEmbedder(8))).first()
    assert empty["embedding"] == [0.0] * 8 and empty["dimension"] == 8


def test_no_rows(spark):
    for embedder in (HashingEmbedder(8), local(from_function(lengths))):
        assert embed_rows(table(spark, ["x"]).filter("id > 5"), embedder).collect() == []


def test_model_is_opened_in_the_task(spark):
    def open_model():
        weight = 3.0
        return from_function(lambda texts: [[weight * len(text)] for text in texts])

    embedder = CallableEmbedder("m", 1, open_model=open_model)
    assert embedded(embed_rows(table(spark, ["ab"]), embedder)).first()["embedding"] == [6.0]


def test_vectors_do_not_depend_on_partitions_or_batch_size(spark):
    texts = [f"word{i} and word{i % 7}" for i in range(100)]
    seen = set()
    for partitions, size in ((1, 32), (5, 3), (8, 100)):
        for embedder in (HashingEmbedder(16), local(from_function(lengths))):
            rows = embed_rows(table(spark, texts, partitions), embedder, batch_size=size)
            seen.add((embedder.name, str(sorted((r["id"], r["embedding"]) for r in rows.collect()))))
    assert len(seen) == 2


@pytest.mark.parametrize("partitions", [3, 50])
def test_partitions_follow_the_data(spark, partitions):
    embedder = CallableEmbedder("m", 2, call=from_function(lengths))
    texts = spark.range(0, 100, 1, partitions).select(F.col("id").cast("string").alias("text"))
    assert embed_rows(texts, embedder).rdd.getNumPartitions() == partitions


class Gauge:
    """A model that notes how many of its calls are open, and how long the work as a whole takes."""

    def __init__(self, seconds=0.02):
        self.seconds, self.lock, self.open, self.most = seconds, threading.Lock(), 0, 0

    def __call__(self, texts):
        with self.lock:
            self.open += 1
            self.most = max(self.most, self.open)
        # The first ones take longest.
        time.sleep(self.seconds * (3 if texts[0].endswith("0") else 1))
        with self.lock:
            self.open -= 1
        return [[float(len(text)), float(self.most)] for text in texts]


@pytest.mark.parametrize(("in_flight", "limit", "window"), [(1, 16, 1), (2, None, 2), (5, 16, 5), (8, 3, 3)])
def test_calls_in_flight_are_capped(in_flight, limit, window):
    gauge = Gauge()
    embedder = CallableEmbedder("m", 2, call=from_function(gauge), in_flight=in_flight, max_parallel=limit)
    texts = [f"{'x' * i}{i % 4}" for i in range(24)]
    work = ((n, 6, embedder._calls(embedder.call, texts[n : n + 6], 2, "row")) for n in range(0, 24, 6))
    got = list(in_windows(work, embedder.window))
    assert [n for n, _ in got] == [0, 6, 12, 18]
    assert [vector[0] for _, found in got for vector, _, _ in found] == [len(text) for text in texts]
    assert gauge.most == window == embedder.window


def test_calls_in_flight_take_less_time():
    def seconds(in_flight):
        embedder = CallableEmbedder("m", 2, call=from_function(Gauge(0.05)), in_flight=in_flight)
        started = time.perf_counter()
        list(in_windows([(0, 16, embedder._calls(embedder.call, ["x"] * 16, 1, "row"))], embedder.window))
        return time.perf_counter() - started

    assert seconds(4) < 0.5 * seconds(1)


def test_errors_of_calls_in_flight_are_in_place():
    def picky(texts):
        time.sleep(0.01 * len(texts[0]))
        if "bad" in texts:
            raise ModelCallError(400, "refused")
        return [[float(len(text))] for text in texts]

    embedder = CallableEmbedder("m", 1, call=from_function(picky), in_flight=4)
    texts = ["aaaa", "b", None, "bad", "cc", "", "bad", "d"]
    ((_, found),) = in_windows([(0, 8, embedder._calls(embedder.call, texts, 2, "batch"))], 4)
    # Calls are of (aaaa, b), (bad, cc), ("", bad) and (d).
    refused = ["model returned 400: refused"]
    assert [error for _, error, _ in found] == [None, None, "text is null", *refused * 4, None]
    assert [None if vector is None else vector[0] for vector, _, _ in found] == [4, 1, *[None] * 5, 1]
    with pytest.raises(ModelCallError):
        list(in_windows([(0, 2, embedder._calls(embedder.call, ["bad", "x"], 1, "fail"))], 2))
    with pytest.raises(ValueError):
        CallableEmbedder("m", call=embedder.call, in_flight=0)


def test_no_session_is_refused(spark):
    embedder = CallableEmbedder("m", 2, call=from_function(lengths), max_parallel=1)
    assert embedded(embed_rows(table(spark, ["a", "bb"]), embedder)).count() == 2


def test_an_outage_is_not_multiplied(spark, tmp_path):
    folder = str(tmp_path)

    def down(request):
        import uuid

        open(f"{folder}/{uuid.uuid4()}", "w").close()
        raise ModelCallError(503, "down")

    rows = embed_rows(table(spark, ["a"] * 32, 1), local(down))
    assert {r["error"] for r in failures(rows).collect()} == {"model returned 503: down"}
    assert len(list(tmp_path.iterdir())) == 3


def test_retry_rule_is_an_argument():
    flaky = Flaky(KeyError("odd client"))
    assert call_with_retry(flaky, 3, 0.1, flaky.waits.append, lambda error: isinstance(error, KeyError)) == "ok"


def test_null_text_stops_the_job_in_scope_fail(spark):
    for embedder in (HashingEmbedder(8), local(from_function(lengths))):
        with pytest.raises(Exception, match="text is null"):
            embed_rows(table(spark, ["a", None]), embedder, on_error="fail").collect()


@pytest.mark.parametrize("number", [float("nan"), float("inf")])
def test_numbers_that_are_not_finite_are_errors(spark, number):
    call = from_function(lambda texts: [[number] if text == "x" else [1.0] for text in texts])
    rows = embed_rows(table(spark, ["a", "x", "b"], 1), local(call))
    assert [(r["id"], r["error"]) for r in failures(rows).collect()] == [(1, "an embedding must hold finite numbers")]
    assert embedded(rows).count() == 2


def test_offsets_do_not_wrap():
    from vecweave.functions.arrow import lists

    with pytest.raises(OverflowError):
        lists(np.array([1 << 30] * 3), None)


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        CallableEmbedder("m")
    with pytest.raises(ValueError):
        embed_rows(table(spark, ["a"]), local(from_function(lengths)), batch_size=0)
    with pytest.raises(ValueError):
        embed_rows(table(spark, ["a"]), HashingEmbedder(8), on_error="sometimes")


def test_texts_and_tokens_of_a_piece_are_bounded():
    import pyarrow as pa

    from vecweave.functions.hashing import pieces

    texts = pa.array([["x" * 4000, None], [], None, ["y" * 4000]] * 4000)
    tokens = pa.array([[["word"] * 500], []] * 4000)
    for batch in (texts, tokens, tokens.slice(1, 7000)):
        found = list(pieces(batch, 3))
        assert pa.concat_arrays(found).equals(batch)
        assert len(found) > 1 and max(piece.nbytes for piece in found) <= 17 << 20


def test_rows_are_filled_into_batches_part_by_part():
    import pyarrow as pa

    from vecweave.operators.embed import _parts

    batch = pa.RecordBatch.from_pydict({"texts": ["x" * 4000] * 10_000})
    parts = list(_parts(batch, 32))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert len(parts) > 1 and max(part.nbytes for part in parts) <= 9 << 20
