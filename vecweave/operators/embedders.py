"""Embedders: what turns texts into vectors.

An embedder has a name, a declared dimension, an input limit in bytes and a limit of parallel calls, and turns an
``array<string>`` expression into an array of outcomes (vector or error) of the same length and order.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import BoundedSemaphore
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column

from vecweave.constants import (
    BATCHES_IN_FLIGHT,
    CALL_ATTEMPTS,
    CALL_FIRST_WAIT_SECONDS,
    DECLARED_DIMENSION,
    DEFAULT_BATCH_SIZE,
    INPUT_TYPE,
    MAX_INPUT_BYTES,
    MAX_PARALLEL_CALLS,
    TOO_MANY_REQUESTS,
)
from vecweave.functions.arrow import lengths_of, lists, outcome_array
from vecweave.functions.hashing import hashed_vectors, pieces
from vecweave.schemas import OUTCOME

# How far a failed call reaches: the job, the batch of texts in the call, or single texts.
SCOPES = ("fail", "batch", "row")


class Embedder(Protocol):
    name: str
    dimension: int
    max_bytes: int
    max_parallel: int | None

    def outcomes(
        self, texts: str, batch_size: int | str = DEFAULT_BATCH_SIZE, on_error: str = "row"
    ) -> Column: ...


def check_scope(on_error: str) -> None:
    if on_error not in SCOPES:
        raise ValueError(f"on_error must be one of {SCOPES}, not {on_error!r}")


def check_batch_size(batch_size: int) -> None:
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed feature hashing. It runs where the rows are and needs no call limit."""

    dimension: int = DECLARED_DIMENSION
    name: str = "feature-hashing"
    max_bytes: int = MAX_INPUT_BYTES
    max_parallel: int | None = None

    def outcomes(
        self, texts: str, batch_size: int | str = DEFAULT_BATCH_SIZE, on_error: str = "row"
    ) -> Column:
        check_scope(on_error)
        return hashed_vectors(texts, self.dimension, refuse_null=on_error == "fail")


class ModelCallError(Exception):
    """A model call that was answered with an error status."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"model returned {status}: {message}")
        self.status = status


def is_retryable(error: Exception) -> bool:
    """Server errors, rate limits and transport errors may pass; other statuses, bad answers and missing files will not."""
    if isinstance(error, ModelCallError):
        return error.status >= 500 or error.status == TOO_MANY_REQUESTS
    return isinstance(error, (ConnectionError, TimeoutError))


def call_with_retry(
    call: Callable[[], Any],
    attempts: int,
    first_wait: float,
    sleep: Callable[[float], None] = time.sleep,
    retryable: Callable[[Exception], bool] = is_retryable,
) -> Any:
    """Call until it works, at most ``attempts`` times, waiting twice as long each time."""
    for left in reversed(range(attempts)):
        try:
            return call()
        except Exception as error:
            if left == 0 or not retryable(error):
                raise
            sleep(first_wait * 2 ** (attempts - 1 - left))
    raise ValueError("attempts must be at least 1")


def vectors_in_order(response: dict, expected: int) -> list[np.ndarray]:
    """Vectors of a response {data: [{embedding, index}]}, in the order of the texts."""
    data = sorted(response["data"], key=lambda item: item["index"])
    if len(data) != expected:
        raise ValueError(f"model returned {len(data)} vectors for {expected} texts")
    vectors = [np.asarray(item["embedding"], dtype=np.float32) for item in data]
    if any(vector.ndim != 1 for vector in vectors):
        raise ValueError("an embedding must be a list of numbers")
    if not all(np.isfinite(vector).all() for vector in vectors):
        raise ValueError("an embedding must hold finite numbers")
    return vectors


def from_function(function: Callable[[list[str]], list]) -> Callable[[dict], dict]:
    """Make a model call of a plain function from texts to vectors."""

    def call(request: dict) -> dict:
        vectors = function(request["input"])
        return {"data": [{"embedding": v, "index": i} for i, v in enumerate(vectors)]}

    return call


class CallWindow:
    """Calls that are open at the same time, and their results in the order in which they were begun.

    At most ``size`` calls are begun and not yet released: the next one waits until the oldest has its result. So a slow
    call holds back what comes after it, never more than ``size`` calls of it, and nothing overtakes.
    """

    def __init__(self, size: int):
        if size < 1:
            raise ValueError("a window must have room for a call")
        self.size = size
        self._pool = ThreadPoolExecutor(size)
        self._open: deque[tuple[Future, Callable]] = deque()

    def begin(self, call: Callable[[], Any], release: Callable[[Any], None]) -> None:
        """Begin ``call`` as soon as there is room; ``release`` gets its result when its turn has come."""
        while len(self._open) >= self.size:
            self.release_oldest()
        self._open.append((self._pool.submit(call), release))

    def release_oldest(self) -> bool:
        """Wait for the oldest call and release it; false if none is open. An error of the call is raised here."""
        if not self._open:
            return False
        future, release = self._open.popleft()
        release(future.result())
        return True

    def __enter__(self) -> CallWindow:
        return self

    def __exit__(self, *_) -> None:
        # After an error no further call is begun; those that are open end by themselves.
        self._pool.shutdown(wait=True, cancel_futures=True)


def in_windows(work: Iterable[tuple[Any, int, list[tuple[list[int], Callable[[], list]]]]], size: int) -> Iterator[tuple[Any, list]]:
    """Pieces of work with their results, in order. A piece is (tag, number of texts, calls); a call is the places of its
    texts and a function that gives an outcome for each. Calls of the following pieces are open while a piece is still
    waiting for its own, as far as the window of ``size`` calls reaches; a text in no call is null."""
    waiting: deque[list] = deque()

    def finished() -> Iterator[tuple[Any, list]]:
        while waiting and not waiting[0][2]:
            tag, found, _ = waiting.popleft()
            yield tag, found

    with CallWindow(size) as window:
        for tag, count, calls in work:
            piece = [tag, [(None, "text is null", 0.0)] * count, len(calls)]
            waiting.append(piece)
            for places, call in calls:

                def release(outcomes: list, piece=piece, places=places) -> None:
                    for place, outcome in zip(places, outcomes):
                        piece[1][place] = outcome
                    piece[2] -= 1

                window.begin(call, release)
                yield from finished()
            yield from finished()
        while window.release_oldest():
            yield from finished()


@dataclass(frozen=True)
class CallableEmbedder:
    """Any model behind a function from request {model, input, input_type} to response {data}.

    ``call`` is sent to the workers; give ``open_model`` instead to make the function there, once per task (for a
    client or a loaded model). A task has ``in_flight`` calls open at a time, and never more than ``max_parallel``; their
    vectors come in the order of the texts whatever call ends first. The function is called from several threads then;
    with ``in_flight=1`` from one at a time. ``retryable`` tells errors that may pass.
    """

    name: str
    dimension: int = DECLARED_DIMENSION
    call: Callable[[dict], dict] | None = None
    open_model: Callable[[], Callable[[dict], dict]] | None = None
    max_bytes: int = MAX_INPUT_BYTES
    max_parallel: int | None = MAX_PARALLEL_CALLS
    in_flight: int = BATCHES_IN_FLIGHT
    attempts: int = CALL_ATTEMPTS
    first_wait: float = CALL_FIRST_WAIT_SECONDS
    input_type: str = INPUT_TYPE
    sleep: Callable[[float], None] = field(default=time.sleep)
    retryable: Callable[[Exception], bool] = field(default=is_retryable)

    def __post_init__(self):
        if (self.call is None) == (self.open_model is None):
            raise ValueError("give either call or open_model")
        if self.attempts < 1:
            raise ValueError("attempts must be at least 1")
        if self.window < 1:
            raise ValueError("in_flight and max_parallel must be at least 1")

    @property
    def window(self) -> int:
        """How many calls a task may have open."""
        return self.in_flight if self.max_parallel is None else min(self.in_flight, self.max_parallel)

    def outcomes(
        self, texts: str, batch_size: int | str = DEFAULT_BATCH_SIZE, on_error: str = "row"
    ) -> Column:
        """With a number as ``batch_size``, calls are filled with the texts of neighbouring rows; with an
        expression, each row is cut into calls of its own size."""
        check_scope(on_error)
        calls, open_model, call, dimension, window = self._calls, self.open_model, self.call, self.dimension, self.window

        def model():
            return call if open_model is None else open_model()

        def nested(batch: pa.Array, found: list) -> pa.Array:
            vectors, errors, millis = zip(*found) if found else ((), (), ())
            return lists(lengths_of(batch), outcome_array(vectors, errors, millis))

        if isinstance(batch_size, str):

            @F.arrow_udf(f"array<{OUTCOME}>")
            def embed_rows(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
                def work(opened) -> Iterator[tuple]:
                    for batch, sizes in batches:
                        at = 0
                        for piece in pieces(batch, dimension):
                            planned, first = [], 0
                            for row, size in zip(piece.to_pylist(), sizes.slice(at, len(piece)).to_pylist()):
                                planned += calls(opened, row or [], size, on_error, first)
                                first += len(row or [])
                            at += len(piece)
                            yield piece, first, planned

                for piece, found in in_windows(work(model()), window):
                    yield nested(piece, found)

            return embed_rows.asNondeterministic()(F.expr(texts), F.expr(batch_size))

        check_batch_size(batch_size)

        @F.arrow_udf(f"array<{OUTCOME}>")
        def embed_together(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            def work(opened) -> Iterator[tuple]:
                for batch in batches:
                    for piece in pieces(batch, dimension):
                        given = piece.flatten().to_pylist()
                        yield piece, len(given), calls(opened, given, batch_size, on_error)

            for piece, found in in_windows(work(model()), window):
                yield nested(piece, found)

        return embed_together.asNondeterministic()(F.expr(texts))

    def _calls(self, model, texts: list, size: int, on_error: str, first: int = 0) -> list[tuple[list[int], Callable[[], list]]]:
        """The calls for texts, ``size`` to each, with the places of their texts from ``first`` on. Null texts are not
        sent."""
        check_batch_size(size)
        if on_error == "fail" and None in texts:
            raise ValueError("text is null")
        given = [place for place, text in enumerate(texts) if text is not None]
        planned = []
        for start in range(0, len(given), size):
            places = given[start : start + size]
            sent = [texts[place] for place in places]
            planned.append(([first + place for place in places], lambda sent=sent: self._call(model, sent, on_error)))
        return planned

    def _call(self, model, texts: list[str], on_error: str) -> list[tuple]:
        started = time.perf_counter()
        request = {"model": self.name, "input": texts, "input_type": self.input_type}
        failure = None
        try:
            vectors = call_with_retry(
                lambda: vectors_in_order(model(request), len(texts)),
                self.attempts,
                self.first_wait,
                self.sleep,
                self.retryable,
            )
        except Exception as error:
            if on_error == "fail":
                raise
            if on_error == "row" and len(texts) > 1 and not self.retryable(error):
                # One bad text must not cost its neighbours their vectors. An outage is not the fault of any: the texts
                # have had their attempts together.
                return [o for text in texts for o in self._call(model, [text], on_error)]
            vectors, failure = [None] * len(texts), str(error) or type(error).__name__
        millis = (time.perf_counter() - started) * 1000 / len(texts)
        return [(vector, failure, millis) for vector in vectors]


def outcomes_by_name(
    embedders: Sequence[CallableEmbedder], texts: str, batch_size: str, name: str, on_error: str = "batch"
) -> Column:
    """Outcomes of rows that are for different models: ``name`` is the SQL of the model of a row; a row of another name
    has no outcomes. One Python stage serves all models; each is opened when its first row comes."""
    check_scope(on_error)
    served = {embedder.name: embedder for embedder in embedders}
    dimension = max(embedder.dimension for embedder in embedders)
    window = max(embedder.window for embedder in embedders)

    @F.arrow_udf(f"array<{OUTCOME}>")
    def embed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        opened: dict[str, Any] = {}
        # Of one model no more calls are open than it allows.
        room = {name: BoundedSemaphore(embedder.window) for name, embedder in served.items()}

        def within(name: str, call: Callable[[], list]) -> Callable[[], list]:
            def limited() -> list:
                with room[name]:
                    return call()

            return limited

        def work() -> Iterator[tuple]:
            for batch, sizes, names in batches:
                at = 0
                for piece in pieces(batch, dimension):
                    planned, lengths, total = [], [], 0
                    of_piece = slice(at, at + len(piece))
                    at += len(piece)
                    for row, size, chosen in zip(piece.to_pylist(), sizes[of_piece].to_pylist(), names[of_piece].to_pylist()):
                        embedder = served.get(chosen)
                        first = total
                        lengths.append(len(row) if embedder and row else 0)
                        total += lengths[-1]
                        if lengths[-1]:
                            if chosen not in opened:
                                opened[chosen] = embedder.open_model() if embedder.call is None else embedder.call
                            calls = embedder._calls(opened[chosen], row, size, on_error, first)
                            planned += [(places, within(chosen, call)) for places, call in calls]
                    yield lengths, total, planned

        for lengths, found in in_windows(work(), window):
            vectors, errors, millis = zip(*found) if found else ((), (), ())
            yield lists(np.array(lengths, np.int64), outcome_array(vectors, errors, millis))

    return embed.asNondeterministic()(F.expr(texts), F.expr(batch_size), F.expr(name))
