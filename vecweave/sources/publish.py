"""Publishing message by message.

A sink is a function ``send(key, value)`` that raises an error if it cannot send. It is opened in every task. A message
that is refused is tried again after a wait; refused for the last time it becomes a dead letter, and its neighbours are
published all the same. Later messages of the same key wait for it, so that messages of a key arrive in order.

Spark writes through a Python data source. A task tells the driver how many messages it has published and refused, and
in which file its letters are; only files of tasks that were committed get their final names. Messages are published once
for each attempt of a task: at least once, as with any sink without transactions.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import Any

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from vecweave.constants import EMBEDDING_TOPIC, PUBLISH_ATTEMPTS, PUBLISH_FIRST_WAIT_MS
from vecweave.sources.files import NewFile, located, move, read_all

Send = Callable[[Any, Any], None]
LETTERS = "key string, value string"
# Messages of which the refused ones are tried again together: an outage costs the waits of one message for each block.
BLOCK = 1000


def deliver(
    messages: Iterable[tuple[Any, Any]],
    send: Send,
    refuse: Callable[[Any, Any, Exception], None],
    attempts: int = PUBLISH_ATTEMPTS,
    first_wait: float = PUBLISH_FIRST_WAIT_MS / 1000,
    sleep: Callable[[float], None] = time.sleep,
    retryable: Callable[[Exception], bool] = lambda error: True,
) -> tuple[int, int]:
    """Send every message, in the order of its key; returns how many were sent and how many refused.

    A message has ``attempts``, with waits between them that double. Meanwhile messages of other keys, and those without a
    key, go on. An error that is not the sink's, of reading the messages or of ``refuse``, is raised.
    """
    if attempts < 1:
        raise ValueError("attempts must be at least 1")
    sent = refused = 0
    messages = iter(messages)
    while block := list(islice(messages, BLOCK)):
        pending = [(key, value, 0) for key, value in block]
        while pending:
            later, held, wait = [], set(), 0.0
            for key, value, tries in pending:
                if key is not None and key in held:
                    later.append((key, value, tries))
                    continue
                try:
                    send(key, value)
                except Exception as error:
                    tries += 1
                    if tries < attempts and retryable(error):
                        later.append((key, value, tries))
                        held.add(key)
                        wait = max(wait, first_wait * 2 ** (tries - 1))
                    else:
                        refuse(key, value, error)
                        refused += 1
                else:
                    sent += 1
            pending = later
            if pending:
                sleep(wait)
    return sent, refused


@dataclass
class Published(WriterCommitMessage):
    """What a task has done: messages sent and refused, and the file of its letters, if there are any."""

    sent: int
    refused: int
    partition: int
    file: str | None


@dataclass(frozen=True)
class Publisher:
    """How messages are published: ``open_sink`` opens the sink in a task, ``letters`` is the folder of dead letters."""

    open_sink: Callable[[], Send]
    letters: str
    topic: str = EMBEDDING_TOPIC
    attempts: int = PUBLISH_ATTEMPTS
    first_wait: float = PUBLISH_FIRST_WAIT_MS / 1000
    sleep: Callable[[float], None] = field(default=time.sleep)
    retryable: Callable[[Exception], bool] = field(default=lambda error: True)
    now: Callable[[], float] = field(default=time.time)

    def task(self, rows: Iterator) -> Published:
        """Publish the rows of a task."""
        partition = TaskContext.get().partitionId()
        file: NewFile | None = None

        def refuse(key, value, error: Exception) -> None:
            nonlocal file
            file = file or NewFile(f"{self.letters.rstrip('/')}/_pending/{uuid.uuid4()}.json")
            event = bytes(value).decode("utf-8", "replace") if isinstance(value, (bytes, bytearray)) else value
            letter = {
                "failedTopic": self.topic,
                "failedAt": int(self.now() * 1000),
                "error": " ".join(str(error).split())[:500] or type(error).__name__,
                "event": event,
            }
            key = bytes(key).decode("utf-8", "replace") if isinstance(key, (bytes, bytearray)) else key
            line = {"key": key, "value": json.dumps(letter, ensure_ascii=False, separators=(",", ":"))}
            file.write(json.dumps(line).encode() + b"\n")

        send = self.open_sink()
        try:
            messages = ((row["key"], row["value"]) for row in rows)
            sent, refused = deliver(messages, send, refuse, self.attempts, self.first_wait, self.sleep, self.retryable)
        finally:
            # What a sink buffers it sends when it is closed.
            if hasattr(send, "close"):
                send.close()
        if file is not None:
            file.close()
        return Published(sent, refused, partition, file.uri if file else None)

    def commit(self, done: list[Published | None], run: str) -> None:
        """Name the letters of a run by their partitions: a run that is repeated replaces its own. The driver handles a
        name and three numbers per task."""
        told = [one for one in done if one is not None]
        for one in told:
            if one.file is not None:
                move(one.file, f"{self.letters.rstrip('/')}/{run}-{one.partition:06d}.json")
        counts = NewFile(f"{self.letters.rstrip('/')}/_counts/{run}.json")
        counts.write(json.dumps({"sent": sum(o.sent for o in told), "refused": sum(o.refused for o in told)}).encode())
        counts.close()

    def abort(self, done: list[Published | None]) -> None:
        for one in done:
            if one is not None and one.file is not None:
                system, path = located(one.file)
                system.delete_file(path)

    def counts(self, run: str) -> dict[str, int]:
        """Messages sent and refused in a run that was committed."""
        return json.loads(read_all(f"{self.letters.rstrip('/')}/_counts/{run}.json"))


class _TableWriter(DataSourceWriter):
    def __init__(self, publisher: Publisher, run: str):
        self.publisher, self.run = publisher, run

    def write(self, iterator):
        return self.publisher.task(iterator)

    def commit(self, messages):
        self.publisher.commit(messages, self.run)

    def abort(self, messages):
        self.publisher.abort(messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, publisher: Publisher, run: str):
        self.publisher, self.run = publisher, run

    def write(self, iterator):
        return self.publisher.task(iterator)

    def commit(self, messages, batchId):
        self.publisher.commit(messages, f"{self.run}-{batchId}")

    def abort(self, messages, batchId):
        self.publisher.abort(messages)


def _registered(spark: SparkSession, publisher: Publisher, run: str) -> str:
    """The name of a data source that writes with ``publisher``."""
    unique = f"vecweave_publish_{uuid.uuid4().hex}"

    class Messages(DataSource):
        @classmethod
        def name(cls):
            return unique

        def writer(self, schema, overwrite):
            return _TableWriter(publisher, run)

        def streamWriter(self, schema, overwrite):
            return _StreamWriter(publisher, run)

    spark.dataSource.register(Messages)
    return unique


def publish(messages: DataFrame, publisher: Publisher, run: str | None = None) -> dict[str, int]:
    """Publish ``key`` and ``value`` of a table; returns {sent, refused}. With the same ``run``, letters of an earlier
    attempt are replaced."""
    run = run or uuid.uuid4().hex
    name = _registered(messages.sparkSession, publisher, run)
    messages.select("key", "value").write.format(name).mode("append").save()
    return publisher.counts(run)


def publish_stream(messages: DataFrame, publisher: Publisher, checkpoint: str, run: str = "stream", trigger: dict | None = None) -> StreamingQuery:
    """Start publishing a stream of ``key`` and ``value``. A micro-batch that is repeated replaces its letters; its counts
    are those of the run ``{run}-{batch id}``."""
    name = _registered(messages.sparkSession, publisher, run)
    writer = messages.select("key", "value").writeStream.format(name).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_letters(spark: SparkSession, letters: str) -> DataFrame:
    """The dead letters in a folder: key, and the envelope as value. None, if nothing was refused so far."""
    system, path = located(letters)
    system.create_dir(path, recursive=True)
    return spark.read.schema(LETTERS).json(letters)
