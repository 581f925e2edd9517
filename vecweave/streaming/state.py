"""Operators that remember rows of earlier micro-batches.

State is kept by key in the state store of the query, which must be that of RocksDB; it survives a restart from the
checkpoint. Time is that of a column of the stream, so what happens depends on the rows alone, not on when they are
processed: a stream that is replayed gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vecweave.constants import DEFAULT_BATCH_SIZE
from vecweave.operators.embedders import check_batch_size

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# In how many parts a record of repeats is kept.
BUCKETS = 1024


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries that are started inside have the state store that these operators need; the session has its own setting
    again afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _millis(column: pd.Series) -> pd.Series:
    """Times as milliseconds."""
    return pd.to_datetime(column, utc=True).astype("datetime64[ms, UTC]").astype("int64")


class _Filling(StatefulProcessor):
    """Texts that wait for their batch to be full."""

    def __init__(self, batch_size: int, wait_ms: int, id_type: str):
        self.batch_size, self.wait_ms, self.id_type = batch_size, wait_ms, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"id {self.id_type}, text string")
        self.due = handle.getValueState("due", "at bigint")

    def _batches(self, key, rows: list[tuple], reason: str) -> Iterator[pd.DataFrame]:
        for start in range(0, len(rows), self.batch_size):
            part = rows[start : start + self.batch_size]
            yield pd.DataFrame({"shard": [key[0]], "ids": [[i for i, _ in part]], "texts": [[t for _, t in part]], "reason": [reason]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(row) for row in self.waiting.get()] if self.waiting.exists() else []
        due = self.due.get()[0] if self.due.exists() else None
        for frame in rows:
            frame = frame.sort_values("received", kind="stable")
            known = frame[frame["id"].notna()]
            times = _millis(known["received"])
            arrived = list(zip(known["id"].tolist(), known["text"].where(known["text"].notna(), None).tolist()))
            if not held and arrived:
                due = int(times.iloc[0]) + self.wait_ms
            held += arrived
            whole = len(held) - len(held) % self.batch_size
            if whole:
                yield from self._batches(key, held[:whole], "full")
                # What is left has come with these rows.
                held = held[whole:]
                due = int(times.iloc[-len(held)]) + self.wait_ms if held else None
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        if held:
            self.waiting.put(held)
            self.due.update((due,))
            self.handle.registerTimer(due)
        else:
            self.waiting.clear()
            self.due.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            yield from self._batches(key, [tuple(row) for row in self.waiting.get()], "due")
        self.waiting.clear()
        self.due.clear()

    def close(self) -> None:
        pass


def filled_across(
    stream: DataFrame,
    text: str,
    row_id: str,
    received: str,
    batch_size: int = DEFAULT_BATCH_SIZE,
    wait: str = "1 minute",
    shards: int = 8,
    delay: str = "0 seconds",
) -> DataFrame:
    """Batches of a stream that are filled over micro-batches: shard, ids, texts, and why they were sent off.

    A batch is ``full`` with ``batch_size`` texts. What is left of the rows of a micro-batch waits for further ones, until
    the time of the stream is ``wait`` beyond that of the first text that waits; then it is ``due`` and goes as it is. The
    time of the stream is the latest ``received``, less ``delay``. So a shard has one short batch at most for each
    ``wait``, however short micro-batches are. ``shards`` is how many batches are filled at a time: rows are dealt by a hash
    of their id, so none is hot. A row without an id only carries the time on. Nothing that waits is lost in a restart.
    """
    check_batch_size(batch_size)
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    id_type = stream.schema[row_id].dataType.simpleString()
    rows = stream.select(
        F.pmod(F.xxhash64(row_id), F.lit(shards)).cast("int").alias("shard"),
        F.col(row_id).alias("id"),
        F.col(text).cast("string").alias("text"),
        F.col(received).alias("received"),
    )
    return (
        rows.withWatermark("received", delay)
        .groupBy("shard")
        .transformWithStateInPandas(
            statefulProcessor=_Filling(batch_size, wait_ms, id_type),
            outputStructType=f"shard int, ids array<{id_type}>, texts array<string>, reason string",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


_KNOWN = pa.schema([("event_id", pa.string()), ("place", pa.string()), ("repeats", pa.int64()), ("due", pa.int64())])


class _Suppressing(StatefulProcessor):
    """What is known of the events of a bucket: where each was first, how often it came again, and when it is forgotten.

    The state of a bucket is one table, so a bucket costs two calls of the state store however many events it has."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("known", "events binary, timer bigint")

    def _load(self) -> tuple[pd.DataFrame, int | None]:
        held = self.state.get() if self.state.exists() else None
        if held is None:
            return _KNOWN.empty_table().to_pandas(), None
        return pa.ipc.open_stream(bytes(held[0])).read_pandas(), held[1]

    def _save(self, known: pd.DataFrame, timer: int | None) -> None:
        """One timer a bucket, for the event that is forgotten first."""
        due = int(known["due"].min()) if len(known) else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            self.state.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _KNOWN) as writer:
            writer.write_table(pa.Table.from_pandas(known, _KNOWN, preserve_index=False))
        self.state.update((sink.getvalue().to_pybytes(), due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self._load()
        for frame in rows:
            frame = frame.sort_values(["received", "place"], kind="stable").reset_index(drop=True)
            # Events are numbered, known ones first; a null id is an event, too.
            number = pd.factorize(pd.concat([known["event_id"], frame["event_id"]], ignore_index=True), use_na_sentinel=False)[0][len(known) :]
            new = ~pd.Series(number).duplicated() & (number >= len(known))
            first = frame[new]
            due = _millis(first["received"]) + self.window_ms
            came = pd.DataFrame({"event_id": first["event_id"], "place": first["place"], "repeats": -1, "due": due})
            known = pd.concat([known, came], ignore_index=True) if len(known) else came.reset_index(drop=True)
            frame["repeat_no"] = known["repeats"].to_numpy()[number] + 1 + frame.groupby(number).cumcount()
            frame["first_place"] = known["place"].to_numpy()[number]
            known["repeats"] += np.bincount(number, minlength=len(known))
            yield frame[["event_id", "place", "received", "repeat_no", "first_place"]]
        self._save(known, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, _ = self._load()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        self._save(known[known["due"] > passed], None)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def mark_repeats(
    stream: DataFrame, event_id: str, place: str, received: str, window: str = "1 hour", delay: str = "0 seconds", buckets: int = BUCKETS
) -> DataFrame:
    """Every row of a stream with how often its event was there before: event_id, place, received, repeat_no, first_place.

    ``repeat_no`` is 0 for the row that passes and 1, 2, ... for those to suppress; ``first_place`` is the place of the one
    that passed. So what is suppressed is on record: how often, and in the rows themselves where it came from. An event is
    forgotten when the time of the stream is ``window`` beyond that of the row that passed. Rows that are later than the
    time of the stream are dropped by Spark, so ``delay`` must cover how far rows are out of order. Only the id, the
    place and the time of a row are moved. A null id is an event, too.

    Events are dealt into ``buckets`` by a hash of their id, and the state of a bucket is one table: for each of its
    events the id, the first place and two numbers. A micro-batch reads and writes the buckets that it has events of, so
    there should be some hundred to some ten thousand events to a bucket; another number of buckets needs another
    checkpoint.
    """
    if buckets < 1:
        raise ValueError("there must be a bucket at least")
    rows = stream.select(F.col(event_id).cast("string").alias("event_id"), F.col(place).cast("string").alias("place"), F.col(received).alias("received"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int"))
    return (
        rows.withWatermark("received", delay)
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=_Suppressing(int(pd.Timedelta(window).total_seconds() * 1000)),
            outputStructType="event_id string, place string, received timestamp, repeat_no bigint, first_place string",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
