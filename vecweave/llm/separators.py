"""Token counts of documents in flat files of ids that have no index.

A flat file is ids one after another, with an end id after each document. Files are read in blocks of equal length that
know nothing of documents. A task finds the end ids of its block by one vectorised comparison. A prefix scan over the
blocks of a file then tells every block how many documents have ended before it and where the last one did, which is all
it needs to number and measure its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecweave.llm.files import NewFile, little, new_folder, read_range
from vecweave.llm.frames import small_batches
from vecweave.llm.words import WordTokenizer, give_back_memory, slices, with_end
from vecweave.sources.storage import materialize

# Ids in a block (2 or 4 MB), and in a file that is written.
BLOCK_TOKENS = 1 << 20
MAX_FILE_TOKENS = 64 << 20


def write_flat_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    max_file_tokens: int = MAX_FILE_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """Encode texts where they are read and write flat files.

    Returns the files (path, n_ids, width) and the order of the documents in them (path, ordinal, doc_id). A null or
    empty text is its end id alone; ids may be null or repeated. Names of special tokens in a text are ordinary text, so
    ``end_id`` must be one of a special token.
    """
    folder = folder or new_folder(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path, plain_specials=True)
        width = tokenizer.dtype.itemsize
        part, made, file, n_ids, n_docs = TaskContext.get().partitionId(), 0, None, 0, 0

        def row(path, n_ids, ordinals, doc_ids) -> pa.RecordBatch:
            size = len(ordinals)
            columns = [[path] * size, [n_ids] * size, [width] * size]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()))]
            return pa.RecordBatch.from_arrays(
                [*arrays, ordinals, doc_ids], ["path", "n_ids", "width", "ordinal", "doc_id"]
            )

        def ended() -> pa.RecordBatch:
            file.close()
            return row(file.uri, n_ids, pa.array([None], pa.int64()), pa.array([None], pa.int64()))

        for batch in batches:
            for first, texts in slices(batch.column(1)):
                ids, offsets = with_end(*tokenizer.encode(texts), end_id)
                if file is None:
                    file, n_ids, n_docs = NewFile(f"{folder}/{part:06d}-{made:06d}.ids"), 0, 0
                file.write(little(ids, tokenizer.dtype.str))
                ordinals = pa.array(np.arange(n_docs, n_docs + len(texts)))
                yield row(file.uri, None, ordinals, batch.column(0).slice(first, len(texts)))
                n_ids, n_docs = n_ids + len(ids), n_docs + len(texts)
                if n_ids >= max_file_tokens:
                    yield ended()
                    made, file = made + 1, None
                give_back_memory()
        if file is not None:
            yield ended()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        written = materialize(
            rows.mapInArrow(write, "path string, n_ids long, width int, ordinal long, doc_id long")
        )
    files = written.filter("ordinal is null").select("path", "n_ids", "width")
    return files, written.filter("ordinal is not null").select("path", "ordinal", "doc_id")


def scan_separators(files: DataFrame, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token counts from flat files (path, n_ids, width): a row per document with path, ordinal in the file, start,
    n_tokens (with its end id) and ended.

    Ids after the last end id are a document that has not ended; two end ids in a row hold a document of one token; an
    empty file has no documents. No block is larger than ``block_tokens``, however long files or documents are.
    """
    blocks = files.select(
        "path",
        "n_ids",
        "width",
        F.explode(F.expr(f"sequence(0L, (n_ids - 1) div {block_tokens})")).alias("block"),
    ).filter("n_ids > 0")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                start = task["block"] * block_tokens
                length = min(block_tokens, task["n_ids"] - start)
                width = task["width"]
                ids = np.frombuffer(read_range(task["path"], start * width, length * width), f"<u{width}")
                places = np.flatnonzero(ids == end_id) + start
                last = int(places[-1]) if len(places) else None
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task["path"]]),
                        pa.array([task["block"]]),
                        pa.array([task["n_ids"]]),
                        pa.array([len(places)]),
                        pa.array([last], pa.int64()),
                        pa.array([places], pa.list_(pa.int64())),
                    ],
                    ["path", "block", "n_ids", "found", "last", "places"],
                )

    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(blocks.count(), 64 * cores))
    found = materialize(
        blocks.repartition(tasks).mapInArrow(
            find, "path string, block long, n_ids long, found long, last long, places array<long>"
        )
    )
    # The scan moves three numbers a block, never the places.
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "path",
        "block",
        F.coalesce(F.sum("found").over(before), F.lit(0)).alias("ended_before"),
        F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("begun"),
    )
    inside = (
        found.filter("found > 0")
        .join(carried, ["path", "block"])
        .select("path", "ended_before", "begun", "places", F.posexplode("places").alias("i", "place"))
        .select(
            "path",
            (F.col("ended_before") + F.col("i")).alias("ordinal"),
            F.expr("if(i = 0, begun, get(places, i - 1) + 1)").alias("start"),
            "place",
        )
        .select("path", "ordinal", "start", F.expr("place - start + 1").alias("n_tokens"), F.lit(True).alias("ended"))
    )
    open_end = (
        found.groupBy("path")
        .agg(F.sum("found").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("n_ids").alias("n_ids"))
        .filter("start < n_ids")
        .select("path", "ordinal", "start", F.expr("n_ids - start").alias("n_tokens"), F.lit(False).alias("ended"))
    )
    return inside.unionByName(open_end)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in flat files, counted from the files alone; the order they were written in gives their ids back."""
    from vecweave.llm.settings import SPECIAL_END_ID, WORD_TOKENIZER

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files, order = write_flat_files(docs, WORD_TOKENIZER, SPECIAL_END_ID)
    counts = scan_separators(files, SPECIAL_END_ID)
    return counts.join(order, ["path", "ordinal"], "left").select("doc_id", "n_tokens", "start", "ordinal", "ended")
