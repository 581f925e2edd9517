"""Token ids of texts in binary files, with Elias-Fano coded document boundaries.

A shard is two files. ``<name>.ids`` holds nothing but the ids of its documents, one after another, little-endian, in
two bytes if the vocabulary allows and in four otherwise. ``<name>.index`` holds the magic bytes, the width of an id,
the number of documents without an id, and two Elias-Fano sequences: the ends of the documents in the id array, and the
ids of the documents. A manifest table has a row per shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecweave.llm.elias_fano import EliasFano
from vecweave.llm.frames import small_batches
from vecweave.llm.files import NewFile, little, new_folder, read_all, read_range
from vecweave.llm.words import WordTokenizer, give_back_memory, slices, with_end
from vecweave.sources.storage import materialize

MAGIC = b"VWTOKEN1"
_HEADER = "<8sBQ"
# A shard ends with the document that takes it beyond so many ids: at most 32 MB and one document.
MAX_SHARD_TOKENS = 16 << 20
# Boundaries selected at a time, and ids read at a time: one block, or one document if that is longer.
READ_DOCS = 4096
READ_TOKENS = 2 << 20
MANIFEST = "part int, shard int, path string, n_docs long, n_tokens long"


class ShardWriter:
    """Writes the files of one shard."""

    def __init__(self, path: str, dtype: np.dtype):
        self.path, self.dtype = path, dtype
        self.file = NewFile(f"{path}.ids")
        self.lengths: list[np.ndarray] = []
        self.doc_ids: list[np.ndarray] = []
        self.nulls = self.n_docs = self.n_tokens = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray, doc_ids: pa.Array) -> None:
        self.file.write(little(ids, self.dtype.str))
        self.lengths.append(lengths)
        self.nulls += doc_ids.null_count
        self.doc_ids.append(doc_ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        self.n_docs += len(lengths)
        self.n_tokens += len(ids)

    def close(self) -> None:
        self.file.close()
        index = NewFile(f"{self.path}.index")
        index.write(struct.pack(_HEADER, MAGIC, self.dtype.itemsize, self.nulls))
        index.write(EliasFano.of(np.cumsum(np.concatenate(self.lengths))).to_bytes())
        index.write(EliasFano.of(np.concatenate(self.doc_ids)).to_bytes())
        index.close()


class ShardReader:
    """One document of a shard is found by two look-ups in its boundaries and one read of its ids."""

    def __init__(self, path: str):
        data = read_all(f"{path}.index")
        magic, width, self.nulls = struct.unpack_from(_HEADER, data)
        if magic != MAGIC:
            raise ValueError(f"{path}.index is not an index of token ids")
        self.path, self.dtype = path, np.dtype(f"<u{width}")
        self.ends, at = EliasFano.from_bytes(data, struct.calcsize(_HEADER))
        self.doc_ids, _ = EliasFano.from_bytes(data, at)

    def __len__(self) -> int:
        return len(self.ends)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def doc_id(self, i: int) -> int | None:
        """Documents without an id come first."""
        return None if i < self.nulls else self.doc_ids[i - self.nulls]

    def ids(self, start: int, stop: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(read_range(f"{self.path}.ids", start * width, (stop - start) * width), self.dtype)

    def doc_id_run(self, first: int, stop: int) -> pa.Array:
        """The ids of some documents that follow each other."""
        none = min(max(self.nulls - first, 0), stop - first)
        known = self.doc_ids.run(first + none - self.nulls, stop - self.nulls) if first + none < stop else np.zeros(0, np.int64)
        return pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(known, pa.int64())])

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, boundaries) of blocks of documents, found by select. A block of n documents has n + 1
        boundaries."""
        for first in range(0, len(self), READ_DOCS):
            ends = self.ends.run(first, min(first + READ_DOCS, len(self)))
            yield first, np.concatenate([[self.bounds(first)[0]], ends])

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.bounds(i))


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    max_shard_tokens: int = MAX_SHARD_TOKENS,
) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids in ascending order of ``doc_id``: the manifest.

    A null or empty text is its end id alone. Rows without an id come first; rows that share one are ordered by a hash of
    their text, and each is a document. An empty table gives an empty manifest. Other columns do not matter.
    Texts are dealt out by ranges of ids and these hashes, so a task holds the texts of one range, sorted by Spark, and
    writes them as they come; an id with very many rows, or none, spreads over tasks.
    """
    folder = folder or new_folder(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        part, made, shard = TaskContext.get().partitionId(), 0, None

        def ended() -> pa.RecordBatch:
            shard.close()
            row = {"part": part, "shard": made, "path": shard.path, "n_docs": shard.n_docs, "n_tokens": shard.n_tokens}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for first, texts in slices(batch.column(1)):
                ids, offsets = with_end(*tokenizer.encode(texts), end_id)
                doc_ids, start = batch.column(0).slice(first, len(texts)), 0
                while start < len(texts):
                    if shard is None:
                        shard = ShardWriter(f"{folder}/{part:06d}-{made:06d}", tokenizer.dtype)
                    room = offsets[start] + max_shard_tokens - shard.n_tokens
                    stop = max(start + 1, int(np.searchsorted(offsets, room, side="right")) - 1)
                    lengths = np.diff(offsets[start : stop + 1])
                    shard.add(ids[offsets[start] : offsets[stop]], lengths, doc_ids.slice(start, stop - start))
                    start = stop
                    if shard.n_tokens >= max_shard_tokens or start < len(texts):
                        yield ended()
                        made, shard = made + 1, None
                give_back_memory()
        if shard is not None:
            yield ended()

    schema = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
    )
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    with small_batches(docs.sparkSession):
        return materialize(ordered.mapInArrow(write, MANIFEST))


def shard_tasks(manifest: DataFrame) -> DataFrame:
    """Deal the rows of a manifest out, a few to a task."""
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.repartition(max(1, min(manifest.count(), max(8 * cores, 2000))))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """A row per document from the written files: its id, where its ids start among those of all shards, how many
    they are, and their CRC-32 as little-endian unsigned 32-bit numbers.

    Boundaries are selected block by block; no table of those of a shard is made. The window over the manifest has no
    partitions: it has a row for each ``max_shard_tokens`` ids.
    """
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(path)
                for block, edges in shard.blocks():
                    first, last = 0, len(edges) - 1
                    while first < last:
                        stop = max(first + 1, int(np.searchsorted(edges, edges[first] + READ_TOKENS, side="right")) - 1)
                        ids = shard.ids(int(edges[first]), int(edges[stop])).astype("<u4")
                        cuts = edges[first : stop + 1] - edges[first]
                        crcs = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [
                                shard.doc_id_run(block + first, block + stop),
                                pa.array(edges[first:stop] + base),
                                pa.array(np.diff(cuts)),
                                pa.array(crcs, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        first = stop

    return shard_tasks(placed.select("path", "base")).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecweave.llm.settings import END_ID, WORD_TOKENIZER

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, WORD_TOKENIZER, END_ID))
