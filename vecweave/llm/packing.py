"""Packing of documents into windows of tokens by lexical retrieval.

Documents are dealt into shards of a bounded number of tokens, near ones together: the order is by the least hash of
their tokens. Each shard has its own inverted index. Every window has a seed document: BM25 ranks the unused documents by
how like the seed they are, and these fill the window one after the other, whole, until the last is cut where the window
ends. What is left of that one opens the next window and is its seed; else that is the first unused document. Statistics
for BM25 are those of all documents. Only the last window of a shard is not full; it is cut into sequences of powers of
two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.llm.frames import small_batches
from vecweave.llm.words import WordTokenizer, give_back_memory, places_of, slices, with_end
from vecweave.sources.storage import materialize

WINDOW = 2048
# A shard is complete with the document that takes it beyond this many tokens; a task packs its shards one by one.
SHARD_TOKENS = 1 << 20
# BM25.
K1, B = 1.2, 0.75
# A token that one of so many documents of a shard has is looked up in a row of scores.
DENSE_ONE_OF = 8
# So many of the documents most like a seed are put in order at first; a window seldom takes more.
FIRST_RANKED = 32
# Parts of a document longer than this are full windows of their own, so no row is longer.
MAX_PART_TOKENS = 256 * WINDOW
# Texts are encoded in slices of about this many bytes: the larger, the fewer words are looked up.
# A batch is one, and there are several copies of it on the way.
SLICE_BYTES, BATCH_BYTES = 5 << 20, "4m"
_SHARD_IDS = 1 << 40
# What the rows of statistics have as number of the row, and as tokens for the numbers of parts and of tokens.
_STATISTICS, _PARTS, _TOKENS = -1, -1, -2
_FAR = np.uint64(1 << 62)


def encode_parts(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", max_part: int = MAX_PART_TOKENS) -> DataFrame:
    """A row per part of a document: doc_id, row, start, doc_tokens, near and ids (little-endian), and the text's end id
    last. ``row`` tells rows apart that share an id; ``near`` is alike for texts with like tokens. A null text is empty.
    One more row per task, whose ``row`` is ``_STATISTICS``, has in how many of its parts each token is."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        row = TaskContext.get().partitionId() * _SHARD_IDS
        mix = (np.arange(1 << 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        found = np.zeros(1 << 8 * min(tokenizer.dtype.itemsize, 3), np.int64)
        last = np.zeros(len(found), np.int32)  # where a part has each of its tokens for the last time
        place = np.arange(max_part, dtype=np.int32)
        parts = tokens = 0
        for batch in batches:
            for first, texts in slices(batch.column(1), SLICE_BYTES):
                ids, offsets = with_end(*tokenizer.encode(texts), end_id)
                pairs = ids[1:].astype(np.uint32) ^ (ids[:-1].astype(np.uint32) << np.uint32(1))
                pairs &= np.uint32(len(mix) - 1)
                hashes = np.empty(len(ids), np.uint64)
                np.take(mix, pairs, out=hashes[:-1], mode="clip")
                hashes[offsets[1:] - 1] = _FAR  # a pair lies in one text
                least = np.minimum.reduceat(hashes, offsets[:-1])
                near = np.where(np.diff(offsets) > 1, least, 0).tolist()
                del pairs, hashes
                out: dict[str, list] = {n: [] for n in ("doc_id", "row", "start", "doc_tokens", "near", "ids")}
                bounds = offsets.tolist()
                for i, doc in enumerate(batch.column(0).slice(first, len(texts)).to_pylist()):
                    a, b = bounds[i], bounds[i + 1]
                    for start in range(a, b, max_part):
                        part = ids[start : min(b, start + max_part)]
                        last[part] = place[: len(part)]
                        found[part[last[part] == place[: len(part)]]] += 1
                        parts += 1
                        for name, value in zip(out, (doc, row, start - a, b - a, near[i], part.tobytes())):
                            out[name].append(value)
                    row += 1
                tokens += len(ids)
                yield pa.RecordBatch.from_pydict(out, schema)
                del ids, out
                give_back_memory()
        seen = np.flatnonzero(found)
        told = np.stack([np.append(seen, [_PARTS, _TOKENS]), np.append(found[seen], [parts, tokens])]).astype("<i8")
        yield pa.RecordBatch.from_pydict({"doc_id": [None], "row": [_STATISTICS], "start": [0], "doc_tokens": [0], "near": [0], "ids": [told.tobytes()]}, schema)
        del tokenizer, mix, found, last, place
        give_back_memory()

    schema = pa.schema(
        [("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("near", pa.int64()), ("ids", pa.binary())]
    )
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(
        encode, "doc_id long, row long, start long, doc_tokens long, near long, ids binary"
    )


def token_statistics(parts: DataFrame) -> tuple[np.ndarray, float]:
    """The weight of each token by how many parts have it, and the mean length of a part, over all of them. Tasks have
    counted their own; the driver gets one number per token of the vocabulary."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                seen, found = np.frombuffer(data, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(found)], ["token", "n"])

    summed = parts.filter(f"row = {_STATISTICS}").select("ids").mapInArrow(told, "token long, n long")
    table = {row["token"]: row["n"] for row in summed.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n_parts = max(1, table.pop(_PARTS, 0))
    mean = table.pop(_TOKENS, 0) / n_parts
    found = np.zeros(max(table, default=0) + 1, np.int64)
    for token, n in table.items():
        found[token] = n
    return np.log1p((n_parts - found + 0.5) / (found + 0.5)), mean


class ShardIndex:
    """Inverted index of a shard, and the search for the unused documents most like another one."""

    def __init__(self, documents: list[np.ndarray], weights: np.ndarray, mean: float):
        lengths = np.array([len(d) for d in documents], np.float64)
        owner = np.repeat(np.arange(len(documents)), lengths.astype(np.int64))
        tokens = np.concatenate(documents).astype(np.int64)
        pair, n = np.unique(tokens * len(documents) + owner, return_counts=True)
        token, doc = pair // len(documents), pair % len(documents)
        norm = K1 * (1 - B + B * lengths / max(mean, 1.0))
        score = weights[token] * n * (K1 + 1) / (n + norm[doc])
        self.count = len(documents)
        # The documents that are still in the index; places in it are places in this.
        self.live = np.arange(self.count)
        # Every token of a document is asked for.
        order = np.argsort(doc, kind="stable")
        self.asked = token[order]
        self.asked_first = np.searchsorted(doc[order], np.arange(self.count + 1))
        # Tokens of many documents have a row of scores, the others a list of documents.
        found = np.bincount(token, minlength=len(weights))
        dense = found * DENSE_ONE_OF >= self.count
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        self.rows = np.zeros((int(dense.sum()), self.count))
        many = dense[token]
        self.rows[self.row[token[many]], doc[many]] = score[many]
        self.doc, self.score = doc[~many], score[~many]
        self.first = np.concatenate([[0], np.cumsum(np.where(dense, 0, found))])

    def forget(self, used: np.ndarray) -> None:
        """Leave used documents out from now on; they are never an answer."""
        stays = ~used[self.live]
        keep = stays[self.doc]
        self.first = np.concatenate([[0], np.cumsum(keep)])[self.first]
        self.doc, self.score = (np.cumsum(stays) - 1)[self.doc[keep]], self.score[keep]
        self.live, self.rows = self.live[stays], self.rows[:, stays]

    def scores(self, of: int, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unused documents that share a token with one, and how like it they are."""
        if self.count - np.count_nonzero(used) < 0.8 * len(self.live):
            self.forget(used)
        asked = self.asked[self.asked_first[of] : self.asked_first[of + 1]]
        row = self.row[asked]
        chosen = np.zeros(len(self.rows))
        chosen[row[row >= 0]] = 1
        starts = self.first[asked]
        places = places_of(starts, self.first[asked + 1] - starts, len(self.doc))
        total = np.bincount(self.doc[places], self.score[places], len(self.live)) + chosen @ self.rows
        total[used[self.live]] = 0
        # Sums of the same numbers may differ in their last digits.
        total = total.astype(np.float32)
        found = np.flatnonzero(total)
        return self.live[found], total[found]

    def best_first(self, of: int, used: np.ndarray) -> Iterator[int]:
        """The unused documents that share a token with one, most like it first, the first of equal ones before others.
        All are ranked, but the order is made only as far as it is asked for."""
        found, score = self.scores(of, used)
        many = FIRST_RANKED
        while len(found):
            if len(found) > 2 * many:
                best = score >= np.partition(score, -many)[-many]
            else:
                best = np.ones(len(found), bool)
            yield from found[best][np.argsort(-score[best], kind="stable")].tolist()
            found, score, many = found[~best], score[~best], 8 * many

    def neighbours(self, of: int, used: np.ndarray) -> np.ndarray:
        """All of ``best_first``."""
        return np.array(list(self.best_first(of, used)), np.int64)


def pack_shard(documents: list[np.ndarray], weights: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of a shard. Sequences are full but for the last ones,
    whose lengths are powers of two."""
    index = ShardIndex(documents, weights, mean)
    total = sum(map(len, documents))
    room_of = [window] * (total // window)
    room_of += [1 << bit for bit in reversed(range(window.bit_length())) if (total % window) >> bit & 1]
    used = np.zeros(len(documents), bool)
    pieces, sequence, offset, first = [], 0, 0, 0

    def put(at: int) -> bool:
        """Use a document; true if the window it began in is full."""
        nonlocal sequence, offset
        used[at] = True
        start, length, began = 0, len(documents[at]), sequence
        while start < length:
            size = min(length - start, room_of[sequence] - offset)
            pieces.append((at, start, size, sequence, offset))
            start, offset = start + size, offset + size
            if offset == room_of[sequence]:
                sequence, offset = sequence + 1, 0
        return sequence > began

    seed = None
    while True:
        if seed is None:
            while first < len(documents) and used[first]:
                first += 1
            if first == len(documents):
                return pieces
            seed = first
            put(seed)
            if not offset:  # it ends with a window
                seed = None
                continue
        for at in index.best_first(seed, used):
            if put(at):
                # The rest of it opens the next window.
                seed = at if offset else None
                break
        else:
            seed = None  # no other is like it: the window goes on with another seed


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Pack every id of every document: a row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and ids (little-endian unsigned, two bytes if the vocabulary allows, else four).

    Null and empty texts are their end id alone. Repeated rows are packed each; null ids stay null. An empty table gives
    no pieces. Other columns do not matter. Sequences have ``window`` ids, or a power of two below it. Shards are dealt
    by ranges, so copies of one text, however many, spread over many tasks.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    width = WordTokenizer(tokenizer_path).dtype.itemsize
    with small_batches(docs.sparkSession, BATCH_BYTES):
        parts = materialize(encode_parts(docs, tokenizer_path, end_id, doc_id, text))
        weights, mean = token_statistics(parts)
    shared = parts.sparkSession.sparkContext.broadcast((weights, mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mean = shared.value
        sequences = TaskContext.get().partitionId() * _SHARD_IDS
        held: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal sequences
            documents = [np.frombuffer(one[3], f"<u{width}") for one in held]
            pieces = pack_shard(documents, weights, mean, window)
            out: dict[str, list] = {field.name: [] for field in schema}
            for at, start, length, sequence, offset in pieces:
                doc, first, tokens, _ = held[at]
                ids = documents[at][start : start + length]
                values = (doc, first + start, length, zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequences + sequence, offset, ids.tobytes())
                for name, value in zip(out, values):
                    out[name].append(value)
            sequences += pieces[-1][3] + 1
            give_back_memory()
            return pa.RecordBatch.from_pydict(out, schema)

        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                for row in zip(*(column.to_pylist() for column in batch.slice(first, 200).columns)):
                    held.append(row)
                    size += len(row[3]) // width
                    if size >= shard_tokens:
                        yield packed()
                        held, size = [], 0
        if held:
            yield packed()
        held = []
        give_back_memory()

    schema = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())]
    )
    order = ("near", "row", "start")
    dealt = parts.filter("row >= 0").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecweave.llm.settings import END_ID, WORD_TOKENIZER

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, WORD_TOKENIZER, END_ID).drop("ids")
