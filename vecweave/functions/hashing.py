"""Signed feature hashing of texts: a deterministic embedder that needs no model.

Each token adds +1 or -1 to one dimension, both taken from its MD5 digest, and the sums are scaled to length one.
Spark splits the text into tokens; Python digests the different tokens of an Arrow batch once each and adds up the
whole batch. A text never leaves its row, so there is nothing to shuffle, however long or frequent any text is.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecweave.functions.arrow import lengths_of, lists, nested_bytes
from vecweave.functions.text import tokens
from vecweave.schemas import OUTCOME

# Cells of one dense block, and what its texts or tokens take; both bound the memory of a Python worker, not the result.
_BLOCK_CELLS = 4_000_000
_BLOCK_BYTES = 16 << 20


def _signed_cells(words: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of every token: the first 32 bits of the digest, and the last bit of the next hex digit.
    An empty token counts nothing."""
    encoded = words.dictionary_encode()
    different = encoded.dictionary.cast(pa.binary()).to_pylist()
    digests = b"".join([hashlib.md5(word).digest()[:5] for word in different])
    digests = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 5).astype(np.int64)
    cells = (digests[:, :4] @ (256 ** np.arange(3, -1, -1))) % dimension
    signs = np.where(digests[:, 4] & 16, -1.0, 1.0)
    if b"" in different:
        signs[different.index(b"")] = 0
    at = encoded.indices.to_numpy(zero_copy_only=False)
    return cells[at], signs[at]


def _weights(words: pa.Array, dimension: int) -> np.ndarray:
    """Dense sums, one row per list of tokens."""
    rows = np.repeat(np.arange(len(words)), lengths_of(words))
    cells, signs = _signed_cells(words.flatten(), dimension)
    sums = np.bincount(rows * dimension + cells, weights=signs, minlength=len(words) * dimension)
    return sums.reshape(len(words), dimension)


def _vectors(words: pa.Array, dimension: int) -> pa.Array:
    """Unit vectors as array<float>; a text without tokens gives zeros."""
    blocks = []
    step = max(1, _BLOCK_CELLS // dimension)
    for start in range(0, len(words), step):
        sums = _weights(words.slice(start, step), dimension)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        norms[norms == 0] = 1
        blocks.append(pa.array((sums / norms).astype(np.float32).ravel()))
    flat = pa.concat_arrays(blocks) if blocks else pa.array([], pa.float32())
    return lists(np.full(len(words), dimension), flat)


def _cuts(batch: pa.Array, cells: np.ndarray) -> Iterator[pa.Array]:
    """Cut a batch of lists so that a piece has about one dense block of ``cells`` and its texts are bounded, too."""
    if not len(batch):
        return
    totals = [(np.cumsum(cells), _BLOCK_CELLS), (np.cumsum(nested_bytes(batch)), _BLOCK_BYTES)]
    start = 0
    while start < len(batch):
        ends = [np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right") for total, most in totals]
        end = max(int(min(ends)), start + 1)
        yield batch.slice(start, end - start)
        start = end


def pieces(batch: pa.Array, dimension: int) -> Iterator[pa.Array]:
    """Cut a batch of text lists so that neither the vectors of a piece nor its texts take more than a fixed size, one
    row excepted."""
    return _cuts(batch, lengths_of(batch) * dimension)


def hashed_vectors(texts: str, dimension: int, refuse_null: bool = False) -> Column:
    """SQL of an array<string> -> array of outcomes, one per text. A null text has no vector, or, with ``refuse_null``,
    stops the job."""

    @F.arrow_udf(f"array<{OUTCOME}>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in pieces(batch, dimension):
                started = time.perf_counter()
                words = piece.flatten()
                missing = words.is_null()
                if refuse_null and missing.true_count:
                    raise ValueError("text is null")
                vectors = _vectors(words, dimension)
                error = pc.if_else(missing, "text is null", pa.scalar(None, pa.string()))
                if missing.true_count:
                    vectors = pc.if_else(missing, pa.scalar(None, vectors.type), vectors)
                millis = (time.perf_counter() - started) * 1000 / max(len(words), 1)
                outcomes = pa.StructArray.from_arrays(
                    [vectors, error, pa.array(np.full(len(words), millis))],
                    ["embedding", "error", "millis"],
                )
                yield lists(lengths_of(piece), outcomes)

    return embed.asNondeterministic()(F.expr(f"transform({texts}, text -> {tokens('text')})"))


def hashed_weights(text: str, dimension: int) -> Column:
    """SQL of a string -> array<int>: the sums before scaling, for inspection."""

    @F.arrow_udf("array<int>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in _cuts(batch, np.full(len(batch), dimension)):
                sums = _weights(piece, dimension).astype(np.int32)
                yield lists(np.full(len(piece), dimension), pa.array(sums.ravel()))

    return weigh.asNondeterministic()(F.expr(tokens(text)))
