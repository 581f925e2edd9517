"""Arrow arrays of lists and outcomes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What a text takes besides its bytes, as an object or as numbers about a token.
_TEXT_BYTES = 48


def lengths_of(lists: pa.Array) -> np.ndarray:
    """Length of every list; zero for a null one."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def nested_bytes(batch: pa.Array) -> np.ndarray:
    """What the texts of every row of (lists of) lists of texts take: their bytes, and a fixed size for each."""
    ends, values = batch.offsets.to_numpy(), batch.values
    while len(values) and (pa.types.is_list(values.type) or pa.types.is_large_list(values.type)):
        ends, values = values.offsets.to_numpy()[ends], values.values
    if not len(values):
        # The offsets of an empty array may be missing.
        return np.zeros(len(batch), np.int64)
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    offsets = np.frombuffer(values.buffers()[1], kind)[values.offset :]
    return np.diff(offsets[ends].astype(np.int64)) + _TEXT_BYTES * np.diff(ends.astype(np.int64))


def lists(lengths: np.ndarray, values: pa.Array, missing: np.ndarray | None = None) -> pa.ListArray:
    """``values`` cut into lists of the given lengths; null where ``missing``."""
    ends = np.cumsum(lengths, dtype=np.int64)
    if len(ends) and ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError(f"{ends[-1]} values do not fit one array of lists")
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    mask = None if missing is None else pa.array(missing)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def outcome_array(
    vectors: Sequence[np.ndarray | None], errors: Sequence[str | None], millis: Sequence[float]
) -> pa.StructArray:
    """Outcomes of texts, one each."""
    given = [vector for vector in vectors if vector is not None]
    values = np.concatenate(given) if given else np.zeros(0, dtype=np.float32)
    sizes = np.array([0 if vector is None else len(vector) for vector in vectors], dtype=np.int64)
    missing = np.array([vector is None for vector in vectors], dtype=bool)
    return pa.StructArray.from_arrays(
        [
            lists(sizes, pa.array(values, pa.float32()), missing),
            pa.array(errors, pa.string()),
            pa.array(millis, pa.float64()),
        ],
        ["embedding", "error", "millis"],
    )
