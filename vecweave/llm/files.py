"""Binary files of ids in the shared folder of the cluster, written and read inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from vecweave.sources.files import NewFile, located, read_all
from vecweave.sources.storage import new_path

__all__ = ["NewFile", "little", "new_folder", "read_all", "read_range"]


def new_folder(spark: SparkSession) -> str:
    """A folder of one run, among what the application has written on the way."""
    return new_path(spark)


def read_range(uri: str, start: int, length: int) -> bytes:
    system, path = located(uri)
    with system.open_input_file(path) as file:
        file.seek(start)
        return file.read(length)


def little(values: np.ndarray, kind: str) -> bytes:
    """Values as little-endian numbers."""
    return np.ascontiguousarray(values, dtype=np.dtype(kind).newbyteorder("<")).tobytes()
