"""Files that tasks write and read themselves, in a folder that all executors reach.

The folder may be on any file system that ``pyarrow.fs`` knows by its address. A file appears under its own name only
when it is whole, so a task that is tried again, or twice at a time, leaves no half-written file.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


class NewFile:
    """A file that appears when it is closed."""

    def __init__(self, uri: str):
        self.uri = uri
        self._system, self._path = located(uri)
        folder, _, name = self._path.rpartition("/")
        self._system.create_dir(folder, recursive=True)
        self._hidden = f"{folder}/.{name}.{uuid.uuid4()}"
        self._stream = self._system.open_output_stream(self._hidden)

    def write(self, data) -> None:
        self._stream.write(data)

    def close(self) -> None:
        self._stream.close()
        self._system.move(self._hidden, self._path)


def read_all(uri: str) -> bytes:
    system, path = located(uri)
    with system.open_input_file(path) as file:
        return file.read()


def move(uri: str, to: str) -> None:
    """Give a file another name, in place of what has that name."""
    system, path = located(uri)
    target = located(to)[1]
    system.create_dir(target.rpartition("/")[0], recursive=True)
    system.move(path, target)
