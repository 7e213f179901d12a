"""Binary files in the shared folder, through pyarrow's file systems (local, hdfs, s3, gs)."""

from __future__ import annotations

import uuid


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make(folder: str) -> None:
    system, path = _open(folder)
    system.create_dir(path, recursive=True)


class Writer:
    """Writes one file under a name of its own and moves it to its place when whole.

    A task that is run again writes the same bytes and moves them over the first.
    """

    def __init__(self, folder: str, name: str) -> None:
        self.system, base = _open(folder)
        self.system.create_dir(base, recursive=True)
        self.place, self.temp = f"{base}/{name}", f"{base}/_{name}.{uuid.uuid4().hex[:8]}"
        self.out = self.system.open_output_stream(self.temp)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Append, and return the offset."""
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.system.move(self.temp, self.place)


class Reader:
    """Range reads of one file at a time."""

    def __init__(self, folder: str) -> None:
        self.system, self.base = _open(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.base}/{name}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name, self.file = None, None
