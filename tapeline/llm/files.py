"""Files of the shared folder, written by tasks under temporary names and committed by rename."""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark import TaskContext


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Pending:
    """A file that appears under its name only once commit() is called; a lost attempt leaves none.

    Attempts of one task write to names of their own; the content is the same, so the last rename wins.
    """

    def __init__(self, folder: str, name: str):
        self.fs, base = resolve(folder)
        self.fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        self.path, self.temporary = f"{base}/{name}", f"{base}/.{name}.{attempt}.tmp"
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.path)


def read(folder: str, name: str) -> bytes:
    fs, base = resolve(folder)
    with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
        return stream.read()


def write_manifest(folder: str, entries: list[dict]) -> None:
    """The list of committed files; readers trust the manifest and ignore other files."""
    fs, base = resolve(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/.manifest.tmp") as out:
        out.write(json.dumps({"files": entries}, sort_keys=True).encode())
    fs.move(f"{base}/.manifest.tmp", f"{base}/manifest.json")


def read_manifest(folder: str) -> list[dict]:
    return json.loads(read(folder, "manifest.json"))["files"]
