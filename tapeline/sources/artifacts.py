"""A sink for artifacts: canonical JSON lines that tasks write and that become visible as a whole.

Each task writes a file under a name of its own attempt and reports its rows, bytes and SHA-256. When all tasks are done
the files get their final names, and a manifest that lists them appears last, by rename. A reader takes what the manifest
lists, so an artifact without one does not exist: what a failed or a second attempt of a task leaves is never read, and
is deleted when the job is aborted. An artifact is written once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tapeline.canonical import canonical_id, canonical_json
from tapeline.functions.exact import canonical_row

MANIFEST = "manifest.json"


class ArtifactError(RuntimeError):
    pass


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    size: int
    sha256: str


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") or ":/" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    return pafs.FileSystem.from_uri(path)


class ArtifactDataSource(DataSource):
    """df.write.format("artifact").mode("append").save(path): the first column's texts, a line each."""

    @classmethod
    def name(cls) -> str:
        return "artifact"

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        fs, base = _folder(self.options["path"])
        if fs.get_file_info(f"{base}/{MANIFEST}").is_file:
            raise ArtifactError(f"{base} is there already")
        return ArtifactWriter(self.options["path"])


class ArtifactWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> _Written:
        fs, base = _folder(self.path)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f".part-{context.partitionId():06d}-{context.taskAttemptId()}.tmp"
        digest, rows, size = hashlib.sha256(), 0, 0
        try:
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                for row in iterator:
                    line = f"{row[0]}\n".encode()
                    out.write(line)
                    digest.update(line)
                    rows, size = rows + 1, size + len(line)
        except BaseException:
            fs.delete_file(f"{base}/{name}")
            raise
        return _Written(context.partitionId(), name, rows, size, digest.hexdigest())

    def commit(self, messages: list[_Written | None]) -> None:
        fs, base = _folder(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        listed = []
        for m in done:
            if not m.rows:
                fs.delete_file(f"{base}/{m.name}")
                continue
            name = f"part-{len(listed):06d}.jsonl"
            fs.move(f"{base}/{m.name}", f"{base}/{name}")
            listed.append({"name": name, "rows": m.rows, "bytes": m.size, "sha256": m.sha256})
        manifest = {"files": listed, "rows": sum(f["rows"] for f in listed), "id": canonical_id([f["sha256"] for f in listed])}
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/.{MANIFEST}.tmp", compression=None) as out:
            out.write(canonical_json(manifest).encode())
        fs.move(f"{base}/.{MANIFEST}.tmp", f"{base}/{MANIFEST}")
        _clear(fs, base)

    def abort(self, messages: list[_Written | None]) -> None:
        _clear(*_folder(self.path))


def _clear(fs: pafs.FileSystem, base: str) -> None:
    """Delete what attempts have left; one that still runs may leave a hidden file, which no reader takes."""
    for found in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if found.is_file and found.base_name.startswith(".part-"):
            fs.delete_file(found.path)


def write_artifact(df: DataFrame, path: str, order: Sequence[str] = (), parts: int = 8) -> dict:
    """Write rows as canonical JSON lines, in the given order if there is one, and return the manifest.

    Rows that are ordered in full give the same artifact, and so the same id, wherever its parts are cut alike.
    """
    df.sparkSession.dataSource.register(ArtifactDataSource)
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order) if order else df
    rows.select(canonical_row(df.schema).alias("line")).write.format("artifact").mode("append").save(path)
    return manifest_of(path)


def manifest_of(path: str) -> dict:
    fs, base = _folder(path)
    if not fs.get_file_info(f"{base}/{MANIFEST}").is_file:
        raise ArtifactError(f"no artifact {base}")
    with fs.open_input_stream(f"{base}/{MANIFEST}", compression=None) as f:
        return json.loads(f.read())


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an artifact as `value`; only files that its manifest lists are read."""
    names = [f"{path.rstrip('/')}/{f['name']}" for f in manifest_of(path)["files"]]
    return spark.read.text(names) if names else spark.createDataFrame([], "value string")
