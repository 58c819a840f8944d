"""Token-ID output: documents as Simple-8b files in ascending id order, and their reader.

Documents are dealt to shards of consecutive ids of about equal size, a task each; a shard rolls to its next
file after `FILE_IDS` ids, so a task holds no more than a file and one document. A file has a header, the
documents' ids and offsets, the blocks' word offsets and the words. Files appear by rename and count once the manifest names them, so a lost
executor's half-written file is never read; a repeated task writes the same bytes again.

Null and empty texts give the end id alone. Repeated ids keep all their rows, ordered by text. Rows
without an id are left out, as is every column but id and text. An empty table gives an empty manifest.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import common, files, ranges, simple8b, tokens

MAGIC = b"TPLIDS01"
_HEADER = struct.Struct("<8sQQQQI4x")
#: Ids after which a shard begins its next file.
FILE_IDS = 8 << 20


def pack(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes; ends[i] is the offset behind document i in ids."""
    words, starts = simple8b.encode(ids)
    body = b"".join(x.astype(t).tobytes() for x, t in ((doc_ids, "<i8"), (ends, "<u8"), (starts, "<u8"), (words, "<u8")))
    return _HEADER.pack(MAGIC, len(doc_ids), len(ids), len(starts), len(words), zlib.crc32(body)) + body


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What pack() was given; raises ValueError if the bytes are not whole."""
    magic, n_docs, n_ids, n_starts, n_words, crc = _HEADER.unpack_from(data)
    body = memoryview(data)[_HEADER.size :]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("not a whole token file")
    at, out = 0, []
    for n, kind in ((n_docs, "<i8"), (n_docs, "<u8"), (n_starts, "<u8"), (n_words, "<u8")):
        out.append(np.frombuffer(body, kind, n, at))
        at += 8 * n
    return out[0], out[1], simple8b.decode(out[3], out[2], n_ids)


def write(documents: DataFrame, folder: str, tokenizer: str, end: int, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write one file for each range of ids, then the manifest."""
    docs = common.rows_in(documents, id_col, text_col)
    starts = ranges.bounds(docs, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 16)
    dealt = ranges.deal(docs.withColumn("shard", ranges.shard_of(starts)("doc_id")), starts).sortWithinPartitions("shard", "doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.encoder(tokenizer)
        pieces = (run for batch in common.slices(batches) for run in _runs(batch))
        for shard, parts in itertools.groupby(pieces, key=lambda x: x[0]):
            part, held, size = 0, [], 0
            for _, some in parts:
                ids, at = words.encode_all(some.column("text").to_pylist(), end)
                held.append((some.column("doc_id").to_numpy(), np.diff(at), ids.astype(np.uint32)))
                size += len(ids)
                if size >= FILE_IDS:
                    yield _write_file(folder, shard, part, held)
                    part, held, size = part + 1, [], 0
            if held:
                yield _write_file(folder, shard, part, held)

    made = dealt.mapInArrow(encode, "shard long, part long, name string, n_docs long, n_ids long, n_bytes long")
    entries = sorted((r.asDict() for r in made.collect()), key=lambda r: (r["shard"], r["part"]))  # a row for each file
    at = 0
    for entry in entries:
        entry["start"] = at
        at += entry["n_ids"]
    files.write_manifest(folder, entries)


def _write_file(folder: str, shard: int, part: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Write one file and describe it."""
    doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
    out = files.Pending(folder, name := f"tokens-{shard:06d}-{part:04d}.s8b")
    out.write(pack(doc_ids, np.cumsum(lengths), ids))
    out.commit()
    return pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "name": [name], "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "n_bytes": [out.size]})


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Consecutive rows of one shard each."""
    shard = batch.column("shard").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    for a, b in itertools.pairwise(cuts):
        yield int(shard[a]), batch.slice(a, b - a)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    entries = files.read_manifest(folder)
    schema = "name string, start long, n_bytes long"
    listed = spark.createDataFrame([(e["name"], e["start"], e["n_bytes"]) for e in entries], schema)
    listed = listed.repartition(max(1, min(len(entries), 4 * common.partitions(spark))))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = files.read(folder, name)
                if len(data) != size:
                    raise ValueError(f"{name}: {len(data)} bytes, {size} in the manifest")
                doc_ids, ends, ids = unpack(data)
                at = np.concatenate([[0], ends.astype(np.int64)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in itertools.pairwise(at.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.astype(np.int64)), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return listed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
