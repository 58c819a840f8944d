"""WARC archives: a deterministic sharded writer and its reader.

Records are dealt to shards of consecutive ids and about equal size, a task each, and sorted, so the same rows give the same files however
often a task runs. A shard rolls to its next file once the compressed size passes `FILE_BYTES`. Every
record is a gzip member of its own with regenerated headers: record ids and dates follow from the row,
lengths and digests from the payload. Of payloads of at least `least` bytes that are equal, the record with
the largest id keeps the payload and the others become revisits of it. Files are written under temporary
names, renamed when whole, and count once the manifest names them.

Null pages have an empty payload; null URLs get a URN as target. If rows repeat the largest id of equal
payloads, all of them are responses. Rows without an id are left out; columns beyond id, url and html are
ignored. An empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import common, files, ranges

#: Compressed bytes after which a shard begins its next file.
FILE_BYTES = 64 << 20
#: Payloads shorter than this are always stored.
LEAST_REVISIT = 1000
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"

_MASK = (1 << 64) - 1


def _record_id(page_id: int, digest: bytes) -> str:
    """A URN whose high half follows from the payload and whose low half is the page's id."""
    return f"<urn:uuid:{uuid.UUID(int=int.from_bytes(digest[:8]) << 64 | page_id & _MASK)}>"


def _page_id(urn: str) -> int:
    low = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int & _MASK
    return low - (1 << 64) if low >> 63 else low


def _sha1(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _target(page_id: int, url: str | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if " " < c < "\x7f" or c > "\xa0" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record's bytes, uncompressed; a revisit carries the HTTP head but no payload."""
    digest = hashlib.sha1(payload).digest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_target(page_id, url)}",
        f"WARC-Payload-Digest: {_sha1(digest)}",
        f"WARC-Block-Digest: {_sha1(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file; raises ValueError where a digest or length is wrong."""
    rest = b""
    while True:
        rest = rest or stream.read(1 << 20)
        if not rest:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data if unpacker.eof else stream.read(1 << 20)
            if not rest and not unpacker.eof:
                raise ValueError("the file ends within a record")
        head, _, tail = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = tail[: int(headers["Content-Length"])]
        if lines[0] != "WARC/1.1" or tail[len(block) :] != b"\r\n\r\n" or _sha1(hashlib.sha1(block).digest()) != headers["WARC-Block-Digest"]:
            raise ValueError(f"broken record {headers.get('WARC-Record-ID')}")
        yield headers, block


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> None:
    """Write all pages as WARC files below folder, then the manifest."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.where("page_id is not null")
    long = rows.where(F.octet_length("payload") >= least).select("page_id", F.sha1("payload").alias("digest"))
    last = common.stage(long.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last"), "last")
    revisits = common.stage(long.join(last, "digest").where("page_id <> last").select("page_id", "digest", "last"), "revisits")

    starts = ranges.bounds(rows, "page_id", F.octet_length("payload") + 64)
    both = revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "last", F.lit(0).alias("kind"))
    both = both.unionByName(rows.select("*", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("last"), F.lit(1).alias("kind")))
    dealt = ranges.deal(both.withColumn("shard", ranges.shard_of(starts)("page_id")), starts).sortWithinPartitions("shard", "page_id", "kind", "url")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in common.slices(batches, "payload") for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "payload", "digest", "last", "kind")), strict=True))
        for shard, some in itertools.groupby(flat, key=lambda r: r[0]):
            out, part, first, count, known, at = None, 0, None, 0, {}, None
            for _, page_id, url, payload, digest, target, kind in some:
                if page_id != at:
                    at, known = page_id, {}
                if not kind:
                    known[digest] = target
                    continue
                if out is None:
                    name = f"pages-{shard:06d}-{part:04d}.warc.gz"
                    out, first, count = files.Pending(folder, name), page_id, 0
                out.write(_member(record(page_id, url, payload, known.get(hashlib.sha1(payload).hexdigest()) if known else None)))
                count += 1
                if out.size >= FILE_BYTES:
                    out.commit()
                    yield _entry(name, first, page_id, count, out.size)
                    out, part = None, part + 1
            if out is not None:
                out.commit()
                yield _entry(name, first, at, count, out.size)

    made = dealt.mapInArrow(pack, "name string, first_id long, last_id long, n_records long, n_bytes long")
    files.write_manifest(folder, sorted((r.asDict() for r in made.collect()), key=lambda r: r["name"]))  # a row for each file


def _entry(name: str, first: int, last: int, count: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"name": [name], "first_id": [first], "last_id": [last], "n_records": [count], "n_bytes": [size]})


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type and refers_to of every record in the files."""
    entries = files.read_manifest(folder)
    listed = spark.createDataFrame([(e["name"], e["n_bytes"], e["n_records"]) for e in entries], "name string, n_bytes long, n_records long")
    listed = listed.repartition(max(1, min(len(entries), 4 * common.partitions(spark))))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, _, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out: list[tuple] = []
                fs, base = files.resolve(folder)
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
                        kind, target = headers["WARC-Type"], headers.get("WARC-Refers-To")
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
                            raise ValueError(f"{name}: broken payload of {headers['WARC-Record-ID']}")
                        out.append((_page_id(headers["WARC-Record-ID"]), size, digest.hex(), kind, _page_id(target) if target else None))
                if len(out) != count:
                    raise ValueError(f"{name}: {len(out)} records, {count} in the manifest")
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return listed.mapInArrow(unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
