"""SimHash near duplicates found by multi-index hashing.

A document's fingerprint has 64 bits; a bit is set if it is set in over half the XXH64 hashes of the document's
word shingles (words are runs without ASCII white space, A-Z lower-cased; repeats count; fewer words than a
shingle are one shingle). Two documents link if their fingerprints differ in at most `distance` bits.

A fingerprint is cut into so many segments that two linked ones differ in at most one bit of some segment. Each
distinct fingerprint enters its segments into a table and probes it with the small Hamming ball around them. Of two
segments that differ in one bit just one has it set, so clearing set bits is enough. What meets in a bucket is
verified over all bits.

A bucket yields a forest of its links, not all its pairs. Segments held by more than HOT fingerprints are found by a
count beforehand; the buckets they can reach are dealt once more, by segments of the bits that are left, so that no
task gathers a hot bucket. Components of all links follow by label propagation.

Null and empty texts and texts without words have fingerprint zero, which links like any other. Rows that repeat an
id are one document: each row keeps its fingerprint, and links of one are links of all. Rows without an id are left
out. Only id and text are read, so other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common
from tapeline.llm.components import components

WORDS = 3
DISTANCE = 3
SEED = 42
#: Fingerprints that may hold one segment before the buckets around it are dealt once more.
HOT = 256
#: Buckets up to which the list of hot ones is broadcast (below 30 bytes each); a longer list is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20
#: Both marks of a bucket row: its segment is its own at the first and at the second dealing.
OWN = 3


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about PIECE bytes at a time."""
    low = 0
    while low < len(raw):
        high = min(len(raw), low + PIECE)
        while high < len(raw) and raw[high : high + 1].strip():
            high += 1
        yield raw[low:high].lower().split()  # bytes: only A-Z are lower-cased, and only ASCII white space separates
        low = high


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for piece in _pieces(raw):
        tail += piece
        if len(tail) >= words:
            hashes = _hashes(tail, words)
            ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
            tail = tail[len(tail) - words + 1 :]
    if not total and tail:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, *, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (a long with these 64 bits) of every row that has an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            data, at = common.utf8(batch.column(1))
            raw = data.tobytes()
            found = np.array([fingerprint(raw[a:b], words) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return common.rows_in(documents, id_col, text_col).mapInArrow(common.tidy(run), "doc_id long, fingerprint long")


def segments(width: int, distance: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of segments of which one has at most one bit changed if `distance` bits of all are."""
    edges = np.linspace(0, width, (distance + 2) // 2 + 1).astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def ball(keys: np.ndarray, bits: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, keys and whether they are the keys themselves: each key, then each with one of its set bits cleared."""
    n = len(keys)
    if not distance:
        return np.arange(n), keys, np.ones(n, bool)
    row, bit = np.nonzero((keys[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1))
    return np.append(np.arange(n), row), np.append(keys, keys[row] ^ (np.uint64(1) << bit.astype(np.uint64))), np.append(np.ones(n, bool), np.zeros(len(row), bool))


def _cut(values: np.ndarray, low: int, bits: int) -> np.ndarray:
    return (values >> np.uint64(low)) & np.uint64((1 << bits) - 1)


def _table(prints: DataFrame, distance: int) -> DataFrame:
    """Every distinct fingerprint in the buckets (segment, key) of its segments and of the balls around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for segment, (low, bits) in enumerate(segments(64, distance)):
                row, key, own = ball(_cut(prints, low, bits), bits, distance)
                columns = [np.full(len(row), segment, np.int32), key.view(np.int64), np.where(own, OWN, 2).astype(np.int32), prints[row].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["segment", "key", "own", "print"])

    return prints.select("fingerprint").mapInArrow(run, "segment int, key long, own int, print long")


def _dealt_again(rows: DataFrame, distance: int) -> DataFrame:
    """Rows of hot buckets in buckets (segment, key, part, rest) by the bits beside the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = segments(64, distance)
        for batch in batches:
            segment, key, own, prints = (c.to_numpy() for c in batch.columns)
            prints = prints.view(np.uint64)
            for s, (low, bits) in enumerate(cuts):
                here = np.flatnonzero(segment == s)
                high = prints[here] >> np.uint64(low + bits) if low + bits < 64 else np.zeros(len(here), np.uint64)
                left = (high << np.uint64(low)) | _cut(prints[here], 0, low)
                for part, (at, width) in enumerate(segments(64 - bits, distance)):
                    row, rest, itself = ball(_cut(left, at, width), width, distance)
                    marks = (own[here][row] & 1) | np.where(itself, 2, 0)
                    columns = [segment[here][row], key[here][row], np.full(len(row), part, np.int32), rest.view(np.int64), marks.astype(np.int32), prints[here][row].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["segment", "key", "part", "rest", "own", "print"])

    return rows.select("segment", "key", "own", "print").mapInArrow(run, "segment int, key long, part int, rest long, own int, print long")


def forest(prints: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what links of the given fingerprints connect, less than one for each."""
    a, b, left = [], [], prints
    while len(left) > 1:
        reached, left = [left[:1]], left[1:]
        while reached and len(left):
            for x in reached.pop():
                near = np.bitwise_count(left ^ x) <= distance
                if near.any():
                    found, left = left[near], left[~near]
                    a.append(np.full(len(found), x))
                    b.append(found)
                    reached.append(found)
    return a, b


def _links(rows: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between fingerprints of a bucket; rows: the columns that name a bucket, then own and print."""
    named = rows.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            columns = [np.concatenate(c) for c in zip(rest, columns, strict=True)] if rest else columns
            if not len(columns[0]):
                continue
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:-2]])) + 1
            last = int(change[-1]) if len(change) else 0  # the last bucket may go on in the next batch
            rest = [c[last:] for c in columns]
            if last:
                yield found([c[:last] for c in columns], np.append(0, change[:-1]))
        if rest:
            yield found(rest, np.zeros(1, np.int64))

    def found(columns: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        own, prints = columns[-2], columns[-1].view(np.uint64)
        ends = np.append(starts[1:], len(own))
        good = (ends - starts > 1) & (np.bitwise_or.reduceat(own, starts) == OWN)
        two = good & (ends - starts == 2)
        x, y = prints[starts[two]], prints[starts[two] + 1]
        near = np.bitwise_count(x ^ y) <= distance
        a, b = [x[near]], [y[near]]
        for low, high in zip(starts[good & ~two].tolist(), ends[good & ~two].tolist(), strict=True):
            more = forest(prints[low:high], distance)
            a += more[0]
            b += more[1]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (a, b)], ["a", "b"])

    n = common.partitions(rows.sparkSession)
    return rows.repartition(n, *named).sortWithinPartitions(*named).mapInArrow(common.tidy(run), "a long, b long")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of `prints` as all links within `distance` bits would."""
    if not 0 <= distance <= 7:
        raise ValueError("distance: 0 to 7 bits")
    cuts = segments(64, distance)
    own = F.array(*[F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1)).alias("key")) for s, (low, bits) in enumerate(cuts)])
    heavy = prints.select(F.explode(own).alias("k")).groupBy("k").count().where(F.col("count") > HOT)
    cleared = F.transform(F.sequence(F.lit(0), F.lit(max(bits for _, bits in cuts) - 1)), lambda i: F.col("k.key").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    reach = F.array_distinct(F.concat(F.array("k.key"), cleared)) if distance else F.array("k.key")
    hot = common.stage(heavy.select("k.segment", F.explode(reach).alias("key")).distinct(), "hot")
    many = hot.count()
    table = _table(prints, distance)
    if not many:
        return _links(table, distance)
    marked = common.stage(table.join((F.broadcast if many <= BROADCAST_ROWS else lambda df: df)(hot.withColumn("hot", F.lit(True))), ["segment", "key"], "left"), "table")
    columns = ["segment", "key", "own", "print"]
    return _links(marked.where("hot is null").select(*columns), distance).unionByName(_links(_dealt_again(marked.where("hot"), distance), distance))


def near_duplicates(documents: DataFrame, *, words: int = WORDS, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits) and component_id of every row that has an id.

    component_id is the smallest id that can be reached by links, the row's own included.
    """
    since = common.staged_so_far()
    prints = common.stage(fingerprints(documents, words=words, id_col=id_col, text_col=text_col), "prints")
    nodes = common.stage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes")
    repeated = prints.groupBy("doc_id").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("high")).where("a < high").select("doc_id", "a")
    same_id = prints.join(repeated, "doc_id").where("a < fingerprint").select("a", F.col("fingerprint").alias("b"))
    labels = components(common.stage(reduce(DataFrame.unionByName, [links(nodes, distance), same_id]).distinct(), "links"))
    named = nodes.join(labels, nodes["fingerprint"] == labels["node"], "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("group"))
    smallest = named.groupBy("group").agg(F.min("first").alias("component_id"))
    linked = common.stage(named.join(smallest, "group").select("fingerprint", "component_id"), "linked")
    common.sweep(since, prints, linked)
    out = prints.join(linked, "fingerprint")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
