"""Jaccard self-join of documents on word shingles by rare-first prefix filtering.

Two documents link if 100 * shared >= percent * united shingles. The steps:

1. Every document's set of hashed shingles gets its size and a fingerprint; equal sets form a class and
   take part further on as one.
2. The corpus frequency of every shingle is counted: batches of documents send their shingles to ranges of
   hashes as packed blocks, which come back with the frequencies of those that occur twice.
3. In rare-first order (frequency in powers of two, then hash) a document must share one of its first
   n - ceil(t * n) + 1 shingles with any partner. Shingles that occur once lead that order and link nothing,
   so only documents whose shingles are mostly repeated go on, with their repeated prefix.
4. Pairs that share a prefix shingle pass the length, positional and suffix filters and are verified once.
   Documents already joined by verified links are not compared again: first a few pairs per document are
   verified (with the member of a shingle's documents whose shingles are the most common, which sits amid a
   group of near copies, and with neighbours), then pairs that would span a shingle's components, and at
   last all pairs across the components so found. A parity
   sketch of each set bounds the symmetric difference of a pair from below before it is verified. Shingles
   shared by very many documents are dealt in blocks. Thus a group of near copies costs links in proportion
   to its size, and no link between components is lost.

Documents with fewer words than a shingle are one shingle; null and empty texts link with nothing and are
their own component. Rows that repeat an id are one document: each gets a result, and if their texts differ,
links of one are links of all (a row without words stays alone). Rows without an id are left out. Only id
and text are read. Documents that are themselves the outcome of a shuffle should be written as a table first: batches are
named by partition and place, which a recomputed shuffle may fill in another order.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common
from tapeline.llm.components import components
from tapeline.llm.suffix_dedup import span_hashes

WORDS = 5
PERCENT = 75
#: Bytes of text whose shingles travel in one set of blocks; a block's document numbers are 16 bits wide.
BLOCK_BYTES = 4 << 20
#: Prefix shingles of a document used for the first links.
FIRST = 3
#: Bits of the parity sketch.
SKETCH = 512
#: Members of one shingle in a block; two blocks are compared at a time.
DEALT = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, sorted within each, and the documents' offsets into them."""
    docs = len(at) - 1
    data = _LOWER[data]
    gap = _SPACE[data]
    begins, ends = ~gap, ~gap
    begins[1:] &= gap[:-1]
    ends[:-1] &= gap[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = ~gap[inner]
    ends[inner - 1] = ~gap[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    word = span_hashes(data, first, last - first) if len(first) else np.empty(0, np.uint64)
    bounds = np.searchsorted(first, at, "left")
    counts = np.diff(bounds)
    grams = common.mix(common.gram_hashes(word, words))
    n = np.maximum(counts - words + 1, 0)
    doc = np.repeat(np.arange(docs), n)
    hashes = grams[common.lane_concat(bounds[:-1], n)] if len(doc) else np.empty(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        whole = [common.mix(common.gram_hashes(word[bounds[d] : bounds[d + 1]], int(counts[d])) + np.uint64(int(counts[d])))[0] for d in short]
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, np.array(whole, np.uint64)])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[fresh], hashes[fresh]
    return hashes, np.searchsorted(doc, np.arange(docs + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, bytes of equal weight together, so that sorted values compress."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return raw[:, :width].T.tobytes()


def _values(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _token(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 48 bits of each hash that follow the `bits` of its range."""
    return (hashes << np.uint64(bits)) >> np.uint64(16)


def _hash(tokens: np.ndarray, of_range: int, bits: int) -> np.ndarray:
    """The leading bits (64 at most) of the hashes that _token cut."""
    return ((tokens << np.uint64(16)) >> np.uint64(bits)) | np.uint64(of_range << (64 - bits))


_BLOCKS = pa.schema(
    [("range", pa.int32()), ("batch", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("f1", pa.binary()), ("f2", pa.binary())]
)
_BLOCKS_DDL = "range int, batch long, tokens binary, docs binary, ids binary, sizes binary, f1 binary, f2 binary"


def _blocks(documents: DataFrame, words: int, bits: int) -> DataFrame:
    """Shingles by range of hashes: range, batch, tokens, docs (16 bits); range 0 has what names the batch's documents.

    A batch is named by its partition and its running number there, so no two batches share a name.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smaller = (b.slice(i, 60_000) for b in common.slices(batches, most=BLOCK_BYTES) for i in range(0, b.num_rows, 60_000))
        first = TaskContext.get().partitionId() << 32
        for name, batch in enumerate(smaller, first):
            hashes, at = shingle_sets(*common.utf8(batch.column(1)), words)
            ids, n = batch.column(0).to_numpy().astype(np.int64), np.diff(at)
            f1, f2 = _sums(common.mix(hashes), at), _sums(common.mix(hashes ^ common.BASE), at)
            doc = np.repeat(np.arange(len(ids)), n).astype(np.uint64)
            order = np.argsort(hashes, kind="stable")
            hashes, doc = hashes[order], doc[order]
            tokens = _token(hashes, bits)
            edges = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
            named = (ids.tobytes(), n.astype("<u4").tobytes(), f1.tobytes(), f2.tobytes())
            rows = [
                (r, name, _planes(tokens[a:b], 6), _planes(doc[a:b], 2), *(named if r == 0 else (b"",) * 4))
                for r, (a, b) in enumerate(itertools.pairwise(edges.tolist()))
                if b > a or r == 0
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _BLOCKS.types, strict=True)], schema=_BLOCKS)

    return documents.mapInArrow(common.tidy(send), _BLOCKS_DDL)


def _frequent(blocks: DataFrame) -> DataFrame:
    """The same rows with only the shingles that occur in two documents, and the binary logarithm of how many."""
    schema = _BLOCKS.append(pa.field("rare", pa.binary()))

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        tokens = [_values(r["tokens"], 6) for r in rows]
        ends = np.cumsum([0, *(len(t) for t in tokens)]).tolist()
        tokens = np.concatenate(tokens)
        order = np.argsort(tokens, kind="stable")
        head = np.ones(len(order), bool)
        head[1:] = tokens[order[1:]] != tokens[order[:-1]]
        times = np.bincount(np.cumsum(head) - 1) if len(order) else np.empty(0, np.int64)
        per = np.empty(len(order), np.int64)
        per[order] = np.repeat(times, times)
        out = []
        for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True):
            keep = per[a:b] > 1
            if keep.any() or r["ids"]:
                rare = np.ceil(np.log2(np.maximum(per[a:b][keep], 1))).astype(np.uint8)
                out.append(r | {"tokens": _planes(tokens[a:b][keep], 6), "docs": _planes(_values(r["docs"], 2)[keep], 2), "rare": rare.tobytes()})
        return pa.Table.from_pylist(out, schema)

    return blocks.groupBy("range").applyInArrow(count, f"{_BLOCKS_DDL}, rare binary")


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a partner must share at least: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def _gathered(frequent: DataFrame, percent: int, bits: int) -> DataFrame:
    """Every document: doc_id, n, f1 and f2 (a fingerprint of its set).

    Those that can have a partner also have tokens (repeated shingles, rare first), common (their mean
    frequency) and sketch.
    """
    ddl = "doc_id long, n long, f1 long, f2 long, tokens array<long>, common long, sketch binary"

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        names = next(r for r in rows if r["range"] == 0)
        ids, f1, f2 = (pa.array(np.frombuffer(names[c], np.int64)) for c in ("ids", "f1", "f2"))
        n = np.frombuffer(names["sizes"], "<u4").astype(np.int64)
        tokens = np.concatenate([_hash(_values(r["tokens"], 6), r["range"], bits) for r in rows])
        docs = np.concatenate([_values(r["docs"], 2) for r in rows]).astype(np.int64)
        rare = np.concatenate([np.frombuffer(r["rare"], np.uint8) for r in rows])
        have = np.bincount(docs, minlength=len(n))
        good = (have >= needed(n, percent)) & (n > 0)
        keep = good[docs]
        tokens, docs, rare = tokens[keep], docs[keep], rare[keep]
        order = np.lexsort((tokens, rare, docs))
        ends = np.append(0, np.cumsum(np.where(good, have, 0))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~good, False)), pa.array(tokens[order].view(np.int64)))
        mean = np.bincount(docs, rare, len(n)) / np.maximum(have, 1) * 1000
        sketch = pa.array([s if g else None for s, g in zip(sketches(tokens, docs, len(n)), good, strict=True)], pa.binary())
        return pa.Table.from_arrays([ids, pa.array(n), f1, f2, lists, pa.array(mean.astype(np.int64), mask=~good), sketch], ["doc_id", "n", "f1", "f2", "tokens", "common", "sketch"])

    return frequent.groupBy("batch").applyInArrow(gather, ddl)


def sketches(tokens: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """For each of n documents, whether an odd number of its tokens falls on each of SKETCH places, as bytes.

    Two sketches differ in no more places than the sets differ in tokens.
    """
    cells = np.zeros(n * SKETCH, np.uint8)
    np.bitwise_xor.at(cells, docs * SKETCH + (common.mix(tokens) % np.uint64(SKETCH)).astype(np.int64), 1)
    packed = np.packbits(cells.reshape(n, SKETCH), axis=1)
    out = np.empty(n, object)
    out[:] = [row.tobytes() for row in packed]
    return out


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 2) -> int:
    """At most so many values are shared by two sorted arrays: both are cut at a probe and the parts bounded."""
    if not len(a) or not len(b):
        return 0
    if not depth:
        return min(len(a), len(b))
    probe = b[len(b) // 2]
    i, j = np.searchsorted(a, probe), len(b) // 2
    return suffix_bound(a[:i], b[:j], depth - 1) + suffix_bound(a[i:], b[j:], depth - 1)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, and the shingles they share."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            at, bt = batch.column(4), batch.column(5)
            for i, (a, b, an, bn) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                x, y = np.sort(at[i].values.to_numpy()), np.sort(bt[i].values.to_numpy())
                least = -(-percent * (an + bn) // (100 + percent))  # shared / (an + bn - shared) reaches the threshold
                if suffix_bound(x, y) >= least:
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if shared >= least:
                        got.append((a, b, shared))
            columns = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "shared"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "an", "bn", "at", "bt")
    return joined.mapInArrow(common.tidy(check), "a long, b long, shared long")


def _first_pairs(sets: DataFrame) -> DataFrame:
    """A few pairs for each set among those of its first prefix shingles: with the most common one, the first and the largest."""
    few = sets.select("node", "n", "common", F.explode(F.slice("prefix", 1, FIRST)).alias("t")).select("node", "n", "common", F.col("t.token").alias("token"))
    best = few.groupBy("token").agg(
        F.max(F.struct("common", "node")).alias("centre"),
        F.min("node").alias("first"),
        F.max(F.struct("n", "node")).alias("large"),
        F.count("*").alias("many"),
    ).where("many > 1")
    # staged, so that the join's shuffles are its own and a shingle of many sets can be split among tasks
    joined = few.join(common.stage(best.select("token", F.array("centre.node", "first", "large.node").alias("others")), "first"), "token")
    pairs = joined.select(F.explode("others").alias("other"), "node").where("other <> node")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


class _Groups:
    """Disjoint groups of labels."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _cells(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of each prefix shingle that lies in several components, dealt to cells (token, i, j) in which they meet.

    The members of a shingle's largest component never meet one another: blocks of them meet blocks of the
    others, and blocks of the others meet each other. A cell holds two blocks of about DEALT members.
    """
    named = sets.select("node", "n", "prefix").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    places = common.stage(named.select("node", "n", "component", F.explode("prefix").alias("t")).select("node", "n", "component", "t.*"), "places")
    mixed = places.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    counts = places.join(mixed, "token", "left_semi").groupBy("token", "component").agg(F.count("*").alias("many"))
    shapes = counts.groupBy("token").agg(F.max(F.struct("many", "component")).alias("largest"), F.sum("many").alias("all"))
    blocks = lambda many: F.ceil(many / DEALT).cast("int")
    shapes = shapes.select("token", F.col("largest.component").alias("major"), blocks(F.col("all") - F.col("largest.many")).alias("minors"), blocks(F.col("largest.many")).alias("majors"))
    open_places = places.join(common.stage(shapes, "shapes"), "token")
    dealt = F.xxhash64("node")
    major = F.col("component") == F.col("major")
    block = F.when(major, F.col("minors") + F.pmod(dealt, F.col("majors"))).otherwise(F.pmod(dealt, F.col("minors"))).cast("int")
    last = F.when(major, F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1
    meets = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))
    columns = ["n", "component", "place", "block", "alone", "sketch"]
    sketched = sets.select("node", (F.col("n") - F.size("tokens")).alias("alone"), "sketch")
    rows = open_places.withColumn("block", block).withColumn("meets", meets).join(sketched, "node")
    return rows.select("token", "node", *columns, F.explode("meets").alias("cell")).select("token", "cell.i", "cell.j", "node", *columns)


def _other_pairs(sets: DataFrame, labels: DataFrame, percent: int, spanning: bool = False) -> DataFrame:
    """All pairs across components that share a prefix shingle and pass the filters.

    spanning: of each shingle's pairs only those that would join its components if they link, which are
    fewer than its members.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        seen: set[tuple[int, int]] = set()
        for (_, i, j), group in itertools.groupby(rows, key=lambda r: r[:3]):
            parts = list(zip(*group, strict=True))[3:]
            node, n, comp, place, block, alone = (np.array(c) for c in parts[:6])
            sketch = np.frombuffer(b"".join(parts[6]), np.uint64).reshape(len(node), -1)
            groups = _Groups()
            for k in range(len(node) - 1):
                other = np.flatnonzero(comp[k + 1 :] != comp[k]) + k + 1
                both = n[k] + n[other]
                low, high = np.minimum(n[k], n[other]), np.maximum(n[k], n[other])
                rest = np.minimum(n[k] - place[k], n[other] - place[other])
                fits = (100 * low >= percent * high) & ((100 + percent) * rest >= percent * both)
                if i != j:
                    fits &= block[other] != block[k]
                other = other[fits]
                apart = alone[k] + alone[other] + np.bitwise_count(sketch[k] ^ sketch[other]).sum(axis=1)
                other = other[(100 + percent) * (both[fits] - apart) >= 2 * percent * both[fits]]
                if spanning:
                    other = np.array([o for o in other.tolist() if groups.join(int(comp[k]), int(comp[o]))], int)
                seen.update((min(int(node[k]), d), max(int(node[k]), d)) for d in node[other].tolist())
            if len(seen) > 100_000:
                yield _pairs(seen)
                seen.clear()
        yield _pairs(seen)

    n = common.partitions(sets.sparkSession)
    cells = _cells(sets, labels).repartition(n, "token", "i", "j").sortWithinPartitions("token", "i", "j", "node")
    return cells.mapInArrow(common.tidy(compare), "a long, b long").distinct()


def _pairs(seen: set[tuple[int, int]]) -> pa.RecordBatch:
    some = np.array(sorted(seen), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1])], ["a", "b"])


def near_duplicates(documents: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id of the documents with the same set) and component_id of every document."""
    docs = common.rows_in(documents, id_col, text_col)
    spark, since = docs.sparkSession, common.staged_so_far()
    bits = min(16, max(4, int(np.ceil(np.log2(2 * common.partitions(spark))))))
    found = common.stage(_gathered(_frequent(_blocks(docs, words, bits)), percent, bits), "gathered")
    common.free(spark)
    key = ["n", "f1", "f2"]
    sized = common.stage(found.select("doc_id", *key), "sized")
    classes = common.stage(sized.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id")), "classes")

    place = F.col("n") - F.size("tokens")  # shingles that occur once come first
    prefix_size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = F.transform(F.slice("tokens", 1, F.greatest(F.lit(0), (prefix_size - place).cast("int"))), lambda t, i: F.struct(t.alias("token"), (place + i).alias("place")))
    # a set takes part once, under its fingerprint
    sets = found.where("tokens is not null").dropDuplicates(key).withColumn("prefix", prefix).withColumnRenamed("f1", "node").drop("doc_id", "f2")
    sets = common.stage(sets, "sets")
    common.discard(found)

    links = common.stage(_verify(_first_pairs(sets), sets, percent).select("a", "b"), "links")
    repeated = sized.where("n > 0").groupBy("doc_id").agg(F.min("f1").alias("a"), F.max("f1").alias("high")).where("a < high")
    same_id = sized.where("n > 0").join(repeated, "doc_id").where("a < f1").select("a", F.col("f1").alias("b"))
    links = common.stage(links.unionByName(same_id).distinct(), "links")
    labels = components(links)
    for spanning in (True, False):
        more = common.stage(_verify(_other_pairs(sets, labels, percent, spanning), sets, percent).select("a", "b"), "links")
        if not more.isEmpty():
            links = common.stage(links.unionByName(more), "links")
            labels = components(links)
    named = classes.join(labels, classes["f1"] == labels["node"], "left").withColumn("group", F.coalesce("component", "f1"))
    smallest = named.groupBy("group").agg(F.min("class_id").alias("component_id"))
    linked = common.stage(named.join(smallest, "group").select(*key, "class_id", "component_id"), "linked")
    common.sweep(since, sized, linked)
    out = sized.join(linked, key, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
