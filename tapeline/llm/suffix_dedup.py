"""Removal of byte strings that repeat anywhere in a corpus, by sharded suffix arrays.

Every byte covered by a string of `length` bytes that also starts elsewhere (same document included) goes.
A second, longer length can be judged in the same pass. The work falls into steps that each stay in
proportion to the input:

1. Each string of `length` bytes has a minimiser: its gram of a third of its bytes with the smallest hash.
   Strings that follow one another and share a minimiser form a run. Equal strings have equal minimisers, so
   only runs whose minimiser's key occurs twice can repeat; only these are looked at again. A run's context
   is the bytes of its strings, and as many more as a string of the longer length takes.
2. Equal runs collapse into one context with a count (within a document first), then by shuffle.
3. The contexts of a key meet in one shard, which drops those that agree with no other one in enough bytes
   around their minimisers. It builds the suffix array of the rest by
   Larsson-Sadakane refinement, the common prefixes by Kasai's walk, and marks the starts whose common
   prefix with another start reaches a length.
4. A key with more than `HOT` contexts is dealt to several shards. Each reports every string it holds once,
   sorted by hash, and strings of two shards are found by binary search in ranges of hashes.
5. Marks go back to the runs, and the documents' bytes are cut.

No key, string or document is ever gathered whole beyond these bounds. Equal contexts, and equal strings of
two shards, are told by 64-bit hashes; within a shard bytes are compared. Null and empty texts have no
bytes. Repeated rows repeat their strings like any others; rows of one id are judged by the union of their
marks. Rows without an id are left out. Only id and text are read. Documents longer than 16 MB are read in
overlapping parts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common

LENGTH = 400
#: Contexts of one key that one shard takes.
HOT = 256
#: Bytes of contexts in one suffix array, as far as keys allow.
SHARD_BYTES = 1 << 19
#: Bytes of text read at a time; a pass holds about a hundred times as many.
PASS_BYTES = 1 << 20
#: Strings of split keys that a task reports at a time.
REPORTED = 1 << 20
_PLACE = 24
_LANE = 64


def _slide_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every run of `width` values, by doubling."""
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(data: np.ndarray, at: np.ndarray, length: int, gram: int, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive strings with one minimiser: first start, number of strings, place and key of the minimiser.

    at: document offsets; no string crosses them. Ties take the last place, so the choice follows from the
    string alone.
    """
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(data) >= 1 << _PLACE:
        raise ValueError("too many bytes at once")
    gram = min(gram, length)
    total = common.prefix_hashes(data) if total is None else total
    n = len(data) - gram + 1
    g = common.mix((total[gram:] - total[:n]) * common.powers(n, common.INVERSE))
    last = np.uint64((1 << _PLACE) - 1)
    ranked = (g & ~last) | (last - np.arange(len(g), dtype=np.uint64))
    low = _slide_min(ranked, length - gram + 1)
    place = (last - (low & last)).astype(np.int64)
    inside = np.ones(len(low), bool)
    for end in at[1:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    cut = np.ones(len(low), bool)
    cut[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(low)))
    keep = inside[first]
    first, count = first[keep], count[keep]
    return first, count, place[first], g[place[first]]


def _gram(length: int) -> int:
    """Bytes of the minimisers of strings of a length."""
    return max(1, length // 3)


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte span. total: prefix_hashes(data), if known."""
    total = common.prefix_hashes(data) if total is None else total
    # the sum of a span carries the power of its start; the inverse takes it away
    down = common.powers(len(data) + 1, common.INVERSE)
    return common.mix((total[start + size] - total[start]) * down[start] + common.mix(size.astype(np.uint64)))


def suffix_array(text: np.ndarray, sizes: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of contexts of these sizes, in order; only those of the wanted places, if given.

    A context ends in a mark of its own, smaller than any byte, so a suffix ends with its context.
    Larsson-Sadakane: groups of equal first h bytes are refined by the ranks h further on (and 2 * h, where
    three ranks fit in a sort key), and only groups that are still unsorted are touched. The last round, in
    which every suffix meets its mark, refines wanted suffixes only.
    """
    n, ends = len(text), np.cumsum(sizes)
    ctx = np.repeat(np.arange(len(sizes)), sizes)
    end = ends[ctx]
    one = np.zeros(n + 8, np.uint64)
    one[:n] = text.astype(np.uint64) + np.uint64(1)
    # seven symbols of 9 bits; 0 stands behind a context's end
    seven = np.zeros(n, np.uint64)
    place = np.arange(n)
    for step in range(7):
        seven = (seven << np.uint64(9)) | np.where(place + step < end, one[step : n + step], np.uint64(0))
    order = np.argsort(seven)
    sorted_ = seven[order]
    head = np.ones(n, bool)
    head[1:] = sorted_[1:] != sorted_[:-1]
    heads = np.flatnonzero(head)
    counts = np.diff(np.append(heads, n))
    marks = len(sizes)
    bits = (n + marks).bit_length()
    steps = 2 if 3 * bits < 64 else 1
    rank = np.empty(n, np.int64)  # the marks rank first
    rank[order] = np.repeat(heads + marks, counts)
    reach = int(sizes.max(initial=0))
    asked = None
    if wanted is not None:
        asked = np.zeros(n, bool)
        asked[wanted] = True
    h = 7
    slots = np.flatnonzero(np.repeat(counts > 1, counts))  # places of the order in unsorted groups
    while len(slots):
        last = h * (steps + 1) >= reach
        if last and asked is not None:
            slots = slots[asked[order[slots]]]
        who = order[slots]
        by, stop = rank[who], end[who]
        for step in range(1, steps + 1):
            further = who + step * h
            by = (by << bits) | np.where(further < stop, rank[np.minimum(further, n - 1)], ctx[who])
        new = np.argsort(by, kind="stable")
        who, by = who[new], by[new]
        order[slots] = who
        if last:
            break
        head = np.ones(len(slots), bool)
        head[1:] = by[1:] != by[:-1]
        heads = np.flatnonzero(head)
        counts = np.diff(np.append(heads, len(slots)))
        rank[who] = np.repeat(slots[heads] + marks, counts)
        slots = slots[np.repeat(counts > 1, counts)]
        h *= steps + 1
    return order if asked is None else order[asked[order]]


def common_prefixes(text: np.ndarray, sizes: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes (up to `most`) that each suffix of an order shares with the one before it, within their contexts.

    Kasai's walk: a suffix shares at least one byte less than the suffix one place earlier, if the suffixes
    before both are neighbours too. Many lanes walk in step, 8 bytes to a comparison.
    """
    n, m = len(text), len(order)
    packed = np.zeros(n + 8, np.uint64)
    packed[:n] = text
    for width in (1, 2, 4):
        packed[:-width] = (packed[:-width] << np.uint64(8 * width)) | packed[width:]
    end = np.repeat(np.cumsum(sizes), sizes)
    at = np.sort(order)
    where = np.full(n + 1, -1, np.int64)
    where[at] = np.arange(m)
    lanes = -(-m // _LANE)
    before = np.full(lanes * _LANE, -1, np.int64)
    before[where[order[1:]]] = order[:-1]
    carries = np.zeros(lanes * _LANE, bool)
    if m:
        carries[1:m] = (at[1:] == at[:-1] + 1) & (before[: m - 1] >= 0) & (where[before[: m - 1] + 1] >= 0)
    out = np.zeros(lanes * _LANE, np.int64)
    have = np.zeros(lanes, np.int64)
    first = np.arange(lanes) * _LANE
    at = np.append(at, np.zeros(lanes * _LANE - m, np.int64))
    for step in range(_LANE):
        k = first + step
        i, j = at[k], before[k]
        have = np.where(carries[k] & (j >= 0), np.maximum(have - 1, 0), 0)
        room = np.where(j >= 0, np.minimum(end[i] - i, end[j] - j), 0)
        active = np.flatnonzero(have < np.minimum(room, most))
        while len(active):
            differ = packed[i[active] + have[active]] ^ packed[j[active] + have[active]]
            same = np.full(len(active), 8, np.int64)
            odd = np.flatnonzero(differ)
            if len(odd):
                x, zero = differ[odd], np.zeros(len(odd), np.int64)
                for byte in range(1, 8):
                    zero += x < np.uint64(1 << (8 * byte))
                same[odd] = zero
            have[active] = np.minimum(have[active] + same, room[active])
            active = active[(same == 8) & (have[active] < np.minimum(room[active], most))]
        out[k] = np.minimum(have, most)
    return out[where[order]]


def repeated_runs(contexts: list[bytes], weights: list[int], lengths: tuple[int, ...], own: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the starts whose string occurs at two places or more, by a suffix array: context, first, count of runs.

    own: only so many first starts of each context count; what follows belongs to other contexts.
    """
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    firsts = np.cumsum(sizes) - sizes
    counts = _starts(sizes, lengths[0], own)
    at, ctx = common.lane_concat(firsts, counts), np.repeat(np.arange(len(contexts)), counts)
    order = suffix_array(text, sizes, at)
    shared = common_prefixes(text, sizes, order, lengths[-1])
    ranked = np.searchsorted(at, order)
    left = (firsts + sizes)[ctx] - at  # bytes of the context from a start on
    out = []
    for length in lengths:
        times = np.where(left >= length, np.array(weights, np.int64)[ctx], 0)[ranked]
        group = np.cumsum(shared < length)
        twice = np.zeros(len(at), bool)
        twice[ranked] = (np.bincount(group, times)[group] >= 2) & (times > 0)
        some = np.flatnonzero(twice)
        fresh = np.ones(len(some), bool)
        fresh[1:] = (np.diff(some) != 1) | (np.diff(ctx[some]) != 0)
        heads = np.flatnonzero(fresh)
        lead = some[heads]
        out.append((ctx[lead], (at - firsts[ctx])[lead], np.diff(np.append(heads, len(some)))))
    return out


def _starts(sizes: np.ndarray, length: int, own: list[int] | None) -> np.ndarray:
    """How many strings of a length start in contexts of these sizes."""
    counts = np.maximum(sizes - length + 1, 0)
    return counts if own is None else np.minimum(counts, np.array(own))


def _run_lists(group: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The groups (sorted) that runs belong to, once each, and their runs as first, count, first, count, ..."""
    lead = np.flatnonzero(np.diff(group, prepend=-1))
    pairs = np.stack([first, count], 1).astype(np.int32).ravel()
    return group[lead], pa.ListArray.from_arrays(pa.array(2 * np.append(lead, len(group)).astype(np.int32), pa.int32()), pa.array(pairs, pa.int32()))


def _occurrences(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Runs of every document: key, ctx, doc_id, start, n (strings), size (bytes of the context), mid (place of the
    minimiser in it), times.

    key is null where a document repeats the run itself; such rows that touch are one.
    """
    ddl = "key long, ctx long, doc_id long, start int, n int, size int, mid int, times int"
    most, short, long = (1 << _PLACE) - 1, lengths[0], lengths[-1]

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
        data, at = common.utf8(batch.column(1))
        ids = batch.column(0).to_numpy()
        if len(data) < most:
            yield data, at, ids, 0, most
            return
        step = most - long
        for i in range(len(ids)):
            a, b = int(at[i]), int(at[i + 1])
            for low in range(a, max(a + 1, b - short + 1), step):
                part = data[low : min(b, low + most - 1)]
                yield part, np.array([0, len(part)]), ids[i : i + 1], low - a, step if low + most - 1 < b else most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, most=PASS_BYTES):
            for data, at, ids, base, limit in parts(batch):
                total = common.prefix_hashes(data)
                first, n, mid, key = runs(data, at, short, _gram(short), total)
                mid = mid - first
                if limit < most:  # starts from the limit on belong to the next part
                    inside = first < limit
                    first, n, mid, key = first[inside], np.minimum(n[inside], limit - first[inside]), mid[inside], key[inside]
                doc = np.searchsorted(at, first, "right") - 1
                size = np.minimum(n + long - 1, at[doc + 1] - first)
                ctx = span_hashes(data, first, size, total)
                # equal runs within a document: one stays for the corpus, all are repeated
                order = np.lexsort((first, ctx, key, doc))
                same = np.zeros(len(order), bool)
                same[1:] = (doc[order[1:]] == doc[order[:-1]]) & (key[order[1:]] == key[order[:-1]]) & (ctx[order[1:]] == ctx[order[:-1]])
                group = np.cumsum(~same) - 1
                times = np.bincount(group, minlength=int(group[-1]) + 1 if len(group) else 0)
                lead = order[~same]
                own = np.sort(order[times[group] > 1])
                start = first - at[doc] + base
                where, count, bytes_, whose = start[own], n[own], size[own], doc[own]
                if len(own):
                    joined = np.ones(len(own), bool)
                    joined[1:] = (whose[1:] != whose[:-1]) | (where[1:] > where[:-1] + count[:-1])
                    heads = np.flatnonzero(joined)
                    tails = np.append(heads[1:], len(own)) - 1
                    count, bytes_ = where[tails] + count[tails] - where[heads], where[tails] + bytes_[tails] - where[heads]
                    where, whose = where[heads], whose[heads]
                nulls = pa.array([None] * len(where), pa.int64())
                ints = ((start[lead], where), (n[lead], count), (size[lead], bytes_), (mid[lead], np.zeros(len(where))), (times, np.full(len(where), 2)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(key[lead].view(np.int64)), nulls]),
                        pa.concat_arrays([pa.array(ctx[lead].view(np.int64)), nulls]),
                        pa.array(np.concatenate([ids[doc[lead]], ids[whose]]).astype(np.int64)),
                        *(pa.array(np.concatenate(pair).astype(np.int32)) for pair in ints),
                    ],
                    ["key", "ctx", "doc_id", "start", "n", "size", "mid", "times"],
                )

    return docs.mapInArrow(common.tidy(find), ddl)


def _cut_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts (key, ctx, times, part, parts, doc_id, start, n, size)."""
    fields = ("key", "ctx", "times", "part", "parts", "n", "mid", "start", "size")
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    schema = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("times", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("n", pa.int32()), ("mid", pa.int32()), ("content", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, most=PASS_BYTES):
            data, at = common.utf8(batch.column(0))
            lists = batch.column(1)
            some = dict(zip(fields, lists.flatten().flatten(), strict=True))
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            first = at[doc] + some["start"].to_numpy()
            last = first + some["size"].to_numpy()
            fits = np.flatnonzero(last <= at[doc + 1])
            first, last = first[fits], last[fits]
            # of rows that share an id only those with the context's bytes are cut
            true = span_hashes(data, first, last - first).view(np.int64) == some["ctx"].to_numpy()[fits]
            first, last, rows = first[true], last[true], pa.array(fits[true])
            raw = memoryview(np.ascontiguousarray(data))
            content = pa.array([bytes(raw[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(some[c].take(rows) for c in schema.names[:-1]), content], schema=schema)

    joined = docs.join(asked.hint("shuffle_hash"), "doc_id").select("text", "asked")
    return joined.mapInArrow(common.tidy(cut), "key long, ctx long, times long, part int, parts int, n int, mid int, content binary")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Sorted rows in lists that end between keys and hold about SHARD_BYTES."""
    rows = (r for batch in common.slices(batches, "content") for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    some, size = [], 0
    for _, group in itertools.groupby(rows, key=lambda r: (r[0], r[3])):
        group = list(group)  # HOT contexts at most, about
        some += group
        size += sum(len(r[7]) for r in group)
        if size >= SHARD_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _paired(some: list[tuple], length: int) -> list[tuple]:
    """The contexts of a shard that can share a string with another one.

    Equal strings have their minimiser at the same place, and it leaves at least half of the other bytes to
    one side. So two contexts with a string in common agree in the minimiser and so many bytes on its left,
    or in the minimiser and so many on its right.
    """
    gram = _gram(length)
    half = (length - gram) // 2
    text = np.frombuffer(b"".join(r[7] for r in some), np.uint8)
    sizes = np.array([len(r[7]) for r in some])
    mid = np.array([r[6] for r in some])
    at = np.cumsum(sizes) - sizes + mid
    key = common.mix(np.array([r[0] for r in some], np.int64).view(np.uint64))
    keep = np.zeros(len(some), bool)
    for start, has in ((at - half, mid >= half), (at, mid + gram + half <= sizes)):
        which = np.flatnonzero(has)
        hashes = common.mix(span_hashes(text, start[which], np.full(len(which), gram + half)) ^ key[which])
        _, group, times = np.unique(hashes, return_inverse=True, return_counts=True)
        keep[which[times[group] > 1]] = True
    return [r for r, k in zip(some, keep.tolist(), strict=True) if k]


_STRING = np.dtype([("hash", "<u8"), ("key", "<i8"), ("ctx", "<i8"), ("place", "<i4"), ("level", "<i4")])
_FLAG = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("level", pa.int32()), ("runs", pa.list_(pa.int32())), ("bucket", pa.int32()), ("block", pa.binary())])


def _strings(some: list[tuple], lengths: tuple[int, ...]) -> np.ndarray:
    """The strings of a shard's split keys, each once."""
    some = [r for r in some if r[4] > 1]
    text = np.frombuffer(b"".join(r[7] for r in some), np.uint8)
    sizes = np.array([len(r[7]) for r in some], np.int64)
    firsts = np.cumsum(sizes) - sizes
    key, ctx = np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.int64)
    out = []
    for level, length in enumerate(lengths):
        counts = _starts(sizes, length, [r[5] for r in some])
        which, at = np.repeat(np.arange(len(some)), counts), common.lane_concat(firsts, counts)
        hashes = common.mix(common.gram_hashes(text, length)[at] ^ common.mix(key.view(np.uint64) + np.uint64(level))[which])
        hashes, once = np.unique(hashes, return_index=True)
        found = np.empty(len(hashes), _STRING)
        found["hash"], found["key"], found["ctx"], found["place"], found["level"] = hashes, key[which[once]], ctx[which[once]], (at - firsts[which])[once], level
        out.append(found)
    return np.concatenate(out)


def _bucketed(strings: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Reported strings in rows of one range of hashes each, sorted."""
    strings = np.sort(strings, order="hash")
    bucket = ((strings["hash"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets)).tolist()
    blocks = [strings[a:b].tobytes() for a, b in itertools.pairwise(edges)]
    nulls = [pa.nulls(len(blocks), kind) for kind in _FLAG.types[:4]]
    return pa.RecordBatch.from_arrays([*nulls, pa.array(bucket[edges[:-1]], pa.int32()), pa.array(blocks, pa.binary())], schema=_FLAG)


def _marks(contexts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Repeated starts within each shard as key, ctx, level, runs; strings of split keys, once a shard, as bucket, block."""
    n = common.partitions(contexts.sparkSession)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reported: list[np.ndarray] = []
        for some in _shards(batches):
            if any(r[4] > 1 for r in some):
                reported.append(_strings(some, lengths))
                if sum(map(len, reported)) >= REPORTED:
                    yield _bucketed(np.concatenate(reported), 2 * n)
                    reported = []
            some = _paired(some, lengths[0])
            if not some:
                continue
            key, ctx = np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.int64)
            single = np.array([r[2] for r in some]) == 1  # runs that repeat as they are need no marks
            for level, (group, first, count) in enumerate(repeated_runs([r[7] for r in some], [r[2] for r in some], lengths, [r[5] for r in some])):
                keep = single[group]
                group, lists = _run_lists(group[keep], first[keep], count[keep])
                columns = [pa.array(key[group]), pa.array(ctx[group]), pa.array(np.full(len(group), level, np.int32)), lists]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(group), pa.int32()), pa.nulls(len(group), pa.binary())], schema=_FLAG)
        if reported:
            yield _bucketed(np.concatenate(reported), 2 * n)

    dealt = contexts.repartition(n, "key", "part").sortWithinPartitions("key", "part", "ctx")
    return dealt.mapInArrow(common.tidy(mark), "key long, ctx long, level int, runs array<int>, bucket int, block binary")


def _across(reported: DataFrame) -> DataFrame:
    """key, ctx, level, runs of the strings that two shards of their key hold, by binary search in sorted hashes."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, blocks in itertools.groupby(rows, key=lambda r: r[0]):
            held = np.frombuffer(b"".join(r[1] for r in blocks), _STRING)
            hashes = np.sort(held["hash"])
            twice = np.searchsorted(hashes, held["hash"], "right") - np.searchsorted(hashes, held["hash"], "left") > 1  # a shard reports a string once
            held = np.sort(held[twice], order=["key", "ctx", "level", "place"])
            if not len(held):
                continue
            fresh = np.ones(len(held), bool)
            fresh[1:] = (held["key"][1:] != held["key"][:-1]) | (held["ctx"][1:] != held["ctx"][:-1]) | (held["level"][1:] != held["level"][:-1])
            cut = fresh.copy()
            cut[1:] |= held["place"][1:] != held["place"][:-1] + 1
            heads = np.flatnonzero(cut)
            _, lists = _run_lists(np.cumsum(fresh)[heads], held["place"][heads], np.diff(np.append(heads, len(held))))
            lead = held[fresh]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(lead[c])) for c in ("key", "ctx", "level")), lists], ["key", "ctx", "level", "runs"])

    n = common.partitions(reported.sparkSession)
    dealt = reported.select("bucket", "block").repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(common.tidy(merge), "key long, ctx long, level int, runs array<int>")


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(doc: np.ndarray, first: np.ndarray, last: np.ndarray, docs: int, kind: pa.DataType) -> pa.Array:
    """For each document its spans from first to last, sorted and joined where they touch."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    # a document's places are set apart from those before it, so that one running maximum serves all
    room = int(last.max(initial=0)) + 1
    reach = np.maximum.accumulate(last + doc * room) if len(doc) else last
    heads = np.ones(len(doc), bool)
    heads[1:] = first[1:] + doc[1:] * room > reach[:-1]
    heads[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(heads)
    ends = np.append(at[1:], len(doc)) - 1
    begin, end = first[at], (reach[ends] - doc[ends] * room) if len(at) else last
    fields = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (begin, end - begin)], ["first", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[at], np.arange(docs + 1)).astype(np.int32)), fields).cast(kind)


def repeated_spans(documents: DataFrame, length: int = LENGTH, *, longer: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of structs first, n; sorted, apart) of the bytes to remove, for documents that have any.

    longer: longer_spans are the bytes of repeated strings of that length, judged in the same pass.
    """
    lengths = (length,) if longer is None else (length, longer)
    if list(lengths) != sorted(set(lengths)) or length < 1:
        raise ValueError("lengths must ascend")
    docs = common.rows_in(documents, id_col, text_col)
    since = common.staged_so_far()
    found = common.stage(_occurrences(docs, lengths), "runs")
    known = found.where("key is not null")
    place = F.min(F.struct("doc_id", "start", "n", "size", "mid")).alias("place")
    contexts = common.stage(known.groupBy("key", "ctx").agg(F.sum("times").alias("times"), place), "contexts")
    keys = contexts.groupBy("key").agg(F.sum("times").alias("total"), F.count("*").alias("contexts")).where("total > 1").drop("total")
    live = common.stage(contexts.join(common.stage(keys, "keys"), "key").select("key", "ctx", "times", "place.*", "contexts"), "live")
    common.discard(contexts)
    parts = F.ceil(F.col("contexts") / HOT).cast("int")
    wanted = live.where("contexts > 1").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("ctx"), F.col("parts")).cast("int"))
    marks = common.stage(_marks(_cut_contexts(docs, wanted), lengths), "marks")
    common.free(docs.sparkSession)

    def whole(runs: DataFrame, *columns: str) -> DataFrame:
        """All starts of runs that repeat as they are."""
        levels = F.array(*(F.struct(F.lit(k).alias("level"), F.least("n", F.col("size") - (size - 1)).alias("n")) for k, size in enumerate(lengths)))
        each = runs.select(*columns, F.explode(F.filter(levels, lambda x: x["n"] > 0)).alias("x"))
        return each.select(*columns, "x.level", F.array(F.lit(0), F.col("x.n")).alias("runs"))

    flags = marks.where("bucket is null").select("key", "ctx", "level", "runs").unionByName(whole(live.where("times > 1"), "key", "ctx")).unionByName(_across(marks.where("bucket is not null")))
    flags = flags.groupBy("key", "ctx").agg(F.collect_list(F.struct("level", "runs")).alias("flags"))
    hits = known.join(flags, ["key", "ctx"]).select("doc_id", "start", "flags")
    own = whole(found.where("key is null"), "doc_id", "start").select("doc_id", "start", F.array(F.struct("level", "runs")).alias("flags"))
    by_doc = hits.unionByName(own).groupBy("doc_id").agg(F.collect_list(F.struct("start", "flags")).alias("hits"))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
    names = ["spans", "longer_spans"][: len(lengths)]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(1)
            doc = np.repeat(np.arange(batch.num_rows), _lengths(hits))
            start, flag_lists = hits.flatten().flatten()
            which = np.repeat(np.arange(len(doc)), _lengths(flag_lists))
            level, runs_ = flag_lists.flatten().flatten()
            flag = np.repeat(np.arange(len(which)), _lengths(runs_) // 2)
            numbers = runs_.flatten().to_numpy().astype(np.int64)
            hit = which[flag]
            level = level.to_numpy()[flag]
            first = start.to_numpy()[hit] + numbers[::2]
            last = first + numbers[1::2] + np.array(lengths)[level] - 1
            columns = [_joined(doc[hit[level == k]], first[level == k], last[level == k], batch.num_rows, kind) for k in range(len(lengths))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    spans = "array<struct<first:int,n:int>>"
    out = common.stage(by_doc.mapInArrow(common.tidy(join), "doc_id long, " + ", ".join(f"{n} {spans}" for n in names)), "spans")
    common.sweep(since, out)
    common.free(docs.sparkSession)
    return out


def attach(documents: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with raw (their bytes), n_bytes and the columns of repeated_spans (empty where none).

    Columns of these names that the documents bring along are replaced.
    """
    none = F.array().cast("array<struct<first:int,n:int>>")
    names = [c for c in spans.columns if c != "doc_id"]
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8")
    own = documents.where(F.col(id_col).isNotNull()).withColumn("raw", raw).withColumn("n_bytes", F.octet_length("raw").cast("long")).drop(*names)
    found = spans.select(F.col("doc_id").alias("__doc_id"), *names)
    rows = own.join(found, own[id_col] == found["__doc_id"], "left").drop("__doc_id")
    fits = lambda s: s["first"] + s["n"] <= F.col("n_bytes")
    return rows.withColumns({c: F.filter(F.coalesce(c, none), fits) for c in names})


def remaining(spans: str | Column = "spans") -> Column:
    """What is left of `raw` without the spans."""
    state = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("kept"))
    kept = F.aggregate(
        spans,
        state,
        lambda a, s: F.struct(
            (s["first"] + s["n"]).alias("at"),
            F.concat(a["kept"], F.substring("raw", a["at"] + 1, s["first"] - a["at"])).alias("kept"),
        ),
        lambda a: F.concat(a["kept"], F.substring("raw", a["at"] + 1, F.col("n_bytes").cast("int"))),
    )
    return F.when(F.size(spans) == 0, F.col("raw")).otherwise(kept)


def passages(words: int, spans: str = "spans") -> Column:
    """The whole words within each span, where they are more than `words`. White space parts words."""
    gap = r"[ \t-\r]"
    one = lambda at: F.substring("raw", at, 1)
    blank = lambda at: F.decode(one(at), "ISO-8859-1").rlike(gap)

    def trimmed(s: Column) -> Column:
        held = F.decode(F.substring("raw", s["first"] + 1, s["n"]), "ISO-8859-1")  # a character for each byte
        end = s["first"] + s["n"]
        parted = F.when((s["first"] == 0) | blank(s["first"]), F.lit(rf"^{gap}*")).otherwise(F.lit(rf"^[^ \t-\r]*{gap}*"))
        closed = F.when((end == F.col("n_bytes")) | blank((end + 1).cast("int")), F.lit(rf"{gap}*\z")).otherwise(F.lit(rf"{gap}*[^ \t-\r]*\z"))
        lead, tail = (F.coalesce(F.char_length(F.regexp_substr(held, pattern)), F.lit(0)) for pattern in (parted, closed))
        return F.struct((s["first"] + lead).alias("first"), F.greatest(F.lit(0), s["n"] - lead - tail).alias("n"))

    held = lambda s: F.decode(F.substring("raw", s["first"] + 1, s["n"]), "ISO-8859-1")
    return F.filter(F.transform(spans, trimmed), lambda s: F.size(F.regexp_extract_all(held(s), F.lit(r"[^ \t-\r]+"), F.lit(0))) > words)


def removed(spans: str = "spans") -> Column:
    """Bytes within the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["n"])
