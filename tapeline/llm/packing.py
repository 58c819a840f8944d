"""Best-fit packing of documents into fixed-length sequences by the sum-of-squares rule.

Pieces of one length are interchangeable, so the rule works on the histogram of lengths: each piece goes
where the sum of the squared numbers of open sequences per residual gap becomes smallest, longest pieces
first. The histogram has at most `size` rows whatever the corpus, and its counts are placed by their digits
to the base `BASE`: a plan of the leading digits stands for a power of the base of equal packings. The
pieces of its emptiest sequences (`CARRIED` at most) count `BASE`-fold in the next plan instead, and the last
one, of single pieces, keeps all. A plan thus places a number of pieces that does not grow with the corpus,
and there is one plan for each digit. Pieces then take the slots of their length by rank; ranks are counted per
salted part, so a length that holds most pieces is never gathered.

Null and empty texts are one piece, the end id. Documents longer than `size` are cut from the end, the
first piece being the shorter. Repeated ids keep all their rows. Rows without an id are left out.
"""

from __future__ import annotations

import collections
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm import common, tokens

#: Base of the digits by which counts are placed.
BASE = 16
#: Pieces that a plan hands on to the next one, at most.
CARRIED = 1024
#: Parts of a length within which ranks are counted.
PARTS = 256


def pieces(documents: DataFrame, tokenizer: str, end: int, size: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    docs = common.rows_in(documents, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.encoder(tokenizer)
        for batch in common.slices(batches):
            ids, at = words.encode_all(batch.column("text").to_pylist(), end)
            length = np.diff(at)
            count = -(-length // size)
            row = np.repeat(np.arange(len(length)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = length - (count - 1) * size  # the shorter piece, where there is one
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
            n = np.where(piece == 0, first[row], size)
            raw, low = memoryview(ids.tobytes()), (at[row] + start) * 4
            crcs = [zlib.crc32(raw[a : a + 4 * b]) for a, b in zip(low.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (batch.column("doc_id").to_numpy()[row], piece.astype(np.int32), start, n)] + [pa.array(crcs, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(counts: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places counts[l] pieces of each length l; gives (length, sequence, offset) of every slot.

    Moving a sequence from gap g to gap g - l changes the sum of squares by
    2 * (open[g - l] - open[g]) + 2, and by 1 - 2 * open[l] where the piece fills it: full sequences no
    longer count. A new sequence is opened only where no open one has room, which needs fewer of them.
    """
    total = sum(counts.values())
    length, sequence, offset = (np.zeros(total, np.int64) for _ in range(3))
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    n = np.zeros(size + 1, np.int64)  # sequences by gap; gap 0 stays 0: full ones are no longer open
    at = made = 0
    for l in sorted(counts, reverse=True):
        for _ in range(counts[l]):
            length[at] = l
            have = np.flatnonzero(n[l:size]) + l  # open sequences with room
            chosen = size
            if len(have):
                cost = 2 * (n[have - l] - n[have]) + 2
                cost[have == l] = -2 * n[l] + 1  # fills the gap
                chosen = int(have[int(cost.argmin())])
            if chosen == size:
                which, made = made, made + 1
            else:
                which = open_by_gap[chosen].pop()
                n[chosen] -= 1
            sequence[at], offset[at] = which, size - chosen
            left = chosen - l
            if left:
                open_by_gap[left].append(which)
                n[left] += 1
            at += 1
    return length, sequence, offset


def _kept(length: np.ndarray, sequence: np.ndarray, size: int, carried: int) -> np.ndarray:
    """Whether each sequence stays as it is: full ones do, and the emptiest others, up to so many pieces, don't."""
    filled, pieces = np.bincount(sequence, length), np.bincount(sequence)
    emptiest = np.argsort(filled, kind="stable")
    kept = np.ones(len(filled), bool)
    kept[emptiest[np.cumsum(pieces[emptiest]) <= carried]] = False
    return kept | (filled == size)


def plan(counts: dict[int, int], size: int) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
    """Slots as rows (level, length, slot, sequence, offset), and for each length (first rank, level, copies) in ascending order.

    The slots of a level stand for `copies` pieces each. Sequence numbers of a level's copies follow one
    another: those of copy c begin at sequence * copies + c.
    """
    levels = 1
    while BASE**levels <= max(counts.values(), default=0):
        levels += 1
    carried: dict[int, int] = {}
    slots, ranks = [np.empty((0, 5), np.int64)], {l: [] for l in counts}
    given, made = dict.fromkeys(counts, 0), 0
    for level in reversed(range(levels)):
        copies = BASE**level
        some = {l: c // copies % BASE + BASE * carried.get(l, 0) for l, c in counts.items()}
        length, sequence, offset = sum_of_squares({l: c for l, c in some.items() if c}, size)
        whole = _kept(length, sequence, size, CARRIED if level else 0)
        number = np.cumsum(whole) - 1
        kept = whole[sequence]
        carried = collections.Counter(length[~kept].tolist())
        length, sequence, offset = length[kept], number[sequence[kept]], offset[kept]
        order = np.argsort(length, kind="stable")
        length, sequence, offset = length[order], sequence[order], offset[order]
        slot = np.arange(len(length)) - np.searchsorted(length, length)
        slots.append(np.stack([np.full(len(length), level), length, slot, made + sequence * copies, offset], axis=1))
        made += int(whole.sum()) * copies
        for l, n in zip(*(x.tolist() for x in np.unique(length, return_counts=True)), strict=True):
            ranks[l].append((given[l], level, copies))
            given[l] += n * copies
    return np.concatenate(slots), ranks


def pack(cut: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to pieces. cut: a table that reads the same each time it is read."""
    spark = cut.sparkSession
    full = cut.where(F.col("length") == size).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < size).withColumn("part_no", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)))
    found = rest.groupBy("length", "part_no").agg(F.count("*").alias("n")).toPandas()  # at most size * PARTS rows
    sizes = {int(l): np.zeros(PARTS, np.int64) for l in sorted(set(found["length"]))}
    for l, part, n in found[["length", "part_no", "n"]].itertuples(index=False):
        sizes[l][part] = n
    slots, ranks = plan({l: int(n.sum()) for l, n in sizes.items()}, size)
    # a row for each length: the pieces before each part, and where its levels begin
    steps = [(l, (np.cumsum(n) - n).tolist(), [{"first": first, "level": level, "copies": copies} for first, level, copies in ranks[l]]) for l, n in sizes.items()]
    steps = spark.createDataFrame(steps, "length long, before array<long>, steps array<struct<first:long,level:long,copies:long>>")
    table = pa.Table.from_arrays([pa.array(np.ascontiguousarray(slots[:, k])) for k in range(5)], ["level", "length", "slot", "sequence", "offset"])

    # both tables are bounded by size: a row for each length, and a plan's slots for each digit
    local = Window.partitionBy("length", "part_no").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rest.withColumn("row", F.row_number().over(local)).join(F.broadcast(steps), "length")
    ranked = ranked.withColumn("rank", F.get("before", F.col("part_no").cast("int")) + F.col("row") - 1)
    step = F.element_at(F.filter("steps", lambda x: x["first"] <= F.col("rank")), -1)
    ranked = ranked.withColumn("step", step).withColumn("at", F.col("rank") - F.col("step.first"))
    ranked = ranked.select(*cut.columns, F.col("step.level").alias("level"), F.expr("at div step.copies").alias("slot"), (F.col("at") % F.col("step.copies")).alias("copy"))
    placed = ranked.join(F.broadcast(spark.createDataFrame(table)), ["level", "length", "slot"])
    placed = placed.select(*cut.columns, (F.col("sequence") + F.col("copy")).alias("sequence_id"), "offset")
    full = full.select(*cut.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), "offset")
    return placed.unionByName(full)


def best_fit(documents: DataFrame, tokenizer: str, end: int, size: int = 1024, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(common.stage(pieces(documents, tokenizer, end, size, id_col=id_col, text_col=text_col), "pieces"), size)
