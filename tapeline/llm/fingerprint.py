"""Document fingerprints by improbable features.

Every window of `WINDOW` bytes gets a precedence from the entropy of its bytes: windows of rare entropies
come first, those near constant or near random are left out. A window that has the best precedence among
its neighbours often enough is a feature. Features set `PROBES` bits of a Bloom filter of `FILTER_BYTES`
bytes; a filter that holds `CAPACITY` features is followed by a new one. Two fingerprints are compared by
the overlap of their filters' bits beyond what chance gives, each filter of the smaller one with its best
match in the other.

Texts below `SHORT` bytes hold too few windows for that; all their runs of `TINY` bytes are features. Longer
texts without features (monotonous ones) have one, the whole text. Equal texts have equal fingerprints, and
likeness 1; the empty text has no filter and is like the empty text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common, ranges

WINDOW = 64
FILTER_BYTES = 256
PROBES = 5
CAPACITY = 160
#: Windows (of WINDOW consecutive ones) in which a feature must be the best.
POPULAR = 16
SHORT = 256
TINY = 8
#: Entropy steps; precedence is a property of the step.
STEPS = 1000

_BITS = FILTER_BYTES * 8
#: c * log2(c) for counts within a window.
_CLOG = np.concatenate([[0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))])
_POP = np.array([bin(i).count("1") for i in range(256)], np.int32)


def precedence_table() -> np.ndarray:
    """Precedence of each entropy step, 0 for windows that are no features; higher is rarer.

    Prose crowds around the middle entropies, so the precedence falls with the likelihood of a step under a
    bell around it; steps below a fifth of the range or in its last hundredth tell nothing.
    """
    step = np.arange(STEPS + 1) / STEPS
    likely = np.exp(-0.5 * ((step - 0.60) / 0.06) ** 2)
    rank = np.argsort(np.argsort(-likely, kind="stable"), kind="stable") + 1
    rank[(step < 0.2) | (step > 0.99)] = 0
    return rank.astype(np.int32)


_PRECEDENCE = precedence_table()


def precedences(data: np.ndarray) -> np.ndarray:
    """Precedence of every window of data."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int32)
    # sorted by byte, equal bytes stand in order of place; a byte's count in the window behind it is a difference of ranks
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (len(data) + WINDOW) + order
    ahead = np.empty(len(data), np.int64)
    ahead[order] = np.searchsorted(key, key + WINDOW, "left") - np.arange(len(data))  # equal bytes in [i, i + WINDOW)
    behind = np.empty(len(data), np.int64)
    behind[order] = np.arange(len(data)) - np.searchsorted(key, key - WINDOW, "right") + 1  # in (i - WINDOW, i]
    # sliding by one: byte i leaves a window that holds it ahead[i] times, byte i + WINDOW enters as the behind-th
    first = np.bincount(data[:WINDOW], minlength=256)
    total = np.empty(n)
    total[0] = _CLOG[first].sum()
    leave = _CLOG[ahead[: n - 1]] - _CLOG[ahead[: n - 1] - 1]
    entering = behind[WINDOW : WINDOW + n - 1]
    enter = _CLOG[entering] - _CLOG[entering - 1]
    total[1:] = total[0] + np.cumsum(enter - leave)
    entropy = (np.log2(WINDOW) - total / WINDOW) / np.log2(WINDOW)
    # the sums drift by rounding only: far less than a step
    return _PRECEDENCE[np.clip((entropy * STEPS + 1e-6).astype(np.int64), 0, STEPS)]


def features(precedence: np.ndarray) -> np.ndarray:
    """Places of the windows that are the best of their neighbours often enough."""
    n = len(precedence)
    if not n:
        return np.empty(0, np.int64)
    place = np.arange(n, dtype=np.int64)
    rank = (precedence.astype(np.int64) << 32) | (n - place)  # ties go to the first
    width = min(WINDOW, n)
    best, size = rank, 1
    while size * 2 <= width:
        best = np.maximum(best[:-size], best[size:])
        size *= 2
    if width > size:
        rest = width - size
        best = np.maximum(best[:-rest], best[rest:])
    best = best[best >= 1 << 32]
    times = np.bincount(n - (best & 0xFFFFFFFF), minlength=n)
    return np.flatnonzero(times >= min(POPULAR, n))


def digest(data: np.ndarray, precedence: np.ndarray) -> np.ndarray:
    """The chained filters of a text, as rows of bytes."""
    if not len(data):
        return np.empty((0, FILTER_BYTES), np.uint8)
    places = features(precedence) if len(data) >= SHORT else ()
    if len(data) < SHORT:
        hashes = common.mix(common.gram_hashes(data, min(TINY, len(data))))
        hashes = hashes[np.sort(np.unique(hashes, return_index=True)[1])]
    elif len(places):
        # the hash of each chosen window; windows are few beside the bytes
        grams = data[places[:, None] + np.arange(WINDOW)].astype(np.uint64) + np.uint64(1)
        hashes = common.mix((grams * common.powers(WINDOW)).sum(axis=1, dtype=np.uint64))
        keep = np.sort(np.unique(hashes, return_index=True)[1])  # a feature counts once, at its first place
        hashes = hashes[keep]
    else:
        hashes = common.mix(((data.astype(np.uint64) + np.uint64(1)) * common.powers(len(data))).sum(dtype=np.uint64, keepdims=True))
    chain = np.arange(len(hashes)) // CAPACITY
    out = np.zeros((int(chain[-1]) + 1, _BITS), bool)
    for k in range(PROBES):
        out[chain, ((hashes >> np.uint64(11 * k)) & np.uint64(_BITS - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 (no more bits in common than by chance) to 1 (the filters of the smaller one are all in the other)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = _POP[a].sum(axis=1), _POP[b].sum(axis=1)
    scores = []
    for x, n in zip(a, na, strict=True):
        most = np.minimum(n, nb)
        chance = n * nb / _BITS
        shared = _POP[x & b].sum(axis=1)
        scores.append(max(0.0, float(((shared - chance) / np.maximum(most - chance, 1e-9)).max())))
    # equal fingerprints alone are wholly alike
    return min(1.0 - 1e-9, float(np.average(scores, weights=na)))


def text_of(filters: np.ndarray) -> str:
    """A fingerprint as text: the number of filters, a colon and their bytes in hexadecimal."""
    return f"{len(filters)}:{filters.tobytes().hex()}"


def edited(data: bytes, successor: bytes) -> tuple[int, bytes, int]:
    """Code points of a text; the text with its last quarter replaced by as many of the next one's first; bytes kept."""
    text = data.decode("utf-8", "replace")
    n = len(text) // 4
    head = text[: len(text) - n].encode()
    return len(text), head + successor[: 4 * n].decode("utf-8", "ignore")[:n].encode(), len(head)


def fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The next document is the one of the next id (after the last: the first); repeated ids follow one another
    in the order of their texts. Null texts count as empty. Rows without an id are left out; only id and
    text are read. Documents are dealt to shards of consecutive ids; each shard also gets the first row of
    the next one.
    """
    docs = common.rows_in(documents, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    starts = ranges.bounds(docs, "doc_id", F.octet_length("text") + 64)
    shard = ranges.shard_of(starts)("doc_id")
    heads = sorted(docs.groupBy(shard.alias("shard")).agg(F.min("doc_id").alias("head")).collect())  # a row for each shard
    firsts = np.array([r["head"] for r in heads], np.int64)
    before = np.array([heads[k - 1]["shard"] for k in range(len(heads))], np.int32)  # the first row also ends the last shard

    @F.pandas_udf("int")
    def also(ids: pd.Series) -> pd.Series:
        """The shard that a first row ends, null for others."""
        ids = ids.to_numpy(np.int64)
        k = np.minimum(np.searchsorted(firsts, ids), len(firsts) - 1)
        return pd.Series(before[k], dtype="Int32").where(firsts[k] == ids)

    own, extra = F.struct("shard", F.lit(0).alias("tail")), F.struct(F.col("also").alias("shard"), F.lit(1).alias("tail"))
    dealt = docs.withColumns({"shard": shard, "also": also("doc_id")})
    dealt = dealt.select("doc_id", "text", F.explode(F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, extra))).alias("to"))
    dealt = ranges.deal(dealt.select("to.shard", "to.tail", "doc_id", "text"), starts).sortWithinPartitions("shard", "tail", "doc_id", "text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the document before, which still waits for the next one
        tailed: int | None = None
        for batch in common.slices(batches):
            data, at = common.utf8(batch.column(3))
            out = []
            for i, (shard, tail, doc_id) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if tail and tailed == shard:
                    continue  # rows that repeat the head's id
                own = data[at[i] : at[i + 1]]
                now = (shard, doc_id, own.tobytes(), p := precedences(own), digest(own, p))
                if held is not None and held[0] == shard:
                    out.append(_compare(held, now))
                held, tailed = (None, shard) if tail else (now, None)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(compute, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compare(held: tuple, following: tuple) -> tuple:
    """The result row of a document, given the one after it."""
    _, doc_id, raw, precedence, own = held
    n_chars, changed, kept = edited(raw, following[2])
    if changed == raw:
        other = own
    else:
        data = np.frombuffer(changed, np.uint8)
        added = len(changed) - kept
        # windows wholly within either text have their precedence already
        a, b = max(0, kept - WINDOW + 1), max(0, added - WINDOW + 1)
        middle = precedences(data[a : min(len(data), kept + WINDOW - 1)]) if len(data) >= WINDOW else np.empty(0, np.int32)
        joined = np.concatenate([precedence[:a], middle, following[3][:b]])[: max(0, len(data) - WINDOW + 1)]
        if len(joined) != max(0, len(data) - WINDOW + 1) or a == 0 or b == 0:
            joined = precedences(data)
        other = digest(data, joined)
    return doc_id, n_chars, changed.decode(), text_of(own), text_of(other), likeness(own, other), likeness(own, following[4])
