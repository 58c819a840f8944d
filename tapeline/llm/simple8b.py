"""Simple-8b word-aligned coding of unsigned integers, encoded and decoded by numpy over many blocks at once.

The low 4 bits of a 64-bit word are its selector, the other 60 hold a run of equally wide ids (lowest
first). Selector 15 is an escape: the next whole word is one id of up to 64 bits. Blocks of `BLOCK` ids
start on a word of their own, so that any block decodes without the ones before it.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Ids that are coded at a time, so that the arrays of a pass stay in a processor's cache.
PASS = 256 * BLOCK
#: Ids and bits of selectors 0..14, most ids first. Fixed values of the coding.
COUNTS = np.array([240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15

_NARROW = 1 << 16
_LIMITS = (np.uint64(1) << BITS.astype(np.uint64)) - np.uint64(1)
_NEED = np.searchsorted(_LIMITS, np.arange(_NARROW, dtype=np.uint64), "left").astype(np.uint8)


def _needs(values: np.ndarray) -> np.ndarray:
    """The narrowest selector for each value; 15 beyond 60 bits."""
    if values.max() < _NARROW:
        return _NEED[values.astype(np.int64)]
    return np.searchsorted(_LIMITS, values, "left").astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and, for each block and the end, the offset of its first word."""
    words, starts, at = [np.empty(0, np.uint64)], [np.zeros(1, np.uint64)], np.uint64(0)
    for first in range(0, len(ids), PASS):
        some, offsets = _encode(ids[first : first + PASS])
        words.append(some)
        starts.append(offsets[1:] + at)
        at += offsets[-1]
    return np.concatenate(words), np.concatenate(starts)


def _encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """encode() of one pass, a whole number of blocks but for the last."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    pad = int(COUNTS[0])
    lanes = np.zeros((blocks, BLOCK + pad), np.uint64)  # zeros after a block end fit every selector
    rows = np.zeros(blocks * BLOCK, np.uint64)
    rows[:n] = ids
    lanes[:, :BLOCK] = rows.reshape(blocks, BLOCK)
    need = _needs(lanes.ravel())
    longest = {1: need}
    size = 1
    for count in sorted(set(COUNTS.tolist()) - {1}):  # widest need among the next `count` ids
        while size * 2 <= count:
            a = longest[size]
            b = a.copy()
            np.maximum(a[:-size], a[size:], out=b[:-size])
            longest[size * 2] = b
            size *= 2
        if count not in longest:
            a, shift = longest[size], count - size
            b = a.copy()
            np.maximum(a[:-shift], a[shift:], out=b[:-shift])
            longest[count] = b
    best = np.full(len(need), ESCAPE, np.uint8)
    for selector in range(len(COUNTS) - 1, -1, -1):
        best[longest[int(COUNTS[selector])] <= selector] = selector
    best = best.reshape(blocks, BLOCK + pad)
    steps = np.append(COUNTS, 1)
    lane, at = np.arange(blocks), np.zeros(blocks, np.int64)
    ends = np.full(blocks, BLOCK)
    ends[-1] = n - (blocks - 1) * BLOCK
    got_lane, got_at, got_selector = [], [], []
    while len(lane):
        selector = best[lane, at]
        got_lane.append(lane)
        got_at.append(at)
        got_selector.append(selector)
        at = at + steps[selector]
        going = at < ends[lane]
        lane, at = lane[going], at[going]
    lane, at, selector = np.concatenate(got_lane), np.concatenate(got_at), np.concatenate(got_selector)
    order = np.argsort(lane, kind="stable")  # steps of a lane were gathered in order
    lane, at, selector = lane[order], at[order], selector[order]
    width = np.where(selector == ESCAPE, 2, 1)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    flat, base = lanes.ravel(), lane * (BLOCK + pad) + at
    for s in np.unique(selector):
        which = np.flatnonzero(selector == s)
        if s == ESCAPE:
            words[place[which]] = ESCAPE
            words[place[which] + 1] = flat[base[which]]
            continue
        word = np.full(len(which), s, np.uint64)
        if BITS[s]:
            for k in range(COUNTS[s]):
                word |= flat[base[which] + k] << np.uint64(4 + k * BITS[s])
        words[place[which]] = word
    starts = np.zeros(blocks + 1, np.uint64)
    starts[1:] = np.cumsum(np.bincount(lane, width, blocks)).astype(np.uint64)
    return words, starts


def decode(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n ids of consecutive blocks; `starts` are the blocks' word offsets and the end, as encode gives them."""
    out = [np.empty(0, np.uint64)]
    for first in range(0, len(starts) - 1, PASS // BLOCK):
        some = starts[first : first + PASS // BLOCK + 1]
        out.append(_decode(words[int(some[0]) : int(some[-1])], some - some[0], min(PASS, n - first * BLOCK)))
    return np.concatenate(out)


def _decode(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """decode() of one pass."""
    out = np.zeros(n, np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for p in np.flatnonzero(selector == ESCAPE):
        if not raw[p]:
            raw[p + 1] = True
    head = np.flatnonzero(~raw)
    selector = selector[head]
    block = np.searchsorted(starts.astype(np.int64), head, "right") - 1
    count = np.append(COUNTS, 1)[selector]
    before = np.cumsum(count) - count
    first = np.searchsorted(block, np.arange(len(starts) - 1))
    at = before - before[first][block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(selector):
        which = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[at[which]] = words[head[which] + 1]
            continue
        if not BITS[s]:
            continue
        word, mask = words[head[which]], _LIMITS[s]
        for k in range(COUNTS[s]):
            fits = at[which] + k < limit[which]
            out[at[which][fits] + k] = (word[fits] >> np.uint64(4 + k * BITS[s])) & mask
    return out
