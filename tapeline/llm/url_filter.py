"""URL rules by a cascade of Bloom filters, exact over the corpus's whole key universe and without joins.

A rule is a host and a path prefix; it fits the host and its subdomains. A URL's keys are the pairs of a
suffix of its host and a prefix of its path as long as some rule's. Level 1 of the cascade encodes the
listed keys; level 2 those keys of the corpus that level 1 accepts wrongly; level 3 the listed keys that
level 2 accepts; and so on until a level accepts nothing wrongly. A key is then listed exactly if the first
level that rejects it is an even one (or, where none does, if the number of levels is odd).

Level 1 is sized so that about as many keys pass wrongly as are listed, which bounds every later level by
the rules, not by the corpus; if more than `MOST_WRONG` pass, it is built again with a finer filter. Rules
are limited to `MOST_RULES`. A second cascade tells allowing from blocking rules among the listed keys.

Null URLs and URLs without `://` have an empty host and path; no rule fits them and they are allowed.
Repeated rows each get a result. Rows without an id are left out; columns beyond id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common

MOST_RULES = 5_000_000
MOST_WRONG = 1_000_000
#: False-positive rate of the levels after the first; it makes their sizes fall fastest for the bits spent.
LATER_RATE = 0.5

_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def key(self) -> str:
        return self.host + self.path


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end].translate(_LOWER), rest[end:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host, path[:end]


def keys(host: str, path: str, path_lengths: Iterable[int]) -> list[str]:
    """Every key that a rule fitting this host and path could have, longest host first."""
    if not host:
        return []
    prefixes = [path[:n] for n in path_lengths if n <= len(path)]
    out = []
    while True:
        out += [host + p for p in prefixes]
        _, dot, host = host.partition(".")
        if not dot:
            return out


def hashed(found: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each key."""
    out = np.empty((len(found), 2), np.uint64)
    for i, key in enumerate(found):
        x = xxhash.xxh3_128_intdigest(key)
        out[i, 0], out[i, 1] = x & 0xFFFFFFFFFFFFFFFF, x >> 64 | 1
    return out


@dataclass(frozen=True)
class Bloom:
    bits: np.ndarray
    probes: int
    level: int

    @classmethod
    def of(cls, items: np.ndarray, rate: float, level: int) -> Bloom:
        size = max(64, int(np.ceil(-len(items) * np.log(rate) / np.log(2) ** 2)))
        empty = cls(np.zeros(-(-size // 8), np.uint8), max(1, round(-np.log2(rate))), level)
        at = empty._at(items).ravel()
        np.bitwise_or.at(empty.bits, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
        return empty

    def _at(self, items: np.ndarray) -> np.ndarray:
        k = np.arange(1, self.probes + 1, dtype=np.uint64) + np.uint64(64 * self.level)
        # mixed after the sum: else small filters would repeat the same collisions level after level
        return common.mix(items[:, :1] + k * items[:, 1:]) % np.uint64(len(self.bits) * 8)

    def accepts(self, items: np.ndarray) -> np.ndarray:
        at = self._at(items)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


class Cascade:
    """Exact membership for the keys it was built over."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @classmethod
    def of(cls, first: Bloom, listed: np.ndarray, wrong: np.ndarray) -> Cascade:
        """first: the level of the listed keys; wrong: all other keys of the universe that it accepts."""
        levels, inside, outside = [first], listed, wrong
        while len(outside):
            levels.append(Bloom.of(outside, LATER_RATE, len(levels)))
            inside, outside = outside, inside[levels[-1].accepts(inside)]
            # now `inside` is encoded and `outside` are the keys of the other kind that pass
        return cls(levels)

    def lists(self, items: np.ndarray) -> np.ndarray:
        out = np.zeros(len(items), bool)
        alive = np.arange(len(items))
        for depth, level in enumerate(self.levels):
            passed = level.accepts(items[alive])
            out[alive[~passed]] = depth % 2 == 1
            alive = alive[passed]
        out[alive] = len(self.levels) % 2 == 1
        return out


def build(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> Cascade:
    """The cascade of all rules' keys over every key of the pages' URLs."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; the cascade is built on the driver for {MOST_RULES} at most")
    listed_keys = sorted({r.key for r in rules})
    listed, known, lengths = hashed(listed_keys), frozenset(listed_keys), _lengths(rules)
    if not rules:
        return Cascade([Bloom.of(listed, 0.5, 0)])
    universe = max(1, pages.count()) * 4 * len(lengths)  # about; only the sizes depend on it
    rate = min(0.5, max(1e-12, len(listed) * np.sqrt(0.5) / universe))
    while True:
        first = Bloom.of(listed, rate, 0)

        def wrong(batches: Iterator[pa.RecordBatch], first: Bloom = first) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = sorted({k for u in batch.column(0).to_pylist() for k in keys(*split(u), lengths)} - known)
                got = [found[i] for i in np.flatnonzero(first.accepts(hashed(found)))] if found else []
                yield pa.RecordBatch.from_pydict({"key": pa.array(got, pa.string())})

        passing = pages.select(F.col(url_col).cast("string")).mapInArrow(wrong, "key string").distinct()
        got = [r[0] for r in passing.limit(MOST_WRONG + 1).collect()]
        if len(got) <= MOST_WRONG:
            return Cascade.of(first, listed, hashed(sorted(got)))
        rate /= 64


def _lengths(rules: list[Rule]) -> list[int]:
    return sorted({len(r.path) for r in rules}, reverse=True)


def judge(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null) and verdict (allow or block)."""
    cascade, lengths = build(pages, rules, url_col), _lengths(rules)
    allowing, blocking = ({r.key for r in rules if r.allow == kind} for kind in (True, False))
    if allowing & blocking:
        raise ValueError(f"both allowed and blocked: {sorted(allowing & blocking)[:3]}")
    allowed = hashed(sorted(allowing))
    first = Bloom.of(allowed, 0.5, 64)
    others = hashed(sorted(blocking))
    allows = Cascade.of(first, allowed, others[first.accepts(others)])

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split(u) for u in batch.column(1).to_pylist()]
            found = [keys(h, p, lengths) for h, p in parts]
            flat, row = [k for ks in found for k in ks], np.repeat(np.arange(len(found)), [len(ks) for ks in found])
            items = hashed(flat)
            rule: list[str | None] = [None] * len(parts)
            verdict = ["allow"] * len(parts)
            which = np.flatnonzero(cascade.lists(items))
            for i, allow in zip(which.tolist(), allows.lists(items[which]).tolist(), strict=True):
                r = int(row[i])
                if rule[r] is None or len(flat[i]) > len(rule[r]):
                    rule[r], verdict[r] = flat[i], "allow" if allow else "block"
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], rule, verdict))],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).where("page_id is not null")
    return rows.mapInArrow(verdicts, "page_id long, host string, path string, rule string, verdict string")
