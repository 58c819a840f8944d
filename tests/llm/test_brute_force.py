"""Fingerprints by plain loops, rows that repeat, and special tokens."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import decontaminate, fingerprint, html_text, packing, query_pages, query_text, suffix_dedup, url_filter, warc
from tapeline.llm import token_output as tok

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

MASK = (1 << 64) - 1
BASE, SCHEMA = 0x9E3779B97F4A7C15 | 1, "doc_id long, text string, lang string, source string, n_chars long"


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        x ^= x >> shift
        x = x * factor & MASK if factor else x
    return x


def gram_hash(gram, ascending):
    """The polynomial hash of bytes, with the base's power rising or falling along them."""
    powers = range(len(gram)) if ascending else range(len(gram) - 1, -1, -1)
    return mixed(sum((b + 1) * pow(BASE, p, 1 << 64) for b, p in zip(gram, powers, strict=True)) & MASK)


def plain_features(raw):
    """Places of the features of a text of SHORT bytes or more."""
    table = fingerprint.precedence_table()
    ranks = []
    for i in range(len(raw) - 63):
        counts = collections.Counter(raw[i : i + 64]).values()
        entropy = (6 - sum(c * math.log2(c) for c in counts) / 64) / 6
        ranks.append(int(table[int(entropy * 1000 + 1e-6)]))
    wins = collections.Counter()
    width = min(64, len(ranks))
    for i in range(len(ranks) - width + 1):
        best = max(range(i, i + width), key=lambda k: (ranks[k], -k))
        if ranks[best]:
            wins[best] += 1
    return sorted(k for k, n in wins.items() if n >= min(16, len(ranks)))


def plain_fingerprint(raw):
    if not raw:
        return []
    if len(raw) < 256:
        n = min(8, len(raw))
        hashes = [gram_hash(raw[i : i + n], False) for i in range(len(raw) - n + 1)]
    else:
        hashes = [gram_hash(raw[i : i + 64], True) for i in plain_features(raw)] or [gram_hash(raw, True)]
    hashes = list(dict.fromkeys(hashes))
    filters = []
    for k in range(0, len(hashes), 160):
        filters.append({(h >> 11 * probe) % 2048 for h in hashes[k : k + 160] for probe in range(5)})
    return filters


def plain_text(filters):
    raw = bytearray(256 * len(filters))
    for k, bits in enumerate(filters):
        for b in bits:
            raw[256 * k + b // 8] |= 128 >> b % 8
    return f"{len(filters)}:{raw.hex()}"


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if a == b:
        return 1.0
    a, b = sorted((a, b), key=len)
    scores = []
    for x in a:
        chances = [(y, len(x) * len(y) / 2048) for y in b]
        scores.append(max(0.0, max((len(x & y) - c) / max(min(len(x), len(y)) - c, 1e-9) for y, c in chances)))
    return min(1 - 1e-9, sum(s * len(x) for s, x in zip(scores, a, strict=True)) / sum(map(len, a)))


def test_fingerprints_equal_plain_loops(spark):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(1, 9)))) for _ in range(n))
    texts = [prose(120), None, "é" * 130, prose(20), "", "abc", prose(900), "x" * 300, prose(60) + "ñö" * 40]
    texts.append(texts[0][:500] + prose(10) + texts[0][520:])
    rows = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame([(7 * i - 11, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert len(rows) == len(texts)
    known = [t or "" for t in texts]
    for i, t in enumerate(known):
        following = known[(i + 1) % len(known)]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        own, other, after = (plain_fingerprint(x.encode()) for x in (t, edited, following))
        r = rows[7 * i - 11]
        assert (r.fingerprint, r.edited_fingerprint) == (plain_text(own), plain_text(other))
        assert r.near_edited == pytest.approx(plain_likeness(own, other), abs=1e-12) and r.near_next == pytest.approx(plain_likeness(own, after), abs=1e-12)


@pytest.fixture(scope="module")
def documents(spark):
    words = [f"w{i * i % 97}" for i in range(300)]
    rows = [(3, " ".join(words)), (1, " ".join(words[40:200]) + "\nend"), (2, None), (-5, ""), (9, "A short, plain text."), (8, "<|endoftext|> a <|startoftext|>b")]
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA)


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_rows_that_repeat(spark, documents, tmp_path):
    twice = documents.unionByName(documents)
    bench = spark.createDataFrame([("i", " ".join(f"w{i * i % 97}" for i in range(50, 80)))], "item_id string, text string")
    each = {
        "language": lambda d: (query_text.identify_documents(d), ("doc_id", "held_out")),
        "decontaminate": lambda d: (decontaminate.decontaminate(d, bench), ("doc_id", "n_words", "n_hit")),
        "fingerprint": lambda d: (fingerprint.fingerprints(d), ("doc_id", "n_chars", "fingerprint")),
        "suffix": lambda d: (suffix_dedup.attach(d, suffix_dedup.repeated_spans(d, 40)), ("doc_id", "n_bytes")),
        "packing": lambda d: (packing.best_fit(d, public_tokenizers.path("byte_bpe_50k.json"), 2, 64), ("doc_id", "piece", "start", "length", "ids_crc32")),
    }
    for name, run in each.items():
        once, both = counted(*run(documents)[:1], *run(documents)[1]), counted(*run(twice)[:1], *run(twice)[1])
        assert both == {k: 2 * n for k, n in once.items()} and once.total() >= documents.count(), name
    copies = fingerprint.fingerprints(twice).collect()
    assert sum(r.near_next == 1.0 for r in copies) >= documents.count()  # a row and its copy follow one another
    whole = suffix_dedup.attach(twice, suffix_dedup.repeated_spans(twice, 40)).withColumn("kept", suffix_dedup.remaining()).collect()
    assert all(not r.kept for r in whole if r.n_bytes >= 40)  # a copy is an occurrence elsewhere
    tok.write(twice, f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"), 2)
    tokens = tok.read(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in tokens] == sorted([3, 1, 2, -5, 9, 8] * 2)


def test_pages_that_repeat(spark, tmp_path):
    rows = [(4, "http://a.example.com/en/7?x", "<article><p>some words of the article itself</p></article>" * 30), (2, None, None), (5, "http://a.example.com/en/8", "<nav>x</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    twice = pages.unionByName(pages)
    for run, columns in ((lambda d: html_text.extract(d), ("page_id", "text", "n_chars")), (lambda d: url_filter.judge(d, query_pages.RULES), ("page_id", "host", "path", "rule", "verdict"))):
        assert counted(run(twice), *columns) == {k: 2 * n for k, n in counted(run(pages), *columns).items()}
    warc.write(twice, f"file://{tmp_path}/w")
    got = counted(warc.read(spark, f"file://{tmp_path}/w"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == {(i, len(raw), hashlib.sha1(raw).hexdigest(), "response", None): 2 for i, _, h in rows for raw in [(h or "").encode()]}


def test_token_files_roll(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tok, "FILE_IDS", 1000)
    monkeypatch.setattr(tok.ranges, "FEW", 1)
    sizes = {i: 150_000 + i for i in range(7)}
    long = spark.createDataFrame([(i, "word " * (n - 1)) for i, n in sizes.items()], "doc_id long, text string")
    tok.write(long, f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"), 2)
    got = {r.doc_id: (r.start, r.n_tokens) for r in tok.read(spark, f"file://{tmp_path}/t").collect()}
    assert got == {i: (sum(n for j, n in sizes.items() if j < i), sizes[i]) for i in sizes}
    entries = tok.files.read_manifest(f"file://{tmp_path}/t")
    assert any(e["part"] for e in entries) and [e["name"] for e in entries] == sorted(e["name"] for e in entries)


def test_shards_are_cut_by_weight(spark):
    from tapeline.llm import ranges

    rows = spark.createDataFrame([(i * i, 3 << 20) for i in range(40)] + [(1 << 60, 1)], "id long, weight long")
    starts = ranges.bounds(rows, "id", F.col("weight"))
    dealt = ranges.deal(rows.withColumn("shard", ranges.shard_of(starts)("id")), starts).withColumn("part", F.spark_partition_id())
    heavy = {r.shard: (r.w, r.parts, r.one) for r in dealt.groupBy("shard").agg(F.sum("weight").alias("w"), F.count_distinct("part").alias("parts"), F.min(F.col("part") == F.col("shard")).alias("one")).collect()}
    assert 20 <= len(starts) <= 60 and all(w <= 6 << 20 and parts == 1 and one for w, parts, one in heavy.values())
    assert ranges.bounds(rows.limit(0), "id", F.col("weight")) == []
