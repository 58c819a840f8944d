"""SimHash links, compaction and source divergence against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeline.llm import common, compaction, divergence, query_compaction, query_dedup, query_divergence, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# ---- SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, distance):
    """Smallest reachable id of every (id, fingerprint); rows of one id are one document."""
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if i != j and (a ^ b).bit_count() <= distance:
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def prose(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "gamma", "Δelta", "eps", "ζ", "eta"]) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = prose(rng, 700).split()
    texts = [None, "", " \t\n", "one", "ONE", "two  words", "a b c d", "É é É", "x" * 3000, prose(rng, 9000)]
    for k in range(12):  # ever more words of a long text are changed
        w = list(base)
        for at in rng.sample(range(700), 2 * k):
            w[at] = f"z{at}"
        texts += [" ".join(w)] * (1 + k % 3)
    texts += [prose(rng, rng.randrange(1, 40)) for _ in range(60)]
    rows = [(7 * i % 211, t, None, "s", 1) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (3, texts[-1], None, None, None), (3, "another text of id three", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("hot", [256, 1])
def test_simhash(docs, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    clashing = docs.withColumnsRenamed({"lang": "fingerprint", "source": "component_id"}).withColumn("segment", F.lit(1))
    got = simhash.near_duplicates(clashing).collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.where("doc_id is not null").collect()]
    assert sorted((r.doc_id, int(r.fingerprint, 16)) for r in got) == sorted(rows)
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got)
    want = plain_components(rows, 3)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


def test_simhash_long_text_in_pieces(monkeypatch):
    text = prose(random.Random(1), 3000).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 97)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5, 7])
def test_links_of_a_dense_set(spark, monkeypatch, distance):
    """Fingerprints around a few centres, so that segments are hot; every distance the operator takes."""
    monkeypatch.setattr(simhash, "HOT", 8)
    rng = random.Random(distance)
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for c in (0, (1 << 64) - 1, 0x0123456789ABCDEF) for _ in range(90)}
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    found = simhash.links(spark.createDataFrame(rows, "n long, fingerprint long"), distance).collect()
    number = {p: i for i, p in rows}
    want = plain_components([(i, p % (1 << 64)) for i, p in rows], distance)
    up = {i: i for i in want}
    for _ in range(len(up)):
        before = dict(up)
        for a, b in found:
            assert ((a ^ b) % (1 << 64)).bit_count() <= distance
            low = min(up[number[a]], up[number[b]])
            up[number[a]] = up[number[b]] = low
        if up == before:
            break
    assert up == want


def test_forest_is_small():
    prints = np.arange(256, dtype=np.uint64)
    a, b = simhash.forest(prints, 1)
    assert sum(map(len, a)) == sum(map(len, b)) == 255


def test_simhash_of_nothing(spark):
    assert query_dedup.simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


# ---- compaction


def plain_first_fit(sizes, most):
    groups, out = [], []
    for size in sizes:
        k = next((k for k, g in enumerate(groups) if g + size <= most), len(groups))
        groups[k : k + 1] = [groups[k] + size if k < len(groups) else size]
        out.append(k)
    return out


def test_first_fit_staircase():
    rng = random.Random(3)
    for _ in range(300):
        most = rng.randrange(1, 60)
        sizes = [rng.randrange(1, most + 1) for _ in range(rng.randrange(70))]
        if rng.random() < 0.5:
            sizes.sort(reverse=True)
        assert compaction.first_fit(sizes, most) == plain_first_fit(sizes, most)


def plain_compaction(clicks):
    """The contract's rows by loops over a pandas table."""
    total = len(clicks)
    share = lambda x: 1 + total // x
    rows, starts = clicks.to_dict("records"), collections.defaultdict(list)
    for r in rows:
        r["day"] = None if pd.isna(r["arrived_at"]) else (r["arrived_at"] - pd.Timestamp(0)) // pd.Timedelta(days=1)
    days = collections.Counter(r["day"] for r in rows)
    for r in rows:
        h = zlib.crc32(("" if pd.isna(r["click_id"]) else str(int(r["click_id"]))).encode())
        starts[r["day"], h // 16 % (1 + days[r["day"]] // share(150)), min(h % 4, h // 4 % 4)].append(r)
    out = []
    for d in days:
        mine = sorted(((k, v) for k, v in starts.items() if k[0] == d), key=lambda x: (-len(x[1]), x[0]))
        small = [x for x in mine if len(x[1]) < share(600)]
        fits = plain_first_fit([len(v) for _, v in small], share(500))
        groups = [[x for x, k in zip(small, fits, strict=True) if k == g] for g in sorted(set(fits))]
        for g in groups + [[x] for x in mine if len(x[1]) >= share(600)]:
            order = lambda r: (not pd.isna(r["arrived_at"]), r["arrived_at"], not pd.isna(r["click_id"]), r["click_id"])
            of = [r for _, v in g for r in sorted(v, key=order if d is not None else lambda r: (not pd.isna(r["click_id"]), r["click_id"]))]
            ids = [None if pd.isna(r["click_id"]) else int(r["click_id"]) for r in of]
            known = [i for i in ids if i is not None]
            cents = sum(0 if pd.isna(r["value"]) else math.floor(100 * r["value"] + 0.5) for r in of)
            sha = hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest()
            out.append((*g[0][0], len(of), min(known, default=None), max(known, default=None), cents, ",".join(f"{k[1]}-{k[2]}" for k, _ in g), sha, len(g) > 1))
    return sorted(out, key=str)


def columns_of(rows):
    return sorted(((r.day, r.lot, r.piece, r.n_rows, r.min_click_id, r.max_click_id, r.cents, r.sources, r.ids_sha256, r.rewritten) for r in rows), key=str)


def data_files(spark, path):
    return {r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path").collect()}


def test_compaction_of_clicks(spark):
    got = query_compaction.op12_compaction(spark, SF).collect()
    assert columns_of(got) == plain_compaction(pd.read_parquet(f"{SF}/clicks.parquet"))
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)
    top = got[0].path.split("/day=")[0]
    assert {p.replace("file:///", "file:/") for p in data_files(spark, top)} == {r.path.replace("file:///", "file:/") for r in got}
    table = spark.read.parquet(f"{SF}/clicks.parquet")
    assert spark.read.parquet(top).select(table.columns).exceptAll(table).isEmpty() and {r.columns for r in got} == {",".join(table.columns)}


def test_compaction_of_odd_clicks(spark, tmp_path):
    """Null days and ids, a day with most rows, repeated rows, and columns named like the operator's own."""
    rng = random.Random(9)
    stamp = lambda d: (pd.Timestamp("2024-03-01") + pd.Timedelta(days=d, seconds=rng.randrange(9))).to_pydatetime()
    rows = [(rng.choice([None, *range(400)]), stamp(rng.choice([0] * 20 + list(range(9)))) if rng.random() < 0.95 else None, rng.choice([None, 1.005, -2.5, 7.0]), "x", k) for k in range(900)]
    rows += rows[:40]
    table = spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, value double, Day string, lots long")
    got = query_compaction.compact_clicks(table, f"file://{tmp_path}/odd").collect()
    frame = pd.DataFrame(rows, columns=["click_id", "arrived_at", "value", "Day", "lots"])
    frame["arrived_at"] = pd.to_datetime(frame["arrived_at"])
    assert columns_of(got) == plain_compaction(frame)
    back = spark.read.parquet(f"file://{tmp_path}/odd")
    assert back.select(table.columns).exceptAll(table).isEmpty() and table.exceptAll(back.select(table.columns)).isEmpty()
    assert back.select(table.columns).dtypes == table.dtypes


def test_compaction_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "click_id long, arrived_at timestamp_ntz, value double")
    assert query_compaction.compact_clicks(none, f"file://{tmp_path}/none").collect() == []


def test_interrupted_compaction_goes_on(spark, tmp_path, monkeypatch):
    path, columns = f"file://{tmp_path}/broken", ["v", "at"]
    table = spark.range(300).selectExpr("id AS v", "timestamp_seconds(id) AS at")
    compaction.write_files(table, path, columns, (F.lit(1), F.col("v") % 6, F.lit(0)), ["v"], 3)
    before = {r.path for r in compaction.files_of(spark, path, columns).collect()}
    sound, calls = compaction._each, []

    def broken(rows, work):
        calls.append(1)
        if len(calls) == 2:  # all is merged, half of the sources are gone, and the driver dies
            sound(rows.limit(1), work)
            raise RuntimeError
        sound(rows, work)

    monkeypatch.setattr(compaction, "_each", broken)
    with pytest.raises(RuntimeError):
        compaction.compact(spark, path, columns, small=100, most=120)
    monkeypatch.setattr(compaction, "_each", sound)
    done = compaction.compact(spark, path, columns, small=100, most=120).collect()
    assert [(r.n_rows, [s.lot for s in r.sources]) for r in sorted(done, key=lambda r: r.lot)] == [(100, [0, 1]), (100, [2, 3]), (100, [4, 5])]
    back = spark.read.parquet(path)
    assert back.select(columns).dtypes == table.dtypes and sorted(r.v for r in back.collect()) == list(range(300))
    assert len(before) == 6 and not before & {r.path for r in done}
    assert [r.v for r in spark.read.parquet(min(done, key=lambda r: r.lot).path).collect()] == [*range(0, 300, 6), *range(1, 300, 6)]


def test_concatenated_groups_stay_small(tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "GROUP_BYTES", 1000)
    monkeypatch.setattr(compaction, "BATCH_ROWS", 50)
    for k in range(3):
        pq.write_table(pa.table({"x": [1000 * k + i for i in range(200)]}), tmp_path / f"{k}.parquet")
    compaction.concatenate([f"file://{tmp_path}/{k}.parquet" for k in range(3)], f"file://{tmp_path}/out", "all.parquet")
    found = pq.ParquetFile(tmp_path / "out/all.parquet")
    assert found.metadata.num_row_groups > 3 and found.read().column("x").to_pylist() == [1000 * k + i for k in range(3) for i in range(200)]


# ---- divergence


def plain_divergence(rows, min_docs, top):
    """The contract by Python's whole numbers; rows: (text, lang, source)."""
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        of = [r for r in rows if r[1] == lang]
        seen = collections.Counter(t for w, _, _ in of for t in set(w))
        kept = [t for t, n in seen.items() if n >= min_docs]
        counts = {s: collections.Counter(t for w, _, x in of if x == s for t in w) for s in {r[2] for r in of}}

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(2)
    rows = [(prose(rng, rng.randrange(30)) + rng.choice(["", " naïve NAÏVE", "!? 12", "あ Ab"]), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", "É", None, "Z"]), k) for k in range(300)]
    rows += [(None, "de", "x", 1), ("", "de", "y", 2), ("rare words", "de", None, 3), (prose(rng, 4000), "en", "only", 4), ("solo", "it", "alone", 5)] + rows[:20]
    table = spark.createDataFrame(rows, "text string, lang string, source string, term long").withColumn("place", F.lit("p")).repartition(4)
    got = divergence.divergence(table, min_docs=10, top=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = plain_divergence([r[:3] for r in rows], 10, 5)
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[2] == "pair" and r[4] == 0 for r in want) and any(r[0] == "en" and r[2] == "term" for r in want)


def test_divergence_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_divergence([(r.text, r.lang, r.source) for r in docs.collect()], 10, 10)
    assert sorted(map(tuple, query_divergence.op13_source_divergence(spark, SF).collect())) == want


def test_shares_of_large_counts(spark):
    rows = [(0, 10**15, 7), (10**14, 9 * 10**14, 10**12), (5, 5, 1), (8 * 10**15, 8 * 10**15, 1)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    assert common.staged_so_far() >= 0
