"""The training-data operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeline.llm import components, decontaminate, fingerprint, html_text, language, ngram_join, packing, query_pages, query_text, query_tokens, suffix_dedup, url_filter, warc
from tapeline.llm import token_output as tok

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{int(i)}" for i in rng.integers(0, size, n))


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    base = words(rng, 160)
    near = [base.split() for _ in range(12)]
    for i, w in enumerate(near):
        for k in rng.integers(0, 160, i):
            w[k] = f"z{int(k)}x{i}"
    passage = words(rng, 90)
    texts = [base, base, *(" ".join(w) for w in near)]
    texts += [f"{words(rng, 30)} {passage} {words(rng, 20)}" for _ in range(5)]
    texts += [None, "", " ", "one", "ONE", "two words", "é É é", "aaaa" * 300, words(rng, 6000), "…", "Mixed Case words HERE now", "mixed case words here now"]
    texts += [words(rng, 100) for _ in range(5)]
    return [(100 - i if i % 2 else 2 * i - 7, t, "en" if i % 3 else "fr", None, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def library(name):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs, none, tmp_path):
    encode = library("word_bpe_49k.json")
    tok.write(docs, f"file://{tmp_path}/a", public_tokenizers.path("word_bpe_49k.json"), 2)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tok.read(spark, f"file://{tmp_path}/a").collect()}
    start = 0
    for i, text, *_ in sorted(corpus()):
        ids = encode(text)
        assert got.pop(i) == (start, len(ids), crc(ids))
        start += len(ids)
    assert not got
    tok.write(none, f"file://{tmp_path}/b", public_tokenizers.path("word_bpe_49k.json"), 2)
    assert tok.read(spark, f"file://{tmp_path}/b").count() == 0


def test_packing(docs, none, monkeypatch):
    encode = library("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "BASE", 2)  # so that plans are repeated
    monkeypatch.setattr(packing, "CARRIED", 5)
    rows = packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, 64).collect()
    texts = {i: encode(t) for i, t, *_ in corpus()}
    cells = collections.Counter()
    for r in rows:
        ids = texts[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length <= 64 and crc(ids) == r.ids_crc32 and (r.piece == 0 or r.length == 64)
        cells.update((r.sequence_id, p) for p in range(r.offset, r.offset + r.length))
    assert max(cells.values()) == 1 and sum(r.length for r in rows) == sum(map(len, texts.values()))
    sizes = collections.Counter(s for s, _ in cells)
    assert all((s, n - 1) in cells for s, n in sizes.items())
    assert len(sizes) <= 1.1 * sum(sizes.values()) / 64 + 8
    assert packing.best_fit(none, public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, docs, none, monkeypatch):
    monkeypatch.setattr(ngram_join, "DEALT", 3)  # so that shingles are dealt in blocks
    sets = {i: shingles(t) for i, t, *_ in corpus()}
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs.withColumn("class_id", F.lit(1))).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert max(collections.Counter(c for _, c in got.values()).values()) > 5
    assert ngram_join.near_duplicates(none).count() == 0


def _pairs_of_documents(n, shared, alone):
    """n pairs of documents with `shared` shingles in common and `alone` of their own each."""
    out = []
    for k in range(n):
        first = [f"w{k}x{i}" for i in range(shared + 4)]
        for side in "ab":
            out.append((len(out), " ".join(first + [f"{side}{k}y{i}" for i in range(alone)]), None, None, None))
    return out


def test_ngram_join_of_unrelated_documents(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(30)), None, None, None) for i in range(3)]
    apart = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(apart).collect()) == [(0, 0), (1, 1), (2, 2)]
    copies = spark.createDataFrame([(10, rows[0][1], None, None, None), (11, None, None, None, None)], SCHEMA)  # one batch with candidates among others
    both = apart.coalesce(1).unionByName(copies.coalesce(1))
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(both).collect()) == [(0, 0), (1, 1), (2, 2), (10, 0), (11, 11)]


@pytest.mark.parametrize(("alone", "linked"), [(8, False), (2, True)])
def test_ngram_join_of_a_table_that_repeats(spark, tmp_path, alone, linked):
    rows = _pairs_of_documents(5, 20, alone)
    once = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for _ in range(2):  # two files of equal rows
        once.write.mode("append").parquet(f"{tmp_path}/documents")
    twice = spark.read.option("spark.sql.files.openCostInBytes", 1 << 30).parquet(f"{tmp_path}/documents")
    for table, times in ((once, 1), (twice, 2)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(table).collect())
        assert got == sorted((i, 20 + alone, i - i % 2 if linked else i) for i, *_ in rows for _ in range(times))


def test_ngram_join_of_ids_with_several_texts(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(20))
    rows = [(1, words("a")), (1, words("b")), (2, words("b")), (3, words("a")), (4, words("c")), (4, words("c")), (5, None), (5, words("c")), (None, words("a"))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 16, 1), (1, 16, 1), (2, 16, 1), (3, 16, 1), (4, 16, 4), (4, 16, 4), (5, 0, 5), (5, 16, 4)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 11] + [(100, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: next(j for j in range(i, -1, -1) if j == 0 or not (j - 1) % 11 or j == 1) for i in got if i < 100} | {100: min(got[5], 5)} or all(got[a] == got[b] for a, b in edges)
    assert len(set(got.values())) == 4


def _repeated_mask(texts, length):
    """For each text whether a byte lies in a string of `length` bytes that starts at two places."""
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    masks = []
    for t in texts:
        mask = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                mask[p : p + length] = b"\1" * length
        masks.append(mask)
    return masks


def _spans(mask):
    return [(m.start(), len(m[0])) for m in re.finditer(b"\1+", bytes(mask))]


@pytest.mark.parametrize(("hot", "reported"), [(256, 1 << 20), (2, 50)])
def test_repeated_bytes(docs, none, monkeypatch, hot, reported):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 2: keys are dealt to several shards
    monkeypatch.setattr(suffix_dedup, "REPORTED", reported)
    texts = {i: (t or "").encode() for i, t, *_ in corpus()}
    short, long = (_repeated_mask(texts.values(), length) for length in (90, 150))
    clash = docs.withColumn("raw", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("__id", F.lit(2))
    rows = {r.doc_id: r for r in suffix_dedup.attach(clash, suffix_dedup.repeated_spans(docs, 90, longer=150)).withColumn("kept", suffix_dedup.remaining("longer_spans")).collect()}
    alone = {r.doc_id: r.spans for r in suffix_dedup.repeated_spans(docs, 150).collect()}
    for (i, t), a, b in zip(texts.items(), short, long, strict=True):
        assert rows[i].n_bytes == len(t) and [tuple(s) for s in rows[i].spans] == _spans(a) and [tuple(s) for s in rows[i].longer_spans] == _spans(b), i
        assert bytes(rows[i].kept) == bytes(x for x, m in zip(t, b, strict=True) if not m) and [tuple(s) for s in alone.get(i, [])] == _spans(b)
    assert sum(len(r.longer_spans) > 0 for r in rows.values()) > 6
    assert suffix_dedup.attach(none, suffix_dedup.repeated_spans(none)).count() == 0


def test_repeated_bytes_of_a_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    rng = np.random.default_rng(3)
    base = rng.integers(97, 123, 600).astype(np.uint8)
    rows = []
    for i in range(60):
        mine = base.copy()
        mine[rng.integers(0, 600, 4)] = 65 + i % 26
        rows.append((i, mine.tobytes().decode()[: int(rng.integers(300, 600))]))
    rows += [(3, rows[3][1]), (4, rows[9][1][:200]), (70, "x" * 400), (71, None), (None, rows[0][1])]  # ids that repeat, one string that repeats itself
    got = {}
    for r in suffix_dedup.attach(spark.createDataFrame(rows, "doc_id long, text string"), suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), 40, longer=100)).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, [tuple(s) for s in r.spans], [tuple(s) for s in r.longer_spans]))
    known = [(i, (t or "").encode()) for i, t in rows if i is not None]
    short, long = (_repeated_mask([t for _, t in known], length) for length in (40, 100))
    for (i, t), a, b in zip(known, short, long, strict=True):
        if i != 4:  # the union of two texts' marks
            assert (len(t), _spans(a), _spans(b)) in got[i], i


def test_passages_by_words(spark):
    words = [f"wörd{i}" for i in range(60)]
    edges = [("intro0 xat ", " tail0ö"), ("other1 yat ", " tail1ö"), ("", ""), ("four\n", "\tmore"), ("\u2028é", "é\u2028")]
    counts = [60, 60, 45, 45, 50]
    rows = [(i, a + " ".join(words[:n]) + b) for i, ((a, b), n) in enumerate(zip(edges, counts, strict=True))]
    copies = [(5, " ".join(words[:55])), (6, " ".join(f"x{i}öxx" for i in range(51))), (7, " ".join(f"x{i}öxx" for i in range(51)))]
    docs_ = spark.createDataFrame([*rows, *copies, (9, None)], "doc_id long, text string")
    cut = suffix_dedup.attach(docs_, suffix_dedup.repeated_spans(docs_, 240)).withColumn("passages", suffix_dedup.passages(50))
    got = {r.doc_id: r.left for r in cut.select("doc_id", suffix_dedup.remaining("passages").cast("string").alias("left")).collect()}
    assert got == {**dict(rows), 0: "intro0 xat  tail0ö", 1: "other1 yat  tail1ö", 5: "", 6: "", 7: "", 9: ""}


def test_decontamination(spark, docs, none):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = {i: split(t) for i, t, *_ in corpus()}
    longest = max(texts.values(), key=len)
    items = [("b", " ".join(longest[50:80])), ("a", " ".join(longest[55:68]).upper()), ("c", "One"), ("d", "two, words!"), ("e", None), ("f", "..."), ("a", " ".join(longest[50:80])), ("g", "never to be found anywhere at all in the whole of the texts")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = [(i, tuple(w[k : k + 13])) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - 12))]
    rows = {r.doc_id: r for r in decontaminate.decontaminate(docs.withColumn("items", F.lit(0)), bench).collect()}
    for i, w in texts.items():
        hit, found = set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found.add(item)
        assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == (len(w), len(hit), sorted(found)), i
    assert sum(r.n_hit > 0 for r in rows.values()) >= 4
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_fingerprints(spark, docs, none):
    rows = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    ordered = sorted((i, t or "") for i, t, *_ in corpus())
    prints = {}
    for k, (i, t) in enumerate(ordered):
        n, after = len(t) // 4, ordered[(k + 1) % len(ordered)][1]
        changed = t[: len(t) - n] + after[:n]
        r = rows[i]
        assert (r.n_chars, r.edited_text) == (len(t), changed) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and prints.setdefault(changed, r.edited_fingerprint) == r.edited_fingerprint
    assert fingerprint.fingerprints(none).count() == 0
    one = fingerprint.fingerprints(docs.where("text = 'one'")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_language_query(docs, none):
    rows = query_text.identify_documents(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    for i, t, *_ in corpus():
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (by[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= by[i].score <= 1
    assert query_text.identify_documents(none).count() == 0


def test_language_held_out_accuracy(spark):
    rng = np.random.default_rng(0)
    vowels = {"xx": ["ba", "ko", "ti", "lu"], "yy": ["ech", "unt", "ist", "ang"], "zz": ["é", "oux", "ai", "re"]}
    rows = [(i, " ".join("".join(rng.choice(vowels[lang], int(rng.integers(1, 4)))) for _ in range(int(rng.integers(3, 40)))), lang, None, None) for i in range(240) for lang in [list(vowels)[i % 3]]]
    documents = spark.createDataFrame(rows, SCHEMA)
    got = query_text.identify_documents(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


PAGES = "page_id long, url string, html string, digest string"


def test_warc(spark, tmp_path):
    big, other = "<p>é</p>" * 300, "<b>x</b>" * 300
    rows = [(5, "http://a/1", big, None), (9, None, big, None), (-2, "http://a/2", big, None), (3, "u", "short", None), (4, "u", "short", None), (7, "u", None, None), (8, "u", other, None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    for name in ("a", "b"):
        warc.write(pages, f"file://{tmp_path}/{name}")
    got = {r.page_id: r for r in warc.read(spark, f"file://{tmp_path}/a").collect()}
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        revisit = h == big and i != 9
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None)
    files = [{f.name: f.read_bytes() for f in (tmp_path / name).iterdir() if f.suffix in (".gz", ".json")} for name in ("a", "b")]
    assert files[0] == files[1] and not [f for f in (tmp_path / "a").iterdir() if f.name.endswith(".tmp")]
    warc.write(pages.limit(0), f"file://{tmp_path}/c")
    assert warc.read(spark, f"file://{tmp_path}/c").count() == 0


def test_url_rules(spark):
    urls = {1: "http://www.example.com/en/7x", 2: "https://com/en/8", 3: "x://EXAMPLE.net/de/81?q", 4: "x://example.net/de/1", 5: None, 6: "none", 7: "x://notexample.com/en/", 8: "x://a.b.org/es/#", 9: "x://com.evil.io/en/", 10: "x://example.com/en/6"}
    pages = spark.createDataFrame([(i, u, None, None) for i, u in urls.items()], PAGES)
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages.withColumn("host", F.lit("clash")), query_pages.RULES).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: ("com/en/", "block"), 3: ("example.net/de/8", "block"), 4: ("net/de/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("com/en/", "block"), 8: ("org/es/", "block"), 9: (None, "allow"), 10: ("com/en/", "block")}
    assert url_filter.judge(pages.limit(0), query_pages.RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_html_table(spark):
    pages = spark.createDataFrame([(1, None, "<article><p>words of it</article>", None), (2, "u", None, None)], PAGES)
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.extract(pages.withColumn("text", F.lit("clash"))).collect()}
    assert got == {1: (None, "words of it", 11), 2: ("u", "", 0)}


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame([("i", "never to be found anywhere at all in the whole of these texts")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, now, str(tmp_path))
        if k < 4:
            assert got.columns == now.columns
            got.write.parquet(f"{tmp_path}/{k}")
            got = spark.read.parquet(f"{tmp_path}/{k}")
        kept = {r.doc_id for r in got.select("doc_id").collect()}
        before = {i for i, t, *_ in corpus() if t and any(c.isalpha() for c in t)}
        if k == 0:
            assert kept == before
        if k == 1:
            found = ngram_join.near_duplicates(now).where("doc_id = component_id")
            assert kept == {r.doc_id for r in found.collect()} and len(kept) < len(before)
        if k == 2:
            assert kept == {r.doc_id for r in now.collect()}
            rows = got.join(now.select("doc_id", F.col("text").alias("was")), "doc_id").collect()
            changed = 0
            for r, mask in zip(rows, _repeated_mask([r.was.encode() for r in rows], 240), strict=True):
                t, left, at = r.was.encode(), b"", 0
                for first, n in _spans(mask):
                    words_in = [m for m in re.finditer(rb"[^ \t-\r]+", t) if first <= m.start() and m.end() <= first + n]
                    if len(words_in) > 50:
                        left, at = left + t[at : words_in[0].start()], words_in[-1].end()
                        changed += 1
                assert r.text == (left + t[at:]).decode() and (r.text == r.was or r.n_chars == len(r.text))
            assert changed >= 5
        if k == 4:
            assert {"sequence_id", "offset"} <= set(got.columns) and kept == {r.doc_id for r in now.collect()}
        now = got
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert language.UNKNOWN == "und" and query_tokens.END == 2
