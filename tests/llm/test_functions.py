"""Brute-force comparisons of the operators' cores, without Spark."""

import collections
import html
import io
import math
import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeline.llm import common, fingerprint, html_text, language, ngram_join, packing, simple8b, suffix_dedup, token_output, url_filter, warc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=700), st.integers(0, 2600))
def test_simple8b_round_trip(values, zeros):
    ids = np.array(values + [0] * zeros + values, np.uint64)
    words, starts = simple8b.encode(ids)
    assert (simple8b.decode(words, starts, len(ids)) == ids).all()


def test_simple8b_blocks_decode_alone():
    ids = np.random.default_rng(1).integers(0, 50_000, 5000).astype(np.uint64)
    words, starts = simple8b.encode(ids)
    a, b = int(starts[2]), int(starts[3])
    block = simple8b.decode(words[a:b], np.array([0, b - a], np.uint64), simple8b.BLOCK)
    assert (block == ids[2 * simple8b.BLOCK : 3 * simple8b.BLOCK]).all()


def test_token_file_detects_damage():
    data = token_output.pack(np.array([1, 5]), np.array([2, 3]), np.array([7, 2, 2], np.uint64))
    doc_ids, ends, ids = token_output.unpack(data)
    assert (doc_ids.tolist(), ends.tolist(), ids.tolist()) == ([1, 5], [2, 3], [7, 2, 2])
    with pytest.raises(ValueError):
        token_output.unpack(data[:-1] + bytes([data[-1] ^ 1]))


ODD = ["", " ", "  a  b", "a\n b", " \n x", "İstanbul ΣΑΣ ς. foo,, bar.,", "don't  we'll 'S", "x\x1cy \x1c z", "é é a ́b", "<|endoftext|> a", "a <|startoftext|> b", "x<|endoftext|>y  <|endoftext|>", "<|ENDOFTEXT|> İ", "1,234.5 a_b -- ...", "a\u00a0b \u2003 c", "ª º µ ß.", "Ça, été", "a  ", "tab\tx \t y", "日本 語。", "\n\n a\r\n b"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_encoder_equals_the_library(name):
    tokenizers = pytest.importorskip("tokenizers")
    paths = pytest.importorskip("public_tokenizers")
    from tapeline.llm import tokens

    words = tokens.WordEncoder(paths.path(name))
    library = tokenizers.Tokenizer.from_file(paths.path(name))
    rng = np.random.default_rng(2)
    alphabet = list("ab é\n\t.,'1²Σİ") + ["  ", " don't", "\u00a0", "ſ", "x̂", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(1, 60, 300)]
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_sum_of_squares_places_every_piece_once():
    counts = {3: 20, 5: 7, 9: 4, 10: 2}
    length, sequence, offset = packing.sum_of_squares(counts, 10)
    assert collections.Counter(length.tolist()) == counts
    cells = set()
    for n, s, o in zip(length.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        new = {(s, p) for p in range(o, o + n)}
        assert o + n <= 10 and not new & cells
        cells |= new
    for s in set(sequence.tolist()):
        held = sorted(p for q, p in cells if q == s)
        assert held == list(range(len(held)))


@pytest.mark.parametrize(("base", "carried"), [(2, 3), (4, 0), (16, 1024)])
def test_plan_by_digits_places_every_rank_once(monkeypatch, base, carried):
    monkeypatch.setattr(packing, "BASE", base)
    monkeypatch.setattr(packing, "CARRIED", carried)
    counts, size = {3: 250, 5: 81, 9: 1, 4: 16}, 10
    slots, ranks = packing.plan(counts, size)
    places = {(level, length, slot): (sequence, offset) for level, length, slot, sequence, offset in slots.tolist()}
    cells = set()
    for length, count in counts.items():
        for rank in range(count):
            first, level, copies = [step for step in ranks[length] if step[0] <= rank][-1]
            sequence, offset = places[level, length, (rank - first) // copies]
            new = {(sequence + (rank - first) % copies, p) for p in range(offset, offset + length)}
            assert offset + length <= size and not new & cells
            cells |= new
    assert len(cells) == sum(length * count for length, count in counts.items())
    sequences = collections.Counter(s for s, _ in cells)
    assert set(sequences) == set(range(len(sequences))) and all((s, n - 1) in cells for s, n in sequences.items())


def test_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(np.minimum(np.exp(rng.normal(4, 1, 20_000)), 200).astype(int) + 1, return_counts=True)
    sizes = []
    for factor in (1, 1000, 10**6):
        some = dict(zip(lengths.tolist(), (counts * factor + 3).tolist(), strict=True))
        slots, ranks = packing.plan(some, 256)
        sizes.append(len(slots))
        used = max(s + packing.BASE**level for level, _, _, s, _ in slots.tolist())
        assert used <= 1.01 * sum(n * c for n, c in some.items()) / 256 + 2
    assert sizes[2] < 3 * sizes[1] < 300_000


def brute_repeats(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    return [[p for p in range(len(t) - length + 1) if seen[t[p : p + length]] > 1] for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_marks_repeats(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 99 + seed, 300).astype(np.uint8).tobytes()
    texts = [base[a : a + n] for a, n in zip(rng.integers(0, 200, 12).tolist(), rng.integers(5, 90, 12).tolist(), strict=True)] + [b"a" * 60]
    for runs, length in zip(suffix_dedup.repeated_runs(texts, [1] * len(texts), (20, 30)), (20, 30), strict=True):
        got = [[] for _ in texts]
        for which, first, count in zip(*(x.tolist() for x in runs), strict=True):
            got[which] += range(first, first + count)
        assert got == brute_repeats(texts, length)
    data, sizes = np.frombuffer(base[:-3] + b"\0a\0", np.uint8), np.array([100, 1, 60, 139])
    ends = np.repeat(np.cumsum(sizes), sizes)
    suffix = [data[i : ends[i]].tobytes() for i in range(len(data))]
    truth = sorted(range(len(data)), key=lambda i: ([*(b + 1 for b in suffix[i]), 0], ends[i]))
    wanted = np.flatnonzero(rng.random(300) < 0.6)
    for order in (suffix_dedup.suffix_array(data, sizes), some := suffix_dedup.suffix_array(data, sizes, wanted)):
        shared = suffix_dedup.common_prefixes(data, sizes, order, 1 << 30)
        for k, (a, b) in enumerate(zip(order, order[1:], strict=False), 1):
            assert shared[k] == len(os.path.commonprefix([suffix[a], suffix[b]]))
    assert suffix_dedup.suffix_array(data, sizes).tolist() == truth and some.tolist() == [i for i in truth if i in set(wanted.tolist())]


def test_equal_strings_have_equal_minimisers():
    rng = np.random.default_rng(4)
    shared = rng.integers(97, 123, 80).astype(np.uint8)
    keys = []
    for _ in range(2):
        data = np.concatenate([rng.integers(97, 123, 50).astype(np.uint8), shared, rng.integers(97, 123, 70).astype(np.uint8)])
        first, count, place, key = suffix_dedup.runs(data, np.array([0, len(data)]), 40, 10)
        assert count.sum() == len(data) - 39 and (place >= first + count - 1).all() and (place <= first + 30).all()
        whole = np.repeat(key, count)
        keys.append(whole[50 : 50 + 41].tolist())
    assert keys[0] == keys[1]


WORDS = ["a", "b", "C", "c", "é", "É", "x1", "\u00a0"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=14), max_size=8), st.sampled_from([" ", "\n", "  ", "\t\x0b"]))
def test_shingle_sets_equal_plain_sets(docs, gap):
    texts = [gap.join(d) for d in docs]
    hashes, at = ngram_join.shingle_sets(*common.utf8(pa.array(texts, pa.string())))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = []
    for text in texts:
        words = [w for w in text.translate(lower).translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
        plain.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    assert np.diff(at).tolist() == [len(s) for s in plain]
    for i in range(len(texts)):
        for j in range(i):
            a, b = hashes[at[i] : at[i + 1]], hashes[at[j] : at[j + 1]]
            assert len(np.intersect1d(a, b)) == len(plain[i] & plain[j])


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 1 << 50, n).astype(np.uint64) for n in (10, 200, 200)]
    sets[2][:150] = sets[1][:150]
    raw = ngram_join.sketches(np.concatenate(sets), np.repeat([0, 1, 2], [10, 200, 200]), 3)
    bits = [np.unpackbits(np.frombuffer(r, np.uint8)) for r in raw]
    for i in range(3):
        for j in range(3):
            assert (bits[i] ^ bits[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))
            assert ngram_join.suffix_bound(np.sort(sets[i]), np.sort(sets[j])) >= len(np.intersect1d(sets[i], sets[j]))


@pytest.mark.parametrize(("listed", "others"), [(0, 50), (1, 2000), (5, 20_000), (300, 3000), (500, 20)])
def test_cascade_is_exact(listed, others):
    keys = url_filter.hashed([f"k{i}" for i in range(listed + others)])
    first = url_filter.Bloom.of(keys[:listed], 0.3, 0)
    wrong = keys[listed:][first.accepts(keys[listed:])]
    cascade = url_filter.Cascade.of(first, keys[:listed], wrong)
    assert cascade.lists(keys).tolist() == [True] * listed + [False] * others


@pytest.mark.parametrize(
    ("url", "parts"),
    [(None, ("", "")), ("no mark", ("", "")), ("http://A.Com", ("a.com", "")), ("x://É.com/P?q#f", ("É.com", "/P")), ("://h#/x", ("h", "")), ("a://b?c/d", ("b", "")), ("a://b/c://d", ("b", "/c://d"))],
)
def test_url_parts(url, parts):
    assert url_filter.split(url) == parts


def test_warc_records_round_trip():
    payload = "<p>é</p>".encode() * 200
    data = b"".join(warc._member(warc.record(i, u, payload, r)) for i, u, r in ((-3, None, 9), (9, "http://x/\r\n y", None)))
    (a, block_a), (b, block_b) = warc.records(io.BytesIO(data))
    assert (a["WARC-Type"], b["WARC-Type"]) == ("revisit", "response")
    assert warc._page_id(a["WARC-Record-ID"]) == -3 and warc._page_id(a["WARC-Refers-To"]) == 9
    assert block_b.endswith(payload) and payload not in block_a and b["WARC-Target-URI"] == "http://x/%0D%0A%20y"
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-9])))


PAGES = [
    ("<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body><nav><a>one</a></nav><article><h1>A  b</h1><p>c &amp; d<br>e<p>f</article><footer>&copy; me and all of us</footer>", "A b\n\nc & d e\n\nf"),
    ("<body><article><p>main words here now</p><div class='ad'>buy our things today</div><p>more main words</p><div class=comments><p>I like it a lot</p></div></article><form>name</form>", "main words here now\n\nmore main words"),
    ("<article><p>cut off tag at the end<p", "cut off tag at the end"),
    ("", ""),
    (None, ""),
    ("<nav><a>x</a></nav>", ""),
    ("<article></article><footer>some words of the footer</footer>", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def _words_inside(page):
    return collections.Counter(w for text, _, _, main in html_text.segments(page) if main for w in html.unescape(text).split())


def test_labelled_pages_are_read_back():
    for page in html_text.PAGES:
        assert collections.Counter(html_text.main_text(page.replace(" data-main", "")).split()) == _words_inside(page)


def test_pages_held_out():
    right = extra = missing = 0
    for k, page in enumerate(html_text.PAGES):
        weights = html_text.Weights(html_text.PAGES[:k] + html_text.PAGES[k + 1 :])
        got, want = collections.Counter(html_text.main_text(page.replace(" data-main", ""), weights).split()), _words_inside(page)
        right, extra, missing = right + (got & want).total(), extra + (got - want).total(), missing + (want - got).total()
    assert right / (right + extra) > 0.92 and right / (right + missing) > 0.92


def test_long_and_deep_pages():
    deep = html_text.main_text("<article>" + "<div>" * 20_000 + "the words within go on</span></span> here" + "</div>" * 20_000 + "</article>")
    assert deep == "the words within go on here"
    assert html_text.main_text("<article><p>words before the tags " + '<a title="x ' * 20_000) == "words before the tags"
    paragraphs = [f"paragraph {i} has its own few words" for i in range(20_000)]
    assert html_text.main_text("<nav><a>x</a></nav><article>" + "".join(f"<p>{p}" for p in paragraphs) + "</article>") == "\n\n".join(paragraphs)


def test_language_gradients():
    model = language.train([("ab cd", "x"), ("ef gh", "y")], hidden=3, steps=1)
    codes, mask = np.array([[97, 101], [98, 102], [99, 0]]), np.array([[1, 1], [1, 1], [1, 0]], np.float32)
    target = np.array([[1, 0], [0.3, 0.7]], np.float32)
    _, grads = model.learn(codes, mask, target)
    rng = np.random.default_rng(0)
    for p, g in zip(model.parameters(), grads, strict=True):
        for _ in range(5):
            i = tuple(int(rng.choice([97, 98, 101, 102])) if n == 256 else int(rng.integers(n)) for n in p.shape)
            old = p[i]
            p[i] = old + 1e-2
            up = model.learn(codes, mask, target)[0]
            p[i] = old - 1e-2
            down = model.learn(codes, mask, target)[0]
            p[i] = old
            assert math.isclose((up - down) / 2e-2, g[i], abs_tol=3e-4)


def test_language_of_odd_texts():
    model = language.train([("the cat and the dog " * 30, "en"), ("der hund und die katze " * 30, "de")], steps=60)
    texts = ["the dog and the cat", "die katze und der hund", "", "123 !?", "…—", "日本", None]
    names, scores = language.pool(model, *common.utf8(pa.array(texts, pa.string())))
    assert names[:2] == ["en", "de"] and names[2:5] == ["und"] * 3 and names[6] == "und" and names[5] != "und"
    assert all(0 <= s <= 1 for s in scores) and len(language.positions(model, "the hund é")) == 11
    assert language.pool(None, *common.utf8(pa.array(["abc"])))[0] == ["und"]


def test_precedence_equals_plain_entropy():
    data = np.random.default_rng(0).integers(97, 110, 500).astype(np.uint8)
    plain = []
    for i in range(len(data) - 63):
        c = np.bincount(data[i : i + 64])
        c = c[c > 0] / 64
        plain.append(-(c * np.log2(c)).sum() / 6)
    assert (fingerprint.precedences(data) == fingerprint._PRECEDENCE[(np.array(plain) * 1000 + 1e-6).astype(int)]).all()


def test_likeness():
    rng = np.random.default_rng(0)
    def text(n):
        return "".join(rng.choice(list("etaoin shrdlu"), n)).encode()
    def prints(x):
        d = np.frombuffer(x, np.uint8)
        return fingerprint.digest(d, fingerprint.precedences(d))
    a, b = text(4000), text(4000)
    assert fingerprint.likeness(prints(a), prints(a)) == 1.0
    assert fingerprint.likeness(prints(a), prints(a[:3000] + b[:1000])) > 0.5 > 0.2 > fingerprint.likeness(prints(a), prints(b))
    assert fingerprint.likeness(prints(b""), prints(b"")) == 1.0 and fingerprint.likeness(prints(b""), prints(a)) == 0.0
    assert fingerprint.likeness(prints(b"a short one"), prints(b"a short one!")) > 0.5
