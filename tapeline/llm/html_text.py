"""Main text of web pages by the maximum-scoring contiguous region.

A page is read as a sequence of words and tags. Tags score negative; words score positive or, within menus,
adverts and the like, slightly negative. All weights come from labelled pages (`html_labelled`): how often words and
tags stand inside and outside of main text, and a logistic model over the names, classes, ids and roles of
the elements around a word. A linear scan finds the contiguous region of the largest score; its words whose
own score is positive are the text, so an advert amid an article is left out.

Blocks end at block elements; white space inside one becomes a single space, and blocks are joined by two
newlines. The texts of form controls and embedded frames (`HIDDEN`: buttons, selections, text areas) are no page
text, wherever they stand. Null, empty and unreadable pages give an empty text; an unfinished last tag is dropped. Repeated
rows each get a result. Rows without an id are left out; columns beyond id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common
from tapeline.llm.html_labelled import PAGES

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is no page text at all: what describes the page, code, drawings, and controls of forms.
HIDDEN = frozenset("head script style noscript template svg iframe textarea button select datalist title".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
_MARK = re.compile(r"\bdata-main\b")
_CUT_TAG = re.compile(r"<(?:[a-zA-Z/!?]|\Z)")

def segments(page: str) -> Iterator[tuple[str, str, frozenset[str], bool]]:
    """Tags and runs of text in order: (text or "", tag name or "", features of the elements around, in data-main)."""
    last = page.rfind(">") + 1  # no tag ends behind it
    if "<!--" not in page[last:] and (unfinished := _CUT_TAG.search(page, last)):
        page = page[: unfinished.start()]
    stack: list[tuple[str, frozenset[str], bool, bool]] = [("", frozenset(), False, False)]
    standing: Counter[str] = Counter()  # open elements by name
    at, end = 0, len(page)
    last = end if "<!--" in page else last
    while at < end:
        found = _TOKEN.search(page, at, last)
        stop = found.start() if found else end
        if stop > at and not stack[-1][2]:
            yield page[at:stop], "", stack[-1][1], stack[-1][3]
        if not found:
            return
        at = found.end()
        if not found[2]:
            continue
        name, opens, rest = found[2].lower(), not found[1], found[3]
        if opens:
            if name == "p" or name in BLOCKS:
                while stack[-1][0] == "p":
                    standing[stack.pop()[0]] -= 1
            _, around, hidden, main = stack[-1]
            own = {name}
            for a, b, c in _NAMED.findall(rest):
                own.update("." + x for x in _PART.findall((a or b or c).lower()))
            hidden, main = hidden or name in HIDDEN, main or bool(_MARK.search(rest))
            if not own <= around:
                around = around | own
            if not hidden:
                yield "", name, around, main
            if name in RAW and not rest.endswith("/"):
                close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                at = page.find(">", close.start()) + 1 if close else end
                at = at or end
            elif name not in VOID:
                stack.append((name, around, hidden, main))
                standing[name] += 1
        else:
            if standing[name]:
                closed = ""
                while closed != name:
                    closed, around, hidden, main = stack.pop()
                    standing[closed] -= 1
                if not hidden:
                    yield "", name, around, main
            elif name == "p":
                yield "", name, stack[-1][1], stack[-1][3]


class Weights:
    """Scores of words and tags, learned from labelled pages."""

    def __init__(self, labelled: tuple[str, ...] = PAGES, steps: int = 1500, rate: float = 0.5, decay: float = 0.001):
        words, tags = [0.5, 0.5], [0.5, 0.5]  # outside, inside
        rows: list[tuple[frozenset[str], int, bool]] = []
        for page in labelled:
            for text, tag, around, main in segments(page):
                n = len(text.split())
                (tags if tag else words)[main] += 1 if tag else n
                if n:
                    rows.append((around, n, main))
        total = [words[0] + tags[0], words[1] + tags[1]]
        odds = lambda x: float(np.log(x[1] / total[1]) - np.log(x[0] / total[0]))
        self.word, self.tag = max(0.1, odds(words)), min(-0.1, odds(tags))
        names = sorted(set().union(*(r[0] for r in rows)))
        x = np.array([[f in r[0] for f in names] for r in rows], float)
        y, n = np.array([r[2] for r in rows], float), np.array([r[1] for r in rows], float)
        w, b = np.zeros(len(names)), 0.0
        for _ in range(steps):
            error = (1 / (1 + np.exp(-(x @ w + b))) - y) * n / n.mean()
            w -= rate * (x.T @ error / len(y) * 4 + decay * w)
            b -= rate * error.mean()
        self.around, self.bias = dict(zip(names, w.tolist(), strict=True)), float(b)
        self._known: dict[frozenset[str], float] = {}

    def of_word(self, around: frozenset[str]) -> float:
        """Positive for a word of main text; words around it count little against a region that spans them."""
        score = self._known.get(around)
        if score is None:
            logit = self.bias + sum(self.around.get(f, 0.0) for f in around) + self.word
            score = min(4.0, logit) if logit > 0 else max(-0.2, logit)
            if len(self._known) < 10_000:
                self._known[around] = score
        return score


@cache
def learned() -> Weights:
    return Weights()


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """The main text of a page."""
    weights = weights or learned()
    parts = list(segments(page or ""))
    scores = []
    for text, tag, around, _ in parts:
        scores.append(weights.tag if tag else len(text.split()) * weights.of_word(around))
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_at = total, (start, i + 1)
    blocks, block = [], []
    for text, tag, around, _ in parts[slice(*best_at)]:
        if tag:
            if tag in BLOCKS:
                blocks.append(block)
                block = []
            elif tag == "br":
                block.append(" ")
        elif weights.of_word(around) > 0:
            block.append(html.unescape(text))
    joined = (" ".join("".join(b).split()) for b in [*blocks, block])
    return "\n\n".join(b for b in joined if b)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.where("page_id is not null")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "html"):
            found = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
