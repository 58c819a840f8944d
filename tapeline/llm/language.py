"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text is read as its bytes, with ASCII letters lower-cased and every run of other ASCII bytes as one space.
Two gated recurrent layers read it from both ends, and a softmax over both states labels every position with
language probabilities. Texts are read in windows of `WINDOW` bytes; the layers first read the `CONTEXT` bytes
before and behind a window, so their states come from beyond it. A document's probabilities are the geometric
mean over its positions, normalised.

Training is by backpropagation through time and Adam on random windows of 8 to `TRAIN_WINDOW` bytes of at
most `SAMPLE` texts of each language and `SAMPLE_CHARS` characters of each; the same texts give the same
model, however often and in whatever order they occur. Null texts and texts without a letter are `und` with score 0, and so is everything if there is nothing
to learn from. Repeated rows and rows without an id each get a result; only text and, for training, lang and
the held-out rule's column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeline.llm import common

UNKNOWN = "und"
#: Bounds of the training sample: documents of each language, characters of each document, languages.
SAMPLE = 200
SAMPLE_CHARS = 20_000
MOST_LANGUAGES = 256
HIDDEN = 8
WINDOW, CONTEXT, TRAIN_WINDOW = 256, 32, 96
STEPS = 400
BATCH = 192
#: Bytes of text labelled at a time, and windows in one pass.
BATCH_BYTES, ROWS = 1 << 20, 1024

_SPACE = 32
_CODE = np.full(256, _SPACE, np.uint8)
_CODE[97:123] = _CODE[65:91] = np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)


def codes_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of documents, their offsets, and for each byte the place of its code."""
    codes = _CODE[data]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    inner = at[1:-1]
    keep[inner[inner < len(codes)]] = True
    upto = np.append(0, np.cumsum(keep))
    return codes[keep], upto[at], upto[1:] - 1


def windows(at: np.ndarray, window: int = WINDOW, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all documents: document, first code and codes of the window, first code and codes with what is around it."""
    size = np.diff(at)
    n = -(-size // window)
    doc = np.repeat(np.arange(len(size)), n)
    first = at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
    count = np.minimum(window, at[doc + 1] - first)
    begin, end = np.maximum(at[doc], first - context), np.minimum(at[doc + 1], first + count + context)
    return doc, first, count, begin, end - begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Layer:
    """One gated recurrent layer over bytes: gates z and r and the candidate stand side by side in the weights."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.x = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.h = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, np.float32)

    def forward(self, codes: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, row, hidden) for codes and mask (time, row); a masked step carries the state on."""
        n = self.h.shape[0]
        state = np.zeros((codes.shape[1], n), np.float32)
        out = np.empty((*codes.shape, n), np.float32)
        for t in range(len(codes)):
            given = self.x[codes[t]] + self.b
            gates = _sigmoid(given[:, : 2 * n] + state @ self.h[:, : 2 * n])
            z, r = gates[:, :n] * mask[t][:, None], gates[:, n:]
            new = np.tanh(given[:, 2 * n :] + (r * state) @ self.h[:, 2 * n :])
            if keep is not None:
                keep.append((state, gates[:, :n], z, r, new))
            state = state + z * (new - state)
            out[t] = state
        return out

    def read(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """What forward() gives, in place and without anything kept."""
        n = self.h.shape[0]
        given, gates_h, new_h = self.x + self.b, np.ascontiguousarray(self.h[:, : 2 * n]), np.ascontiguousarray(self.h[:, 2 * n :])
        state = np.zeros((codes.shape[1], n), np.float32)
        out = np.empty((*codes.shape, n), np.float32)
        gates, new = np.empty((codes.shape[1], 2 * n), np.float32), np.empty_like(state)
        whole = mask.all(axis=1)
        for t in range(len(codes)):
            x = given[codes[t]]
            np.matmul(state, gates_h, out=gates)
            gates += x[:, : 2 * n]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.matmul(gates[:, n:] * state, new_h, out=new)
            new += x[:, 2 * n :]
            np.tanh(new, out=new)
            new -= state
            new *= gates[:, :n]
            if not whole[t]:
                new *= mask[t][:, None]
            state += new
            out[t] = state
        return out

    def backward(self, codes: np.ndarray, mask: np.ndarray, kept: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of x, h and b, given those of the states."""
        n = self.h.shape[0]
        dx, dh, db = np.zeros_like(self.x), np.zeros_like(self.h), np.zeros_like(self.b)
        carry = np.zeros(grad.shape[1:], np.float32)
        for t in range(len(codes) - 1, -1, -1):
            state, raw, z, r, new = kept[t]
            d = carry + grad[t]
            d_new = d * z * (1 - new * new)
            d_z = d * (new - state) * mask[t][:, None] * raw * (1 - raw)
            back = d_new @ self.h[:, 2 * n :].T
            d_r = back * state * r * (1 - r)
            dh[:, 2 * n :] += (r * state).T @ d_new
            both = np.concatenate([d_z, d_r], axis=1)
            dh[:, : 2 * n] += state.T @ both
            all_three = np.concatenate([both, d_new], axis=1)
            db += all_three.sum(axis=0)
            np.add.at(dx, codes[t], all_three)
            carry = d * (1 - z) + back * r + both @ self.h[:, : 2 * n].T
        return [dx, dh, db]


@dataclass
class Model:
    languages: list[str]
    ahead: Layer
    back: Layer
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.x, self.ahead.h, self.ahead.b, self.back.x, self.back.h, self.back.b, self.out, self.bias]

    def _log_probabilities(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        scores = np.concatenate([f, b], axis=2) @ self.out + self.bias
        scores -= scores.max(axis=2, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=2, keepdims=True))

    def label(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-probabilities (time, row, language) of every position; mask is 0 behind a row's end."""
        return self._log_probabilities(self.ahead.read(codes, mask), self.back.read(codes[::-1], mask[::-1])[::-1])

    def learn(self, codes: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients: every position is to have the language of its row."""
        kept_f: list = []
        kept_b: list = []
        f = self.ahead.forward(codes, mask, kept_f)
        b = self.back.forward(codes[::-1], mask[::-1], kept_b)[::-1]
        logp = self._log_probabilities(f, b)
        weight = (mask / mask.sum()).astype(np.float32)[:, :, None]
        loss = -float((logp * target * weight).sum())
        d = (np.exp(logp) - target) * weight
        states = np.concatenate([f, b], axis=2)
        d_out = np.tensordot(states, d, ((0, 1), (0, 1)))
        d_states = d @ self.out.T
        n = f.shape[2]
        return loss, [
            *self.ahead.backward(codes, mask, kept_f, d_states[:, :, :n]),
            *self.back.backward(codes[::-1], mask[::-1], kept_b, d_states[::-1, :, n:]),
            d_out,
            d.sum(axis=(0, 1)),
        ]


def _grid(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and mask (time, row) of windows."""
    step = np.arange(int(size.max()))[:, None]
    mask = (step < size).astype(np.float32)
    return data[np.minimum(start + step, len(data) - 1)], mask


def train(texts: list[tuple[str, str]], *, hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 7) -> Model | None:
    """A model from (text, language) pairs; None if they hold no letters. Languages count alike, and texts of one by their size."""
    read = [(codes_of(raw := np.frombuffer(text.encode(), np.uint8), np.array([0, len(raw)]))[0], language) for text, language in texts]
    read = [(codes, language) for codes, language in read if (codes != _SPACE).any()]
    if not read:
        return None
    languages = sorted({language for _, language in read})
    of_text = np.array([languages.index(language) for _, language in read])
    size = np.array([len(codes) for codes, _ in read])
    begin = np.cumsum(size) - size
    data = np.concatenate([codes for codes, _ in read])
    share = size / np.bincount(of_text, size)[of_text]
    rng = np.random.default_rng(seed)
    model = Model(languages, Layer(rng, hidden), Layer(rng, hidden), (rng.standard_normal((2 * hidden, len(languages))) * 0.1).astype(np.float32), np.zeros(len(languages), np.float32))
    first = [np.zeros_like(p) for p in model.parameters()]
    second = [np.zeros_like(p) for p in model.parameters()]
    for step in range(1, steps + 1):
        pick = rng.choice(len(read), batch, p=share / share.sum())
        count = np.minimum(size[pick], rng.integers(8, TRAIN_WINDOW + 1, batch))
        start = begin[pick] + (rng.random(batch) * (size[pick] - count + 1)).astype(np.int64)
        codes, mask = _grid(data, start, count)
        _, grads = model.learn(codes, mask, np.eye(len(languages), dtype=np.float32)[of_text[pick]])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(model.parameters(), grads, first, second, strict=True):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def _labelled(model: Model, codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Passes over windows of like size: their documents, first codes and codes, the log-probabilities of all positions read, and which of these are of the window."""
    doc, first, count, begin, size = windows(at)
    order = np.argsort(size, kind="stable")
    for some in np.array_split(order, max(1, -(-len(order) // ROWS))):
        if len(some):
            grid, mask = _grid(codes, begin[some], size[some])
            step = np.arange(len(grid))[:, None] + begin[some]
            yield doc[some], first[some], count[some], model.label(grid, mask), (step >= first[some]) & (step < first[some] + count[some])


def positions(model: Model, text: str) -> list[str]:
    """The language of every byte of a text."""
    data = np.frombuffer(text.encode(), np.uint8)
    codes, at, place = codes_of(data, np.array([0, len(data)]))
    best = np.zeros(len(codes), np.int64)
    for _, first, count, logp, own in _labelled(model, codes, at):
        best[common.lane_concat(first, count)] = logp.argmax(axis=2).T[own.T]
    return [model.languages[b] for b in best[place].tolist()]


def pool(model: Model | None, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of every document."""
    docs = len(at) - 1
    languages, scores = [UNKNOWN] * docs, np.zeros(docs)
    codes, starts, _ = codes_of(data, at)
    if model is None or not len(codes):
        return languages, scores
    sums = np.zeros((docs, len(model.languages)))
    for doc, _, _, logp, own in _labelled(model, codes, starts):
        np.add.at(sums, doc, np.einsum("trk,tr->rk", logp, own.astype(np.float32)))
    pooled = sums / np.maximum(np.diff(starts), 1)[:, None]
    pooled = np.exp(pooled - pooled.max(axis=1, keepdims=True))
    pooled /= pooled.sum(axis=1, keepdims=True)
    plain = np.append(0, np.cumsum((codes > 96) & (codes < 123)))
    plain = plain[starts[1:]] - plain[starts[:-1]]
    for d in np.flatnonzero(np.diff(at) > 0).tolist():
        # bytes beyond ASCII may be no letters
        if plain[d] or any(c.isalpha() for c in data[at[d] : at[d + 1]].tobytes().decode("utf-8", "ignore")):
            best = int(pooled[d].argmax())
            languages[d], scores[d] = model.languages[best], pooled[d, best]
    return languages, scores


def sample(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """The training sample: the SAMPLE texts of each language with the smallest hashes, all if there are fewer.

    A text counts once, however often it occurs, so the same texts give the same sample in any order and number.
    Hashes far above the SAMPLE-th are cut beforehand by an estimate of how many texts there are; where the estimate
    cut too much, the language is taken again with a higher bound.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.substring(text_col, 1, SAMPLE_CHARS).alias("text"))
    texts = dict(rows.groupBy("lang").agg(F.approx_count_distinct("h")).limit(MOST_LANGUAGES + 1).collect())
    if len(texts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    parts = {language: 4 * SAMPLE / max(1, n) for language, n in texts.items()}
    smallest = Window.partitionBy("lang").orderBy("h")
    out = []
    while parts:
        bound = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min((1 << 63) - 1, int(part * (1 << 64)) - (1 << 63)))) for x, part in sorted(parts.items())])
        few = rows.where(F.col("h") <= bound).groupBy("lang", "h").agg(F.min("text").alias("text"))
        got: dict[str, list] = {x: [] for x in parts}
        for language, h, text in few.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= SAMPLE).select("lang", "h", "text").collect():
            got[language].append((h, text))
        done = [x for x in parts if len(got[x]) == SAMPLE or parts[x] >= 1]
        out += [(x, h, text) for x in done for h, text in got[x]]
        parts = {x: 16 * part for x, part in parts.items() if x not in done}
    return [(text, language) for language, _, text in sorted(out)]


def identify(documents: DataFrame, model: Model | None, *, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """The documents with the predicted language and its score; existing columns of these names are replaced."""
    kept = documents.drop(lang_as, score_as)
    at_text = kept.columns.index(text_col)
    text_field = kept.schema[text_col].dataType.simpleString()
    if text_field != "string":
        raise TypeError(f"{text_col} is {text_field}, not string")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text_col, BATCH_BYTES):
            languages, scores = pool(model, *common.utf8(batch.column(at_text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages), pa.array(scores)], [*batch.schema.names, lang_as, score_as])

    return kept.mapInArrow(common.tidy(predict), StructType(list(kept.schema.fields)).add(lang_as, "string").add(score_as, "double"))
