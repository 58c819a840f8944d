"""Token ids of whole texts, exact to the tokenizers library, with every distinct word encoded once.

Both vocabularies cut a text at white space before they merge pairs, so the ids of a text are those of
its words in order. A worker keeps the ids of the words it has met (two generations of at most
`GENERATION` words), which is what makes whole corpora affordable; words outside the simple Latin case go
through the library's full path, as do texts that hold the string of a special token, which stands for that
token's id as in the library's plain call.
"""

from __future__ import annotations

import json
import operator
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words of one cache generation; two generations of about 200 bytes a word bound a worker's memory.
GENERATION = 320_000

_ID = operator.attrgetter("id")
_SPACE_BEFORE_SPACE = re.compile(r" (?:\s|$)")
_WORD_START = re.compile(r" (?=\S)")


class _Words(dict):
    """word -> little-endian uint32 ids; old words fall out a generation at a time."""

    def __init__(self, encode, most: int = GENERATION):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


#: Letters, numbers and marks of Latin-1, where lower case, NFC and the classes of both patterns are plain.
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_CONTROL = re.compile("[^\n\t -~\xa1-\xff]")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SHORT = r"'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_LEVEL = re.compile(rf"{_SHORT}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_LOWER_CASED = re.compile(rf"{_SHORT}|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")


class WordEncoder:
    """Encodes texts with a tokenizer file whose pre-tokenizer is byte-level or lower-cased words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.byte_level = spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["normalizer"] is None
        self.lowers = "Lowercase" in json.dumps(spec["normalizer"])
        if not (self.byte_level or self.lowers):
            raise ValueError(f"{path}: neither byte-level nor lower-cased words")
        self.cut = (_BYTE_LEVEL if self.byte_level else _LOWER_CASED).findall
        self.specials = [t["content"] for t in spec["added_tokens"]]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the library's own stand-ins for the bytes of Latin-1 characters
        self.stand_in = {c: level.pre_tokenize_str(chr(c))[0][0] for c in (9, 10, *range(32, 127), *range(161, 256))}
        # one cache serves all words of a lower-casing tokenizer, and so may hold more
        self.first = _Words(lambda w: self._encode("", w), GENERATION if self.byte_level else GENERATION * 3 // 2)
        self.rest = _Words(lambda w: self._encode(" ", w)) if self.byte_level else self.first
        self.marks: dict[str, bytes] = {}

    def _merged(self, pre_token: str) -> bytes:
        return self._ids(pre_token.translate(self.stand_in))

    def _ids(self, symbols: str) -> bytes:
        return array("I", map(_ID, self.merge(symbols))).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _encode(self, before: str, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # one pre-token, whose letters stand for themselves
            return self._ids((self.stand_in[32] if before else "") + (word.lower() if self.lowers else word))
        if word.isalpha():
            if not _CONTROL.search(word):
                return self._merged(before + (word.lower() if self.lowers else word))
        else:  # a word and the marks behind it are two pre-tokens
            base = word.rstrip(_MARKS)
            if base.isalpha() and len(base) < len(word) and (base.isascii() or not _CONTROL.search(base)):
                return (self.rest if before else self.first)[base.lower() if self.lowers else base] + self._mark(word[len(base) :])
        text = before + word
        if not text:
            return b""
        if _CONTROL.search(text):
            return self._whole(text)
        cut = self.cut(text.lower() if self.lowers else text)
        if len(cut) == 1:
            return self._merged(cut[0])
        out = []
        for t in cut:
            if t.isalpha():
                out.append(self.first[t])
            elif t[0] == " " and t[1:].isalpha():
                out.append(self.rest[t[1:]])
            else:
                out.append(self._mark(t))
        return b"".join(out)

    def _mark(self, t: str) -> bytes:
        """The ids of a pre-token without letters."""
        ids = self.marks.get(t)
        if ids is None:
            if len(self.marks) >= GENERATION:
                self.marks.clear()
            ids = self.marks[t] = self._merged(t)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian uint32."""
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self._whole(text)
        if self.byte_level and _SPACE_BEFORE_SPACE.search(text):
            words = _WORD_START.split(text)  # only a space before a word opens a new pre-token
        else:
            words = text.split(" ")
        if self.first is self.rest:
            return b"".join(map(self.first.__getitem__, words))
        return self.first[words[0]] + b"".join(map(self.rest.__getitem__, words[1:]))

    def encode_all(self, texts: Iterable[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by `end`, and the offsets of the texts."""
        tail = np.array([end], "<u4").tobytes()
        parts = [self.encode(t or "") + tail for t in texts]
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) // 4 for p in parts], out=at[1:])
        return np.frombuffer(b"".join(parts), "<u4"), at


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder of a tokenizer file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
