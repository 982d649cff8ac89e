"""Word by word use of the tokenizers library.

A text of plain characters is cut by the vocabulary's own word pattern, and each distinct word goes
straight to the library's merge model, once per worker while it is met again. Any other text is cut
at single spaces, where neither vocabulary's pieces ever join two sides: its plain stretches are cut
into words likewise, every other stretch goes through the library's whole encoder. The ids are those
of encoding the text at once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

PLAIN = r"!-~\nÀ-ÖØ-öø-ÿ"  # printable ASCII, line feeds and Latin-1 letters
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
TWO_SPACES = re.compile(r"\s\s")
MOST = 300_000  # entries of each of a table's two generations, unless fewer are asked for
WORDS, STRETCHES = 150_000, 50_000  # the same of the two tables here: every worker that stays holds them on


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Known(dict):
    """A table that fills itself and stays bounded: what was not asked for lately is forgotten."""

    def __init__(self, make, most: int | None = None):
        super().__init__()
        self.make, self.older, self.most = make, {}, most or MOST

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit integers, without added tokens."""

    def __init__(self, name: str):
        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        self.model, self.lower = self.whole.model, self.whole.normalizer is not None
        self.plain = re.compile(f"[ {PLAIN}]*").fullmatch
        marks = "'s|'t|'re|'ve|'m|'ll|'d"
        if self.lower:  # digits one by one, white space dropped
            self.cut = re.compile(f"{marks}|[{LETTER}]+|[0-9]|[^\\s{LETTER}0-9]+").findall
        else:
            self.cut = re.compile(f"{marks}| ?[{LETTER}]+| ?[0-9]+| ?[^\\s{LETTER}0-9]+|\\s+(?!\\S)|\\s+").findall
        self.shown = dict(enumerate(byte_letters()))
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.words, self.stretches = Known(self.word, WORDS), Known(self.stretch, STRETCHES)

    def word(self, word: str) -> bytes:
        shown = word.encode().decode("latin-1").translate(self.shown)
        return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(shown)])

    def by_library(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)

    def plainly(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.cut(text.lower() if self.lower else text)))

    def stretch(self, text: str) -> bytes:
        return self.plainly(text) if self.plain(text) and "<|" not in text else self.by_library(text)

    def encode(self, text: str) -> bytes:
        if not self.lower and TWO_SPACES.search(text):  # runs of white space join across stretches
            return self.by_library(text)
        if self.plain(text) and "<|" not in text:
            return self.plainly(text)
        parts = text.split(" ")
        if self.lower:
            return b"".join(map(self.stretches.__getitem__, parts))
        head = self.stretches[parts[0]] if parts[0] else b""
        return head + b"".join([self.stretches[" " + p] for p in parts[1:]])


@lru_cache(2)
def tokenizer(name: str) -> WordTokenizer:
    """One per worker process and vocabulary."""
    return WordTokenizer(name)
