"""Subword ids of texts by a public tokenizer, with bounded caches of words.

The vocabulary file is a parameter.  Its tokenizer drops white space and never joins
across it, so a text's ids are those of its words in order, and a word's ids are
looked up once.  A word of letters that ends in punctuation is put together from its two
runs, which are remembered as well.  Tests hold the result against the tokenizer's own
on whole texts.
"""

from __future__ import annotations

import os
import re
from array import array

#: Words and runs of letters in each of the two generations of a Python worker's cache.
CACHED_WORDS = 180_000

# Letters beyond ASCII that lower-casing and canonical composition keep single.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCache(dict):
    """Maps a word (UTF-8, a run without ASCII white space) to its ids, packed as little-endian unsigned 32 bits.

    It remembers the last ``limit`` new words, and as many before that were not asked
    for since.  A word's run of letters is remembered as the word that it is by itself.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.limit = limit
        self.before: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.shown = _visible_bytes()

    def clear(self) -> None:
        super().clear()
        self.before.clear()

    def __missing__(self, word: bytes) -> bytes:
        value = self.before.pop(word, None)
        if value is None:
            value = self.encode(word)
        if len(self) >= self.limit:
            self.before = dict(self)
            super().clear()
        self[word] = value
        return value

    def _run(self, run: str) -> bytes:
        """The ids of a lower-cased run that is a piece of its own: the model alone is enough."""
        return _packed([t.id for t in self.tokenize(run)])

    def encode(self, word: bytes) -> bytes:
        letters = word.rstrip(_MARKS)
        if letters.isalpha():  # of ASCII
            run = letters.lower()
            if run == word:
                return self._run(word.decode())
        elif letters.isascii() or not _LETTERS.fullmatch(text := letters.decode("utf-8", "surrogatepass")):
            return _packed(self.tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids)
        else:
            run = text.lower().encode()
            if run == word:
                return self._run("".join(map(self.shown.__getitem__, run)))
        marks = word[len(letters) :]
        return self[run] + self[marks] if marks else self[run]

    def packed(self, text: str | None) -> bytes:
        """The ids of a whole text, four bytes each."""
        if not text:
            return b""
        raw = text.encode("utf-8", "surrogatepass")
        # The tokenizer composes before it lower-cases: only marks of U+0300 to U+037F join ASCII letters.
        if b"\xcc" not in raw and b"\xcd" not in raw:
            raw = raw.lower()
        return b"".join(map(self.__getitem__, raw.split()))


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    assert out.itemsize == 4
    return out.tobytes()


_CACHES: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """This process's cache for a vocabulary file."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]
