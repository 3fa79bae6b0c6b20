"""Word shingles: sorted 64-bit hashes for search, exact numbers for comparison.

Words are runs of characters other than ASCII white space, with A-Z in lower
case; a text with fewer words than a shingle has is one shingle.  ``shingle_sets``
hashes each word whole by XXH3 and folds a shingle's words through a bijective
mixer between any two, so no sum or polynomial of words stands for a shingle.
``Reference`` compares two texts without hashes: words are numbered by a
dictionary and a shingle is the tuple of its words' numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash

#: Fixed seed of word hashes.
SEED = 20240229
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Characters whose words are held at a time.
TEXT_AT_ONCE = 1 << 19
#: Bits a shingle number may take.
NUMBER_BITS = 62


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def words_digest(words: list[bytes]) -> bytes:
    """128 bits of the words in order: equal digests stand for equal words, so for equal sets."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = {w: xxhash.xxh3_64_intdigest(w, SEED) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, some texts at a time."""
    return (found for _, found in split_sets(texts, size))


def split_sets(texts: list[str | None], size: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and shingle set of each text."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= TEXT_AT_ONCE:
            yield from _some_sets(texts[first : k + 1], size)
            first, held = k + 1, 0
    yield from _some_sets(texts[first:], size)


def _some_sets(texts: list[str | None], size: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    split = [split_words(t) for t in texts]
    hashes = word_hashes([w for words in split for w in words])
    at = 0
    for words in split:
        n = len(words)
        h = hashes[at : at + n]
        at += n
        if n == 0:
            yield words, h
            continue
        taken = min(n, size)
        acc = mix(h[: n - taken + 1] + np.uint64(taken * int(_ODD) & (1 << 64) - 1))
        for i in range(1, taken):
            acc = mix(acc * _ODD + h[i : n - taken + 1 + i])
        yield words, np.unique(acc)


class Reference:
    """A text that others are compared with exactly, shingle by shingle."""

    def __init__(self, words: list[bytes], size: int):
        self.words, self.size = words, size
        self.numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
        self.ids = self._ids(words, self.numbers)
        self.width = NUMBER_BITS // size
        self.codes: np.ndarray | None = None

    @staticmethod
    def _ids(words: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
        return np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))

    def _packed(self, ids: np.ndarray) -> np.ndarray:
        code = ids[: len(ids) - self.size + 1]
        for i in range(1, self.size):
            code = code << self.width | ids[i : len(ids) - self.size + 1 + i]
        return np.unique(code)

    def compare(self, words: list[bytes]) -> tuple[int, int, int]:
        """Distinct shingles of this text, of the other, and of both."""
        if min(len(words), len(self.words)) < self.size:
            mine, other = ({tuple(w[k : k + self.size]) for k in range(max(1, len(w) - self.size + 1))} if w else set() for w in (self.words, words))
            return len(mine), len(other), len(mine & other)
        numbers = self.numbers
        if new := set(words).difference(numbers):
            numbers = numbers | dict(zip(new, range(len(numbers), len(numbers) + len(new))))
        ids = self._ids(words, numbers)
        if len(numbers) <= 1 << self.width:
            if self.codes is None:
                self.codes = self._packed(self.ids)
            mine, other = self.codes, self._packed(ids)
        else:
            mine, other = self._ranked(ids, len(numbers))
        return len(mine), len(other), len(np.intersect1d(mine, other, assume_unique=True))

    def _ranked(self, ids: np.ndarray, base: int) -> list[np.ndarray]:
        """As many words as do not fit side by side: prefixes are numbered anew before each further word."""
        both = [self.ids, ids]
        codes = [x[: len(x) - self.size + 1] for x in both]
        for i in range(1, self.size):
            ranks = np.unique(np.concatenate(codes), return_inverse=True)[1]
            codes = [r * base + x[i : len(x) - self.size + 1 + i] for r, x in zip(np.split(ranks, [len(codes[0])]), both)]
        return [np.unique(c) for c in codes]
