"""Terms of a text for the classifiers: words, the shapes of characters, and repetition."""

from __future__ import annotations

import zlib

import numpy as np

#: Hashed words, then triples of character classes, then repetition.
WORD_TERMS = 1 << 13
CLASSES = 16
SHAPE_TERMS = CLASSES**3
REPEAT_TERMS = 16
TERMS = WORD_TERMS + SHAPE_TERMS + REPEAT_TERMS
BLOCKS = ((0, WORD_TERMS), (WORD_TERMS, WORD_TERMS + SHAPE_TERMS), (WORD_TERMS + SHAPE_TERMS, TERMS))

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _class(b: int) -> int:
    c = chr(b)
    if b >= 128:
        return 0 if b >= 192 else 1
    if c in "aeiouy":
        return 2
    if c.islower():
        return 3
    if c.isupper():
        return 4
    if c.isdigit():
        return 5
    if c == "\n":
        return 6
    if c.isspace():
        return 7
    return 8 + {".": 0, ",": 1, "!": 2, "|": 3, "?": 2, ";": 1, ":": 1, "#": 4, "$": 4, "%": 4, "&": 4, "*": 4}.get(
        c, 5 if c in "\"'()[]{}<>" else 6
    )


_CLASS = bytes(_class(b) for b in range(256))


class Terms:
    """Term numbers and their weights (1 + log of the count) of a text."""

    def __init__(self, cached: int = 100_000):
        class Hashed(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= cached:
                    self.clear()
                self[word] = n = zlib.crc32(word) % WORD_TERMS
                return n

        self.hashed = Hashed().__getitem__

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        numbers = np.fromiter(map(self.hashed, words), np.int32, len(words))
        term, count = np.unique(numbers, return_counts=True)
        shape = np.frombuffer(text.translate(_CLASS), np.uint8).astype(np.int32)
        triples = np.bincount(shape[:-2] * CLASSES**2 + shape[1:-1] * CLASSES + shape[2:], minlength=1)
        seen = np.flatnonzero(triples)
        # Shares, not counts: how often a word follows itself, how many words are new, how
        # long they are; each as one of four steps.
        again = float((numbers[1:] == numbers[:-1]).mean()) if len(numbers) > 1 else 0.0
        steps = [
            np.searchsorted([0.02, 0.1, 0.4], again, side="right"),
            4 + np.searchsorted([0.1, 0.3, 0.6], len(term) / len(words), side="right"),
            8 + np.searchsorted([3.0, 6.0, 10.0], len(text) / len(words) - 1, side="right"),
            12 + np.searchsorted([8, 40, 200], len(words), side="right"),
        ]
        return (
            np.concatenate([term, seen + WORD_TERMS, np.array(steps) + WORD_TERMS + SHAPE_TERMS]).astype(np.int32),
            np.concatenate([1 + np.log(count), 1 + np.log(triples[seen]), np.ones(4)]).astype(np.float32),
        )
