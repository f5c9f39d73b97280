"""Texts as code-point arrays: letters, words and n-gram buckets, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters handled at once; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 20


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and its simple lower case.  Built once per task, in some 30 ms."""
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for lo, hi in ((0, 0xD800), (0xF900, 0x32000)):
        letter[lo:hi] = [chr(i).isalpha() for i in range(lo, hi)]
        low = [chr(i).lower() for i in range(lo, hi)]
        lower[lo:hi] = [ord(c) if len(c) == 1 else i for i, c in enumerate(low, lo)]
    return letter, lower


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[list[int]]:
    """Indices of the texts in pieces of about ``most`` characters, texts of like length together."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
    piece, held = [], 0
    for i in order:
        n = len(texts[i] or "")
        if piece and held + n > most:
            yield piece
            piece, held = [], 0
        piece.append(i)
        held += n
    if piece:
        yield piece


class Words:
    """The letter runs of some texts.

    ``raw``: the code points, a line feed after each text; ``x``: lower-cased code points, zero where there is no letter, one zero after each text.
    ``start``, ``end``: positions of each word in ``x``; ``text``: which text it is of;
    ``offset``: where each text begins; ``first``: the first word of each text, with one more entry than texts.
    """

    def __init__(self, texts: list[str | None], known: tuple[np.ndarray, np.ndarray]):
        letter, lower = known
        raw = np.frombuffer("\n".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.raw = raw = np.minimum(raw, 0x10FFFF)
        is_letter = letter[raw]
        self.x = np.where(is_letter, lower[raw], 0).astype(np.uint32)
        edge = np.diff(np.concatenate([[0], is_letter.view(np.int8), [0]]))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.array([len(t or "") + 1 for t in texts], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.start, self.offset)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def grams(self, bits: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Positions that end an n-gram, each word's first index among them, and bucket numbers per size.

        A gram reaches back to the start of its word and no further; the place after a
        word's last letter ends a gram too.  Sizes take ``1 << bits`` buckets each, one
        after the other.
        """
        x = self.x
        used = x != 0
        ends = used.copy()
        ends[1:] |= used[:-1]
        at = np.flatnonzero(ends)
        where = np.searchsorted(at, self.start)
        back = [x[at]]
        for k in range(1, max(sizes)):
            prev = np.where(at >= k, x[np.maximum(at - k, 0)], 0).astype(np.uint32)
            if k > 1:
                prev = np.where(back[-1] == 0, 0, prev).astype(np.uint32)
            back.append(prev)
        factors = [np.uint32(f) for f in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]
        found = []
        for j, n in enumerate(sizes):
            h = np.full(len(at), np.uint32(n * 0x01000193), np.uint32)
            for k in range(n):
                h = (h ^ (back[k] + np.uint32(k))) * factors[k]
                h ^= h >> np.uint32(15)
            found.append((h >> np.uint32(32 - bits)).astype(np.int64) + (j << bits))
        return at, where, found

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        at = np.flatnonzero(self.x)
        length = self.end - self.start
        place = at - np.repeat(self.start, length)
        h = mixed(self.x[at].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)))
        return mixed(np.add.reduceat(h, np.concatenate([[0], np.cumsum(length)[:-1]])))


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of 64-bit values spread over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
