"""Texts as arrays of code points: words, prefixes and n-grams without loops.

Classes and lower case are filled in for each code point when it is first met.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Code points handled at a time.
BLOCK = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NEW = 255


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class CodePoints:
    def __init__(self) -> None:
        self.kind = np.full(0x110000, _NEW, np.uint8)
        self.lower = np.zeros(0x110000, np.uint32)

    def arrays(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased code points, and a mask of letters (and marks and digits
        stay out of it)."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[cp]
        if (new := kind == _NEW).any():
            for c in np.unique(cp[new]).tolist():
                low = chr(c).lower()
                self.kind[c] = chr(c).isalpha()
                self.lower[c] = ord(low) if len(low) == 1 else c
            kind = self.kind[cp]
        return self.lower[cp], kind == 1

    def words(self, text: str, prefixes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """For each run of letters its place and a row of keys: the whole word,
        then its prefixes (0 where the word is not longer than that)."""
        cp, letter = self.arrays(text)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        if not len(begin):
            return begin, np.zeros((0, 1 + len(prefixes)), np.uint64)
        size = end - begin
        out = np.zeros((len(begin), 1 + len(prefixes)), np.uint64)
        codes = mix(cp.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        with np.errstate(over="ignore"):
            # Horner's rule over all words at once; long words are few in each step
            h, live, k = np.zeros(len(begin), np.uint64), np.arange(len(begin)), 0
            while len(live):
                h[live] = h[live] * _STEP + codes[begin[live] + k]
                k += 1
                longer = size[live] > k
                if k in prefixes:
                    out[live[longer], 1 + list(prefixes).index(k)] = mix(h[live[longer]] + np.uint64(k))
                live = live[longer]
        out[:, 0] = mix(h + np.uint64(1 << 20))
        return begin, out

    def grams(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the n-grams that hold a letter at both ends or one
        blank between or beside words; what is no letter counts as a blank."""
        cp, letter = self.arrays(text)
        m = len(cp) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        codes = np.where(letter, cp, 32).astype(np.uint64)
        blanks = np.concatenate([[0], np.cumsum(~letter)])
        keep = np.flatnonzero(blanks[n : n + m] - blanks[:m] <= 1)
        with np.errstate(over="ignore"):
            h = codes[keep]
            for k in range(1, n):
                h = h * np.uint64(0x110001) + codes[keep + k]
        return keep, mix(h)


def blocks(texts: Sequence[str | None], most: int = BLOCK) -> Iterator[tuple[list[int], str, np.ndarray]]:
    """Groups of texts joined by a blank: their numbers, the joined text, and
    where each begins. A long text stands alone."""
    held: list[int] = []
    size = 0

    def made() -> tuple[list[int], str, np.ndarray]:
        parts = [texts[i] or "" for i in held]
        begin = np.cumsum([1, *(len(p) + 1 for p in parts[:-1])])
        return list(held), " " + " ".join(parts) + " ", begin

    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if held and size + n > most:
            yield made()
            held, size = [], 0
        held.append(i)
        size += n
    if held:
        yield made()
