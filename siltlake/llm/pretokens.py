"""Encoding many texts with a byte-level BPE of the tokenizers library.

The library is asked for each distinct pretoken once; texts are cut into
pretokens and these are looked up with array operations. Character classes are
learned from the library itself, one probe for each new code point, so the cut
agrees with its own. Texts that hold an added token go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

#: Code points handled at a time; bounds the working arrays.
BLOCK = 1 << 19
#: Pretokens, and code points of them, that a worker remembers before it starts afresh.
MAX_KNOWN = 1_000_000
MAX_POINTS = 16_000_000
TABLE_BITS = 22
#: Pretokens of so many ASCII characters or fewer are their own keys: numbers to the
#: base 129, below 2**57. Keys of others have the highest bit set. Up to twice as many
#: characters are told apart by the key and the number of the first ones, as the base
#: is odd and the rest follows from both; past that, by their code points.
SHORT, BASE = 8, 129
_HASHED, _NONE = np.uint64(1 << 63), np.uint64((1 << 64) - 1)
_LETTER, _NUMBER, _OTHER, _SPACE, _NEW = 0, 1, 2, 3, 255
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(BLOCK + 1, base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(steps))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class KeyTable:
    """Numbers of 64-bit keys, by open addressing over arrays: many keys at once."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(_MULTIPLIER)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it has none. No key is 0."""
        out, slot, open_ = np.full(len(keys), -1, np.int64), self._slots(keys), np.arange(len(keys))
        while len(open_):
            at = slot[open_]
            held = self.keys[at]
            same = held == keys[open_]
            out[open_[same]] = self.values[at[same]]
            open_ = open_[~same & (held != 0)]
            slot[open_] = (slot[open_] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, first: int) -> None:
        """Number new and distinct keys from ``first`` on."""
        slot, open_ = self._slots(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], first + put
            open_ = np.setdiff1d(open_, put, assume_unique=True)
            slot[open_] = (slot[open_] + 1) & self.mask


class Pool:
    """A growing array."""

    def __init__(self, kind: type):
        self.held, self.size = np.zeros(1 << 16, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.size + len(x) > len(self.held):
            self.held = np.concatenate([self.held[: self.size], np.zeros(max(len(self.held), len(x)), self.held.dtype)])
        self.held[self.size : self.size + len(x)] = x
        self.size += len(x)


class Encoder:
    """Encodes texts exactly as ``Tokenizer.encode(add_special_tokens=False)``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.kinds = np.full(0x110000, _NEW, np.uint8)
        # ASCII stands for itself, so that short pretokens are numbers
        self.codes = np.arange(0x110000, dtype=np.uint64)
        self.codes[128:] = _mixed(self.codes[128:] + np.uint64(0x632BE59BD9B4E019))
        self.up, self.down = _powers()
        self._forget()
        self._bytes: list[bytes] | None = None

    def _forget(self) -> None:
        self.place = KeyTable(TABLE_BITS)
        # code points of the known pretokens, and where each one's end
        self.points, self.until = Pool(np.uint32), np.zeros(1, np.int64)
        self.heads = Pool(np.uint64)
        self.offset = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn_kinds(self, cp: np.ndarray) -> None:
        cut = lambda text: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        for c in np.unique(cp).tolist():
            ch = chr(c)
            self.kinds[c] = _LETTER if cut("a" + ch) == 1 else _NUMBER if cut("1" + ch) == 1 else _OTHER if cut("!" + ch) == 1 else _SPACE

    def starts(self, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mask of the pretokens' first code points; ``first`` marks where texts begin."""
        n = len(cp)
        kind = self.kinds[cp]
        if (new := kind == _NEW).any():
            self._learn_kinds(cp[new])
            kind = self.kinds[cp]
        change = np.empty(n, bool)
        change[0] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        change |= first
        space = kind == _SPACE
        start = change.copy()
        # the last white space before other text stands alone, or joins it if a blank
        tail = np.zeros(n, bool)
        tail[:-1] = space[:-1] & ~space[1:] & ~first[1:]
        start |= tail
        joined = np.zeros(n, bool)
        joined[1:] = (tail & (cp == 32))[:-1]
        start &= ~joined
        quotes = np.flatnonzero((cp == 39) & change & ~joined)
        if len(quotes):
            self._contractions(cp, kind, first, start, quotes)
        return start

    @staticmethod
    def _contractions(cp, kind, first, start, quotes) -> None:
        """An apostrophe that begins a pretoken takes s, t, m, d, re, ve or ll."""
        n = len(cp)
        at = lambda k: np.where((quotes + k < n), cp[np.minimum(quotes + k, n - 1)], 0)
        open_ = lambda k: (quotes + k < n) & ~first[np.minimum(quotes + k, n - 1)]
        one, two = at(1), at(2)
        short = open_(1) & np.isin(one, [115, 116, 109, 100])
        long = open_(1) & open_(2) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for q, width in ((quotes[short], 1), (quotes[long & ~short], 2)):
            start[q + 1] = False
            if width == 2:
                start[q + 2] = False
            after = q + width + 1
            after = after[after < n]
            # what is left of the word begins a pretoken; elsewhere the cut is as before
            start[after[kind[after] == _LETTER]] = True

    def _ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, begin: np.ndarray, end: np.ndarray, heads: np.ndarray, cp: np.ndarray, text: str) -> int:
        """Let the library encode pretokens; the number of the first of them."""
        first, at, stop = len(self.length), begin.tolist(), end.tolist()
        ids = self._ids_of([text[a:b] for a, b in zip(at, stop, strict=True)])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.uint32, int(lengths.sum()))
        self.offset = np.concatenate([self.offset, len(self.pool) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.pool = np.concatenate([self.pool, flat])
        self.points.add(np.concatenate([cp[a:b] for a, b in zip(at, stop, strict=True)]))
        self.heads.add(heads)
        self.until = np.concatenate([self.until, self.until[-1] + np.cumsum(end - begin)])
        return first

    def _lookup(self, keys, begin, end, heads, headed: np.ndarray, others: np.ndarray, cp: np.ndarray, text: str) -> np.ndarray:
        """Index into offset and length for each pretoken. A hashed key finds what may
        be it; then its head (``headed``) or its code points (``others``) decide, and a
        pretoken whose key is another's is read anew."""
        got = self.place.find(keys)
        if len(missing := np.flatnonzero(got < 0)):
            new, sample, which = np.unique(keys[missing], return_index=True, return_inverse=True)
            sample = missing[sample]
            first = self._learn(begin[sample], end[sample], heads[sample], cp, text)
            self.place.add(new, first)
            got[missing] = first + which
        wrong = []
        if len(some := headed):
            n = got[some]
            wrong.append(some[(self.heads.held[n] != heads[some]) | (self.until[n + 1] - self.until[n] != end[some] - begin[some])])
        if len(some := others):
            first, size, known = begin[some], (end - begin)[some], self.until[got[some]]
            same = self.until[got[some] + 1] - known == size
            stop = np.cumsum(size)
            at = np.arange(stop[-1]) + np.repeat(first - (stop - size), size)
            like = cp[at] == self.points.held[np.minimum(at + np.repeat(known - first, size), self.points.size - 1)]
            wrong.append(some[~(same & np.logical_and.reduceat(like, stop - size))])
        if len(again := np.concatenate([*wrong, np.zeros(0, np.int64)]).astype(np.int64)):
            got[again] = self._learn(begin[again], end[again], heads[again], cp, text) + np.arange(len(again))
        return got

    def _block(self, texts: Sequence[str], parts: bool = False) -> tuple:
        """Ids of all texts, and each text's number of ids. At most BLOCK code
        points. With ``parts`` instead of the number, for each text the starts of
        its pretokens and their numbers of ids."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text = "".join(texts)
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        first = np.zeros(len(cp), bool)
        first[(ends - sizes)[sizes > 0]] = True
        begin = np.flatnonzero(self.starts(cp, first))
        end = np.append(begin[1:], len(cp))
        size = end - begin
        with np.errstate(over="ignore"):
            total = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum(self.codes[cp] * self.up[: len(cp)], out=total[1:])
            keys = (total[end] - total[begin]) * self.down[begin]
        odd = np.zeros(len(begin), bool)
        odd[np.searchsorted(begin, np.flatnonzero(cp - np.uint32(1) >= 127), side="right") - 1] = True
        hashed, heads = np.flatnonzero(odd | (size > SHORT)), np.full(len(begin), _NONE)
        headed = (size[hashed] <= 2 * SHORT) & ~odd[hashed]
        with np.errstate(over="ignore"):
            keys[hashed] = _mixed(keys[hashed] + size[hashed].astype(np.uint64)) | _HASHED
            first = begin[hashed[headed]]
            heads[hashed[headed]] = (total[first + SHORT] - total[first]) * self.down[first]
        if len(self.length) > MAX_KNOWN or self.points.size > MAX_POINTS:
            self._forget()
        at = self._lookup(keys, begin, end, heads, hashed[headed], hashed[~headed], cp, text)
        lengths = self.length[at]
        stop = np.cumsum(lengths)
        ids = self.pool[np.arange(stop[-1]) + np.repeat(self.offset[at] - (stop - lengths), lengths)]
        last = np.searchsorted(begin, ends)
        counts = np.diff(np.concatenate([[0], np.concatenate([[0], stop])[last]]))
        if not parts:
            return ids, counts
        cuts = last[:-1]
        own = [b - e for b, e in zip(np.split(begin, cuts), (ends - sizes).tolist(), strict=True)]
        return ids, counts, own, np.split(lengths, cuts)

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each whole text; null is empty."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        held: list[int] = []
        size = 0

        def flush() -> None:
            if held:
                ids, counts = self._block([texts[i] for i in held])
                for i, part in zip(held, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    out[i] = part
                held.clear()

        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) > BLOCK or (self.special and self.special.search(t)):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            if size + len(t) > BLOCK:
                flush()
                size = 0
            held.append(i)
            size += len(t)
        flush()
        return out

    def encode_parts(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text (not empty, free of added tokens): its ids, the starts of
        its pretokens, and how many ids each has."""
        out: list = [None] * len(texts)
        held: list[int] = []
        size = 0

        def flush() -> None:
            if held:
                ids, counts, starts, lengths = self._block([texts[i] for i in held], parts=True)
                for i, *part in zip(held, np.split(ids, np.cumsum(counts)[:-1]), starts, lengths, strict=True):
                    out[i] = tuple(part)
                held.clear()

        for i, t in enumerate(texts):
            if len(t) > BLOCK:
                pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(t)
                ids = self._ids_of([t[a:b] for _, (a, b) in pieces])
                out[i] = (
                    np.array([x for y in ids for x in y], np.uint32),
                    np.array([a for _, (a, _) in pieces], np.int64),
                    np.fromiter(map(len, ids), np.int64, len(ids)),
                )
                continue
            if size + len(t) > BLOCK:
                flush()
                size = 0
            held.append(i)
            size += len(t)
        flush()
        return out

    def token_bytes(self) -> list[bytes]:
        """Bytes of each id; an added token stands for its own text."""
        if self._bytes is None:
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            to_byte = {chr(b): b for b in printable}
            to_byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            added = self.tokenizer.get_added_tokens_decoder()
            table = [b""] * (max(vocabulary.values()) + 1)
            for token, i in vocabulary.items():
                table[i] = token.encode() if i in added or any(c not in to_byte for c in token) else bytes(to_byte[c] for c in token)
            self._bytes = table
        return self._bytes

    def decode(self, ids: np.ndarray) -> str:
        """As ``Tokenizer.decode(ids, skip_special_tokens=False)``."""
        table = self.token_bytes()
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
