"""Static range asymmetric numeral coding of token ids.

One frequency table, counted over the whole corpus, is shared by all blocks.
A block holds up to BLOCK tokens dealt over LANES interleaved coders whose words
go to one stream; a checkpoint every EVERY steps keeps the lanes' states and the
place in the stream, so that parts of a block decode side by side. Blocks are
independent and carry checksums of their words and of their ids. All coding is
done on arrays: many blocks and lanes at each step.

Defined results: no ids make a block of none; a symbol that the table has not is
refused; a table of one symbol codes it in no bits; damage in a block's words, ids
or head is found by its checksums and raises an error.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC, VERSION = b"SLRA", 1
BLOCK, LANES, EVERY = 1 << 16, 64, 256
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sBBHIIQ")


@dataclass
class FrequencyTable:
    """Frequencies of symbols that sum to 2**scale, and what coding needs of them."""

    symbols: np.ndarray
    freq: np.ndarray
    scale: int

    @classmethod
    def from_counts(cls, symbols: np.ndarray, counts: np.ndarray, scale: int = 20) -> FrequencyTable:
        """Scaled counts; every symbol that occurs keeps at least 1."""
        order = np.argsort(symbols)
        symbols, counts = np.asarray(symbols, np.int64)[order], np.asarray(counts, np.float64)[order]
        if not len(symbols):
            return cls(np.zeros(1, np.int64), np.array([1 << scale], np.int64), scale)
        while len(symbols) * 4 > 1 << scale:
            scale += 1
        if scale > 30:
            raise ValueError("too many symbols for one table")
        freq = np.maximum(1, np.floor(counts * ((1 << scale) / counts.sum()))).astype(np.int64)
        over = int(freq.sum()) - (1 << scale)
        for i in np.argsort(-freq, kind="stable"):
            if over == 0:
                break
            new = max(1, int(freq[i]) - over)
            over -= int(freq[i]) - new
            freq[i] = new
        return cls(symbols, freq, scale)

    def __post_init__(self) -> None:
        cum = np.cumsum(self.freq) - self.freq
        size = int(self.symbols.max()) + 1
        self._f, self._c = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self._f[self.symbols], self._c[self.symbols] = self.freq, cum
        self._slot: np.ndarray | None = None
        self.filler = int(self.symbols[np.argmax(self.freq)])

    def slots(self) -> np.ndarray:
        """Symbol of each of the 2**scale slots."""
        if self._slot is None:
            self._slot = np.repeat(self.symbols, self.freq).astype(np.uint32)
        return self._slot


def _code(tokens: np.ndarray, table: FrequencyTable) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """tokens: (blocks, steps, lanes). Words of each block, the states and the
    place in the words at each checkpoint."""
    blocks, steps, lanes = tokens.shape
    shift, scale = np.uint64(63 - table.scale), np.uint64(table.scale)
    x = np.full((blocks, lanes), _LOW, np.uint64)
    words, out = np.zeros((blocks, steps, lanes), np.uint32), np.zeros((blocks, steps, lanes), bool)
    marks = (steps + EVERY - 1) // EVERY
    states = np.zeros((blocks, marks, lanes), np.uint64)
    for s in range(steps - 1, -1, -1):
        sym = tokens[:, s, :]
        f = table._f[sym]
        full = x >= f << shift
        out[:, s, :] = full
        words[:, s, :] = x & np.uint64(0xFFFFFFFF)
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << scale) + (x - q * f) + table._c[sym]
        if s % EVERY == 0:
            states[:, s // EVERY, :] = x
    upto = np.cumsum(out.sum(axis=2), axis=1)
    at = np.arange(marks) * EVERY
    places = np.where(at == 0, 0, upto[:, at - 1]).astype(np.uint32)
    return [words[k][out[k]] for k in range(blocks)], states, places


def encode(ids: np.ndarray, table: FrequencyTable) -> bytes:
    """A frame: head, then for each block its number of tokens and words and its
    checksums, then checkpoints, then words. All little-endian."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and (int(ids.max()) >= len(table._f) or not table._f[ids].all()):
        raise ValueError("an id is not in the frequency table")
    n = len(ids)
    whole = n // BLOCK
    groups = []
    for k in range(0, whole, 32):
        m = min(32, whole - k)
        groups.append(ids[k * BLOCK : (k + m) * BLOCK].reshape(m, BLOCK // LANES, LANES))
    if rest := n - whole * BLOCK:
        padded = np.full(-(-rest // LANES) * LANES, table.filler, np.uint32)
        padded[:rest] = ids[whole * BLOCK :]
        groups.append(padded.reshape(1, -1, LANES))
    index, marks, body, at = [], [], [], 0
    for g in groups:
        words, states, places = _code(g, table)
        for k, w in enumerate(words):
            size = min(BLOCK, n - at)
            raw = w.astype("<u4", copy=False).tobytes()
            index.append(struct.pack("<IIII", size, len(w), zlib.crc32(raw), zlib.crc32(ids[at : at + size].tobytes())))
            marks.append(places[k].astype("<u4").tobytes() + states[k].astype("<u8").tobytes())
            body.append(raw)
            at += size
    return b"".join([_HEAD.pack(MAGIC, VERSION, table.scale, LANES, EVERY, len(index), n), *index, *marks, *body])


def decode(frame: bytes, table: FrequencyTable) -> np.ndarray:
    """The frame's ids. Fails on a wrong checksum, state or format."""
    magic, version, scale, lanes, every, blocks, n = _HEAD.unpack_from(frame)
    if (magic, version) != (MAGIC, VERSION) or scale != table.scale:
        raise ValueError("not a frame of this format and table")
    index = np.frombuffer(frame, "<u4", 4 * blocks, _HEAD.size).reshape(blocks, 4).astype(np.int64)
    at = _HEAD.size + 16 * blocks
    steps = -(-index[:, 0] // lanes)
    marks = -(-steps // every)
    places, states = [], []
    for m in marks.tolist():
        places.append(np.frombuffer(frame, "<u4", m, at).astype(np.int64))
        states.append(np.frombuffer(frame, "<u8", m * lanes, at + 4 * m).reshape(m, lanes))
        at += 4 * m + 8 * m * lanes
    words = np.frombuffer(frame, "<u4", int(index[:, 1].sum()), at)
    begin = np.cumsum(index[:, 1]) - index[:, 1]
    for k in range(blocks):
        if zlib.crc32(words[begin[k] : begin[k] + index[k, 1]].tobytes()) != index[k, 2]:
            raise ValueError(f"block {k}: its words do not match their checksum")
    if not blocks:
        return np.zeros(0, np.uint32)
    # every stretch between checkpoints is a unit of its own
    unit_block = np.repeat(np.arange(blocks), marks)
    unit_mark = np.concatenate([np.arange(m) for m in marks.tolist()])
    unit_steps = np.minimum(every, steps[unit_block] - unit_mark * every)
    pointer = begin[unit_block] + np.concatenate(places)
    state = np.concatenate(states)
    out = np.zeros((len(unit_block), every, lanes), np.uint32)
    last = np.empty_like(state)
    for lo in range(0, len(unit_block), 256):
        u = slice(lo, lo + 256)
        last[u] = _decode_units(words, pointer[u], state[u], unit_steps[u], out[u], table)
    following = np.full_like(state, _LOW)
    inner = np.flatnonzero(unit_mark[1:] > 0)
    following[inner] = state[inner + 1]
    if (last != following).any():
        raise ValueError("a stretch does not end in the state of the next checkpoint")
    pieces, k0 = [], 0
    for k, m in enumerate(marks.tolist()):
        piece = out[k0 : k0 + m].reshape(-1)[: index[k, 0]]
        if zlib.crc32(piece.tobytes()) != index[k, 3]:
            raise ValueError(f"block {k}: its ids do not match their checksum")
        pieces.append(piece)
        k0 += m
    got = np.concatenate(pieces)
    if len(got) != n:
        raise ValueError("wrong number of ids")
    return got


def _decode_units(words, pointer, x, unit_steps, out, table) -> np.ndarray:
    mask, scale = np.uint64((1 << table.scale) - 1), np.uint64(table.scale)
    slots, pointer, x = table.slots(), pointer.copy(), x.copy()
    if not len(words):
        words = np.zeros(1, np.uint32)
    for s in range(out.shape[1]):
        on = s < unit_steps
        if not on.any():
            break
        live = slice(None) if on.all() else np.flatnonzero(on)
        y = x[live]
        slot = y & mask
        sym = slots[slot]
        out[live, s, :] = sym
        y = table._f[sym] * (y >> scale) + slot - table._c[sym]
        need = y < _LOW
        rank = np.cumsum(need, axis=1)
        where = np.minimum(pointer[live][:, None] + rank - 1, len(words) - 1)
        y = np.where(need, (y << np.uint64(32)) | words[np.maximum(where, 0)], y)
        pointer[live] += rank[:, -1]
        x[live] = y
    return x
