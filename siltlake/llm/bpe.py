"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the code points cuts texts into chunks where their content
says so, hence passages that documents share give equal chunks wherever they
stand. A worker encodes each distinct chunk once (within a bounded memory); chunks are
not exchanged between workers. A
cut may fall inside a pretoken, so each join is repaired: from the last pretoken
before the cut the text is encoded anew until a pretoken begins at the same
place in both readings; from there on both agree exactly, since the pretoken rule
never looks back. Where they do not meet within the window, it grows, at last to
the whole text.

Defined results: a null or empty text has no ids and decodes to the empty text;
texts that hold an added token go to the library whole; repeated rows give the
same result; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import BLOCK, Encoder, encoder

#: Code points under the rolling hash; one place in CUT_ONE_IN is a cut.
WINDOW, CUT_ONE_IN = 24, 768
#: Cuts nearer than this to the one before are passed over.
SHORTEST = 96
#: Code points of chunks that a worker remembers, in each of two generations.
REMEMBERED = 3_000_000
#: Code points past a join that are read first, then next.
HEADS = (40, 600)
#: Rows that a worker turns at a time, in code points.
BATCH = 2_000_000


def cuts(enc: Encoder, texts: Sequence[str]) -> list[list[int]]:
    """Places inside each text where a chunk ends."""
    out = []
    for t in texts:
        found = []
        for at in range(0, len(t), BLOCK):
            lo = max(0, at - WINDOW)
            found += [lo + c for c in _cuts(enc, t[lo : at + BLOCK]) if lo + c > at or at == 0]
        kept, last = [], 0
        for c in found:
            if c - last >= SHORTEST and c < len(t):
                kept.append(c)
                last = c
        out.append(kept)
    return out


def _cuts(enc: Encoder, text: str) -> list[int]:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) <= WINDOW:
        return []
    with np.errstate(over="ignore"):
        codes = cp.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x632BE59BD9B4E019)
        h = np.zeros(len(cp) - WINDOW + 1, np.uint64)
        # hash of a window by doubling: of 8 code points, then of 24
        step = np.uint64(0x9E3779B97F4A7C15)
        two = codes[:-1] * step + codes[1:]
        four = two[:-2] * (step * step) + two[2:]
        eight = four[:-4] * (step * step * step * step) + four[4:]
        h = eight[:-16] * np.uint64(0xD6E8FEB86659FD93) + eight[8:-8] * np.uint64(0xA0761D6478BD642F) + eight[16:]
        h = (h ^ (h >> np.uint64(32))) * step >> np.uint64(32)
    return (np.flatnonzero(h < np.uint64((1 << 32) // CUT_ONE_IN)) + WINDOW).tolist()


def _tail(starts: np.ndarray) -> int:
    """Where the last two pretokens of a chunk begin."""
    return int(starts[max(0, len(starts) - 2)])


class ChunkEncoder:
    """Encodes whole texts from remembered chunks."""

    def __init__(self, enc: Encoder):
        self.enc = enc
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.held = 0
        self.asked = self.reused = self.repaired = self.widened = 0

    def _chunks(self, wanted: list[str]) -> dict[str, tuple]:
        found: dict[str, tuple] = {}
        missing: list[str] = []
        for w in wanted:
            if w in found:
                continue
            got = self.young.get(w) or self.old.get(w)
            found[w] = got
            if got is None:
                missing.append(w)
        self.asked += len(wanted)
        self.reused += len(wanted) - len(missing)
        for w, got in zip(missing, self.enc.encode_parts(missing), strict=True):
            ids, starts, lengths = got
            found[w] = (ids, starts.astype(np.int32), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            if self.held > REMEMBERED:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[w] = found[w]
            self.held += len(w)
        return found

    def _bridges(self, joins: list[tuple[str, tuple, str, tuple, bool]]) -> list[tuple[np.ndarray, int] | None]:
        """For each join of chunks a and b: ids from a's last two pretokens up to
        the place where both readings agree, and how many ids of b lie before it.
        Two, as the place of a chunk's last may hang on what follows: 'r, then e."""
        out: list = [None] * len(joins)
        open_ = list(range(len(joins)))
        for head in (*HEADS, None):
            if not open_:
                break
            windows = [joins[i][0][_tail(joins[i][1][1]) :] + joins[i][2][:head] for i in open_]
            left = []
            for i, w, (ids, starts, lengths) in zip(open_, windows, self.enc.encode_parts(windows), strict=True):
                a, (_, a_starts, _), b, (_, b_starts, b_upto), final = joins[i]
                tail = len(a) - _tail(a_starts)
                before = int(np.searchsorted(starts, tail))
                whole = final and (head is None or head >= len(b))
                places = starts[before : len(starts) if whole else -1] - tail
                at = np.searchsorted(b_starts, places)
                meet = np.flatnonzero((at < len(b_starts)) & (b_starts[np.minimum(at, len(b_starts) - 1)] == places))
                if len(meet):
                    k = before + int(meet[0])
                    out[i] = (ids[: int(lengths[:k].sum())], int(b_upto[at[meet[0]]]))
                else:
                    left.append(i)
            self.widened += len(left)
            open_ = left
        return out

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each whole text, as the library gives them."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and not (self.enc.special and self.enc.special.search(t))]
        marked = [i for i, t in enumerate(texts) if t and self.enc.special and self.enc.special.search(t)]
        for i, ids in zip(marked, self.enc.encode([texts[i] for i in marked]), strict=True):
            out[i] = ids
        pieces = []
        for i, c in zip(plain, cuts(self.enc, [texts[i] for i in plain]), strict=True):
            edges = [0, *c, len(texts[i])]
            pieces.append([texts[i][a:b] for a, b in zip(edges, edges[1:], strict=False)])
        known = self._chunks([c for p in pieces for c in p])
        joins = [(a, known[a], b, known[b], k == len(p) - 2) for p in pieces for k, (a, b) in enumerate(zip(p, p[1:], strict=False))]
        self.repaired += len(joins)
        bridges = iter(self._bridges(joins))
        for i, p in zip(plain, pieces, strict=True):
            mine = [next(bridges) for _ in p[1:]]
            if any(b is None for b in mine):
                out[i] = self.enc.encode([texts[i]])[0]
                continue
            parts, begin = [], 0
            for k, c in enumerate(p):
                ids, _, upto = known[c]
                if k < len(mine):
                    parts += [ids[begin : upto[max(0, len(upto) - 3)]], mine[k][0]]
                    begin = mine[k][1]
                else:
                    parts.append(ids[begin:])
            out[i] = np.concatenate(parts) if len(parts) > 1 else parts[0]
        return out


_CHUNKS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """The worker's chunk encoder for a vocabulary file."""
    if path not in _CHUNKS:
        _CHUNKS[path] = ChunkEncoder(encoder(path))
    return _CHUNKS[path]


def _little(ids: np.ndarray) -> bytes:
    return ids.astype("<u4", copy=False).tobytes()


#: What a result column holds: its type, and how it follows from ids and the decoded text.
OUTPUTS = {
    "n_tokens": (pa.int64(), lambda ids, text: len(ids)),
    "ids": (pa.list_(pa.int64()), lambda ids, text: ids.astype(np.int64)),
    "ids_le32": (pa.binary(), lambda ids, text: _little(ids)),
    "decoded": (pa.string(), lambda ids, text: text()),
    "ids_sha256": (pa.string(), lambda ids, text: hashlib.sha256(_little(ids)).hexdigest()),
    "decoded_sha256": (pa.string(), lambda ids, text: hashlib.sha256(text().encode("utf-8", "surrogatepass")).hexdigest()),
}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}


#: The C library's call that returns freed memory to the system, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system, which an idle worker would hold on to."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(ctypes.c_size_t(0))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Slices whose texts hold about ``most`` bytes; a longer text stands alone. What
    is free by the end is given back: after each slice it would cost 6 % more CPU."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.cumsum(np.diff(np.frombuffer(b.column(column).buffers()[1], np.int32)[b.column(column).offset :][: b.num_rows + 1]))
        begin = 0
        while begin < b.num_rows:
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + most, side="right")))
            yield b.slice(begin, end - begin)
            begin = end
    give_back()


def bpe(docs: DataFrame, vocabulary: str, outputs: Sequence[str] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and, if asked for, decode its ids again. One row
    per row: the id and the ``outputs`` (keys of OUTPUTS)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_encoder(vocabulary)
        for b in small_batches(batches, "text"):
            made: list[list] = [[] for _ in outputs]
            for ids in chunks.encode(b.column("text").to_pylist()):
                memo: list[str] = []

                def text(ids=ids, memo=memo) -> str:
                    if not memo:
                        memo.append(chunks.enc.decode(ids))
                    return memo[0]

                for to, name in zip(made, outputs, strict=True):
                    to.append(OUTPUTS[name][1](ids, text))
            arrays = [pa.array(m, OUTPUTS[n][0]) for m, n in zip(made, outputs, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], names=["doc_id", *outputs])

    schema = f"doc_id {kind}, " + ", ".join(f"{n} {_SQL[OUTPUTS[n][0]]}" for n in outputs)
    return rows.mapInArrow(run, schema)


def bpe_decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text of rows with ids (array of whole numbers; null: empty)."""
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            texts = [enc.decode(np.array(ids or [], np.int64)) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")
