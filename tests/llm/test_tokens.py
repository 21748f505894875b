"""BPE and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siltlake.llm import bpe, pretokens, rans, tokenfile
from siltlake.llm.pretokens import Encoder, KeyTable

ALPHABET = "ab  \n\t'sStredvelm1 2²½,.!'’ñßé\u00a0\u2003你好😀\u0301"


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="module")
def fuzz():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 300))) for _ in range(1500)]
    return [*texts, "", "a<|endoftext|>b", "'s", "it's", "'save 'll're", "  '  's", "x" * 5000, " " * 4000, "'s" * 900, " \n a", "a \n"]


def test_key_table():
    rng = np.random.default_rng(3)
    keys, table = rng.integers(1, 2**63, 30).astype(np.uint64), KeyTable(5)
    table.add(keys[:10], 0)
    table.add(keys[10:20], 10)
    assert table.find(keys).tolist() == [*range(20), *[-1] * 10]


def test_pretokens_agree(vocabulary, library, fuzz):
    enc = Encoder(vocabulary)
    want = [e.ids for e in library.encode_batch(fuzz, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(fuzz)] == want
    assert [enc.decode(np.array(x)) for x in want] == library.decode_batch(want, skip_special_tokens=False)


@pytest.mark.parametrize("one_in, shortest", [(3, 1), (6, 1), (40, 8)])
def test_chunks_agree(vocabulary, library, fuzz, monkeypatch, one_in, shortest):
    monkeypatch.setattr(bpe, "CUT_ONE_IN", one_in)
    monkeypatch.setattr(bpe, "SHORTEST", shortest)
    chunks = bpe.ChunkEncoder(Encoder(vocabulary))
    want = [e.ids for e in library.encode_batch(fuzz, add_special_tokens=False)]
    assert [x.tolist() for x in chunks.encode(fuzz)] == want
    assert chunks.repaired > 100


def test_shared_passages_are_encoded_once(vocabulary):
    rnd = random.Random(1)
    passage = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000))
    chunks = bpe.ChunkEncoder(Encoder(vocabulary))
    chunks.encode([f"head {i} " * i + passage for i in range(1, 9)])
    assert chunks.reused > 0.6 * chunks.asked


def test_bpe_operator(docs, rows, no_docs, vocabulary, library):
    got = bpe.bpe(docs, vocabulary, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.bpe(no_docs, vocabulary).count() == 0
    back = bpe.bpe_decode(bpe.bpe(docs, vocabulary, ("ids",)), vocabulary).collect()
    assert {r.doc_id: r.text for r in back} == {r.doc_id: r.decoded for r in got}


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 16384, 65536, 65537, 200_000])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, 50255).astype(np.uint32)
    table = rans.FrequencyTable.from_counts(*np.unique(ids, return_counts=True))
    assert table.freq.sum() == 1 << table.scale and table.freq.min() >= 1
    frame = rans.encode(ids, table)
    assert (rans.decode(frame, table) == ids).all()


def test_rans_sees_damage():
    ids = np.arange(5000, dtype=np.uint32) % 97
    table = rans.FrequencyTable.from_counts(*np.unique(ids, return_counts=True))
    frame = bytearray(rans.encode(ids, table))
    frame[-9] ^= 4
    with pytest.raises(ValueError):
        rans.decode(bytes(frame), table)
    with pytest.raises(ValueError):
        rans.encode(np.array([500], np.uint32), table)


def test_token_files(spark, docs, rows, no_docs, vocabulary, library, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(docs, path, vocabulary)
    got = tokenfile.read_tokens(spark, path, with_ids=True).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = {}, 0
    for r in order:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        raw = np.array(ids, "<u4").tobytes()
        want.setdefault(r[0], []).append((start, len(ids), zlib.crc32(raw), raw))
        start += len(ids)
    have = {}
    for r in sorted(got, key=lambda r: r.start):
        have.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)))
    assert have == want
    tokenfile.write_tokens(no_docs, str(tmp_path / "none"), vocabulary)
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_token_files_over_many_frames(spark, docs, vocabulary, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME", 40)
    tokenfile.write_tokens(docs.repartition(5), str(tmp_path / "t"), vocabulary)
    got = sorted(tokenfile.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id or 0 for r in got] == sorted(r.doc_id or 0 for r in got)


def test_pretokens_of_one_key_are_told_apart(vocabulary, monkeypatch):
    """With keys that agree for most pretokens, ids are still the library's."""
    texts = ["wonderful wonderfully wondering extraordinarily extraordinary über Überraschung naïve naïvely 你好世界 你好 internationalisation internationalization"] * 3
    enc = pretokens.Encoder(vocabulary)
    monkeypatch.setattr(pretokens, "_mixed", lambda x: x % np.uint64(3))
    got = [ids.tolist() for ids in enc.encode(texts) + enc.encode(texts)]
    assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts * 2]


def test_codes_of_short_pretokens_are_numbers(vocabulary):
    enc = pretokens.Encoder(vocabulary)
    assert (enc.codes[:128] == np.arange(128)).all() and pretokens.BASE**pretokens.SHORT < 1 << 57
