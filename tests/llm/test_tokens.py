"""3, 6 and 9: ids against the libraries, files and sequences against the ids."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import common, packing, rans, token_output, unigram

from .conftest import EDGES


def library(name):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(token_output.vocabulary(name))
    return lambda text: tool.encode(text or "", add_special_tokens=False).ids


def test_rans_roundtrip():
    rng = np.random.default_rng(1)
    for n in (1, 2, rans.BLOCK, rans.BLOCK + 1, 100_000):
        ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint32)
        coded = rans.encode(ids)
        assert (rans.decode(coded) == ids).all()
    assert (rans.decode(coded, (2, 4)) == ids[2 * rans.BLOCK : 4 * rans.BLOCK]).all()
    for at in (10, len(coded) // 2, len(coded) - 1):
        damaged = bytearray(coded)
        damaged[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            rans.decode(bytes(damaged))


def written(rows, got):
    encode, at = library("byte_bpe_50k.json"), 0
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (doc_id, text), r in zip(rows, sorted(got, key=lambda r: r.start), strict=True):
        ids = np.array([*encode(text), 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_output(spark, sf, small):
    written(small[1], token_output.op3_token_output(spark, sf).collect())


def test_token_output_edges(spark, edges, nothing):
    path = common.scratch_path(spark, "tokens")
    token_output.write(edges, path, token_output.vocabulary("byte_bpe_50k.json"))
    rows = token_output.read(spark, path).collect()
    written(EDGES, rows)
    assert all(len(r.ids) == r.n_tokens for r in rows)
    path = common.scratch_path(spark, "tokens")
    token_output.write(nothing, path, token_output.vocabulary("byte_bpe_50k.json"))
    assert token_output.digests(spark, path).count() == 0


def packed(rows, got):
    encode = library("word_bpe_49k.json")
    left = sorted(([*encode(t), 1] for _, t in rows), key=lambda x: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0) and r.length > 0
        sequences[r.sequence_id] = r.offset + r.length
    for r in got:
        assert sequences[r.sequence_id] == r.sequence_tokens <= 2048
    assert sum(n & (n - 1) != 0 for n in sequences.values()) <= 8
    assert sum(sequences.values()) == sum(map(len, left))
    return left


def test_packing(spark, sf, small):
    got = packing.op6_packing(spark, sf).collect()
    packed(small[1], got)
    encode, by = library("word_bpe_49k.json"), {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in small[1]:
        ids, at = np.array([*encode(text), 1], "<u4"), 0
        for r in by.pop(doc_id):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by


def test_packing_edges(edges, nothing):
    vocabulary = token_output.vocabulary("word_bpe_49k.json")
    got = packing.packed(edges, vocabulary, with_ids=True).collect()
    packed(EDGES, got)
    assert all(len(r.ids) == r.length for r in got)
    assert packing.packed(nothing, vocabulary).count() == 0


def as_unigram(path, scores):
    """The model file with other scores and, as its kind, unigram."""

    def number(data, i):
        value = shift = 0
        while True:
            byte = data[i]
            i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, i

    def fields(data):
        i = 0
        while i < len(data):
            begin = i
            tag, i = number(data, i)
            body = b""
            if tag & 7 == 0:
                _, i = number(data, i)
            elif tag & 7 == 2:
                n, i = number(data, i)
                body, i = data[i : i + n], i + n
            else:
                i += 4 if tag & 7 == 5 else 8
            yield tag >> 3, body, data[begin:i]

    def framed(tag, body):
        n, size = len(body), b""
        while n >= 128:
            size, n = size + bytes([n & 127 | 128]), n >> 7
        return bytes([tag]) + size + bytes([n]) + body

    out, k = b"", 0
    with open(path, "rb") as f:
        data = f.read()
    for field, body, whole in fields(data):
        if field == 1:
            out += framed(0x0A, b"".join(w for f, _, w in fields(body) if f != 2) + b"\x15" + struct.pack("<f", scores.get(k, 0.0)))
            k += 1
        elif field == 2:
            out += framed(0x12, b"".join(w for f, _, w in fields(body) if f != 3) + b"\x18\x01")
        else:
            out += whole
    return out


def test_unigram_is_the_librarys(small):
    """Equal ids, or another best path: then of the same score, but for rounding."""
    from sentencepiece import SentencePieceProcessor

    path = token_output.vocabulary("piece_bpe_32k.model")
    own = unigram.Unigram(path)
    scores = dict(zip(own.normal.tolist(), own.scores.tolist(), strict=True))
    theirs = SentencePieceProcessor(model_proto=as_unigram(path, scores))
    texts = [t for _, t in small[1]] + [t or "" for _, t in EDGES if len(t or "") < 10_000] + [" " * 40, "▁▁ y", "\n\n\t"]
    total = lambda ids: sum(scores.get(i, 0.0) for i in ids)
    different = 0
    for at, ids, counts in own.encode(pa.array(texts)):
        for k, one in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
            want = theirs.encode(texts[at + k])
            if one.tolist() != want:
                different += 1
                assert total(one.tolist()) == pytest.approx(total(want), rel=1e-5)
            if "▁" not in texts[at + k]:
                assert own.decode(one).decode() == texts[at + k]
    assert different < 0.1 * len(texts)


def test_unigram(spark, sf, small, edges, nothing):
    got = unigram.op9_unigram(spark, sf).collect()
    assert len(got) == len(small[1]) and all(r.round_trip for r in got)
    path = token_output.vocabulary("piece_bpe_32k.model")
    rows = unigram.encoded(edges, path).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in EDGES)
    assert {r.doc_id for r in rows if not r.round_trip} == {8}
    assert all(len(r.ids) == r.n_tokens and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert unigram.encoded(nothing, path).count() == 0
