"""Texts that a polynomial hash can't tell apart, at any base, through all operators that compare by hash first."""

import hashlib
import struct

import numpy as np
import pytest

from tallyspark.llm import jaccard_join, line_dedup, merge_table, packing, piece_codec, substring_dedup, textblocks

P = pytest.importorskip("public_tokenizers")
MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))
FRONT = " ".join(f"w{i}" for i in range(34))
ROWS = [(1, MORSE), (2, OTHER), (3, f"{FRONT} {MORSE}"), (4, f"{FRONT} {OTHER}"), (5, f"{MORSE} x\n1 2 3 4 5 6"), (6, f"{OTHER} x\n1 2 3 4 5 7")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_told_apart(docs):
    assert len({int(textblocks.piece_hashes(textblocks.Block([t]).cp, np.array([0]))[0]) for t in (MORSE, OTHER, MORSE[::-1])}) == len({MORSE, OTHER, MORSE[::-1]})
    assert {r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {0}
    assert {r.n_removed for r in line_dedup.line_dedup(docs, min_words=1).collect()} == {0}
    assert {(r.doc_id, r.class_id, r.copy_id, r.n_links) for r in jaccard_join.jaccard_classes(docs).collect()} == {(i, i, i, 0) for i in (1, 2, 5, 6)} | {(3, 3, 3, 1), (4, 3, 4, 1)}  # 30 of 32 runs of words are the same


def test_token_ids_are_the_library_s(docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    sp = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in piece_codec.encode_decode(docs, P.path("piece_bpe_32k.model")).collect():
        ids = sp.encode(dict(ROWS)[r.doc_id], add_bos=True, add_eos=True)
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.decoded == sp.decode(ids)
    bpe = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {}
    for r in packing.token_pieces(docs, P.path("byte_bpe_50k.json")).collect():
        got.setdefault(r.doc_id, {})[r.piece] = bytes(r.ids)
    for i, t in ROWS:
        ids = [*bpe.encode(t, add_special_tokens=False).ids, 2]
        assert b"".join(got[i][k] for k in sorted(got[i])) == struct.pack(f"<{len(ids)}I", *ids)


def test_equal_hashes_of_unequal_stretches_are_encoded_apart():
    cp = np.frombuffer("abcabcabdxyabcd".encode("utf-32-le"), "<u4")
    starts, ends = np.array([0, 3, 6, 9, 11]), np.array([3, 6, 9, 11, 15])
    calls = []

    def encode(at):
        calls.append(at.tolist())
        return np.concatenate([cp[starts[i] : ends[i]] for i in at]).astype(np.int64), (ends - starts)[at]

    d = merge_table.Distinct()
    for _ in range(2):  # from one block, then against what is kept
        flat, counts, which = d.encode(cp, starts, ends, np.array([7, 7, 7, 9, 7], np.uint64), encode)
        stops = np.cumsum(counts)
        assert [flat[stops[w] - counts[w] : stops[w]].tolist() for w in which] == [cp[i:j].tolist() for i, j in zip(starts, ends, strict=True)]
    flat, counts, which = d.encode(cp, starts[3:], ends[3:], np.array([7, 9], np.uint64), lambda at: encode(at + 3))  # kept under 7: abc; under 9: xy
    stops = np.cumsum(counts)
    assert [flat[stops[w] - counts[w] : stops[w]].tolist() for w in which] == [cp[9:11].tolist(), cp[11:15].tolist()]


def test_window_hashes():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 3, 300).astype(np.uint64)
    for width in (1, 2, 3, 12, 35, 64):
        got = textblocks.window_hashes(h, width)
        assert len(got) == 300 - width + 1
        same = {}
        for i, x in enumerate(got.tolist()):
            assert same.setdefault(tuple(h[i : i + width].tolist()), x) == x
        assert len(set(same.values())) == len(same)
    assert not len(textblocks.window_hashes(h[:5], 6)) and not len(textblocks.window_hashes(h[:0], 6))
