"""Bin completion against brute force, and op5 as registered."""

import random
import zlib
from functools import lru_cache
from itertools import combinations

import numpy as np
import pytest

import __spark_entry__ as E
from tallyspark.llm import packing

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"


def optimum(sizes, capacity):
    """Least number of sequences, by trying all."""

    @lru_cache(None)
    def go(left, open_rooms):
        if not left:
            return 0
        size, rest = left[0], left[1:]
        tried = [1 + go(rest, tuple(sorted((*open_rooms, capacity - size))))]
        for room in set(open_rooms):
            if room >= size:
                rooms = list(open_rooms)
                rooms.remove(room)
                tried.append(go(rest, tuple(sorted((*rooms, room - size)))))
        return min(tried)

    return go(tuple(sorted(sizes, reverse=True)), ())


def test_optimal():
    rnd = random.Random(8)
    for _ in range(60):
        sizes = [rnd.randrange(2, 20) for _ in range(rnd.randrange(1, 11))]
        counts = np.bincount(sizes, minlength=21)
        plan, least = packing.pack_counts(counts, 20)
        used = sum(k for _, k in plan)
        assert least <= optimum(sizes, 20) == used
    hard = np.bincount([37, 37, 36, 35, 27, 25, 23, 16, 16, 14, 11, 9, 5], minlength=61)  # best-fit decreasing takes one more
    assert sum(k for _, k in packing.best_fit_plan(hard, 60)) == 6 and sum(k for _, k in packing.pack_counts(hard, 60)[0]) == 5


def test_fillings():
    """All undominated fillings within the allowance, each once, and no other."""
    rnd = random.Random(2)
    for _ in range(200):
        left = np.bincount([rnd.randrange(1, 16) for _ in range(rnd.randrange(1, 9))], minlength=17)
        longest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[longest] -= 1
        pool = [x for x in range(17) for _ in range(rest[x])]
        every = {tuple(sorted(f, reverse=True)) for k in range(len(pool) + 1) for f in combinations(pool, k) if sum(f) <= 16 - longest}
        top = max(map(sum, every))

        def beaten(f):
            others = list(pool)
            for x in f:
                others.remove(x)
            waste = 16 - longest - sum(f)
            return any(sum(sub) < p <= sum(sub) + waste or p == sum(sub) and k > 1 for k in range(len(f) + 1) for sub in combinations(f, k) for p in others)

        for allowance in (0, 2, 16):
            want = sorted(((longest, *f) for f in every if sum(f) >= top - allowance and not beaten(f)), reverse=True)
            assert list(map(tuple, packing.fillings(left, 16, allowance))) == want


def test_query(spark):
    """Library ids of every document, gapless places, and the least number of sequences, reached and proven."""
    from tokenizers import Tokenizer

    got = E.queries()["op5_best_fit_packing"](spark, SF).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    of = dict(zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True))
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for k, rows in pieces.items():
        ids, at = np.array([*of[k].ids, 2], "<u4"), 0
        for n, r in enumerate(sorted(rows, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == 1024 or n == 0
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(sequences) == got[0].sequences == got[0].least_sequences
