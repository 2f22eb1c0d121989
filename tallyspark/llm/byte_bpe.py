"""Byte-level merge vocabulary: ids exactly as the ``tokenizers`` library gives them.

The library takes about a second for each megabyte of these texts. Here the splitting rule of the
vocabulary is worked out on arrays of code points and the prefix table of ``merge_table`` gives the
ids of each distinct stretch. A text that holds a special token's string is left to the library.
"""

from __future__ import annotations

import json

import numpy as np

from .merge_table import TABLE_CHARS, Distinct, MergeTable
from .textblocks import BREAK, LETTER, OTHER, SEP, SPACE, Block, char_classes, piece_hashes, ranges, row_blocks, spread

_models: dict[str, "ByteBPE"] = {}
#: Fixed values of the splitting rule: contractions that stand alone behind an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_names() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


def split_points(cp: np.ndarray) -> np.ndarray:
    """Starts of the stretches of the splitting rule, separators included.

    A run of letters, of numbers or of other signs takes a space before it along; white space keeps
    its last character apart if a run follows; contractions stand alone.
    """
    kind = char_classes()[cp]
    cut = np.ones(len(cp), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == BREAK)
    space = kind == SPACE
    tail = np.zeros(len(cp), bool)  # last white space before a run
    tail[:-1] = space[:-1] & (kind[1:] != SPACE) & (kind[1:] != BREAK)
    cut |= tail
    cut[1:][tail[:-1] & (cp[:-1] == 32)] = False
    alone = np.flatnonzero(cut & (cp == 39) & (kind == OTHER))
    for i in alone.tolist():
        for c in CONTRACTIONS:
            to = i + 1 + len(c)
            if to < len(cp) and np.array_equal(cp[i + 1 : to], [ord(x) for x in c]):
                cut[i + 1] = False
                cut[to] |= kind[to] == LETTER
                break
    return np.flatnonzero(cut)


class ByteBPE:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_names()
        specials = {t["content"] for t in spec["added_tokens"]}
        self.specials = sorted(specials)
        vocab = {"".join(chr(byte[c]) for c in p): i for p, i in spec["model"]["vocab"].items() if p not in specials}
        order = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            order["".join(chr(byte[c]) for c in a + b)] = r
        self.distinct = Distinct()
        self.table = MergeTable(vocab, {p: order.get(p, -1) for p in vocab})

    def _encode_stretches(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = ends - starts
        cells, stops = cp[ranges(starts, lens)], np.cumsum(lens)
        width = 1 + (cells > 0x7F).astype(np.int64) + (cells > 0x7FF) + (cells > 0xFFFF)
        raw = np.frombuffer(cells.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.uint32)
        at = np.append(0, np.cumsum(width))[np.append(0, stops)]
        return self.table.encode(raw, at[:-1], at[1:])

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, flat, and where each text's ids end."""
        cp = block.cp
        starts = split_points(cp)
        ends = np.append(starts[1:], len(cp))
        hashes = piece_hashes(cp, starts)
        real = cp[starts] != SEP
        starts, ends, hashes = starts[real], ends[real], hashes[real]
        flat, counts, which = self.distinct.encode(cp, starts, ends, hashes, lambda at: self._encode_stretches(cp, starts[at], ends[at]))
        ids, stops = spread(flat, counts, which)
        return ids, np.append(0, stops)[np.searchsorted(starts, block.stop, "left")]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text."""
        out: list[np.ndarray] = []
        for lo, hi in row_blocks(texts, TABLE_CHARS):
            own = [any(s in t for s in self.specials) for t in texts[lo:hi]]
            ids, ends = self.encode_block(Block(["" if x else t for x, t in zip(own, texts[lo:hi], strict=True)]))
            at = 0
            for x, t, to in zip(own, texts[lo:hi], ends.tolist(), strict=True):
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4") if x else ids[at:to])
                at = to
        return out


def model(path: str) -> ByteBPE:
    """The vocabulary of this path, loaded once in each worker."""
    if path not in _models:
        _models[path] = ByteBPE(path)
    return _models[path]
