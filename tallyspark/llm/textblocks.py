"""Vectorised text primitives: a block of whole texts as one array of code points.

Texts are joined with a separator cell between them, so that nothing runs from one text into the
next. All work below is numpy over the block; a block holds about ``BLOCK_CHARS`` characters, or
one text where a text alone is longer.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLOCK_CHARS = 1 << 18
SEP = np.uint32(0x110000)  # outside Unicode: no text holds it

U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of a 64-bit hash (splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def row_blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts sum to about ``limit`` characters."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield begin, i
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


class Block:
    """Code points ``cp`` of texts with a SEP cell after each; text d is ``cp[start[d]:stop[d]]``."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        self.cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stop = np.cumsum(lens + 1) - 1
        self.start = self.stop - lens
        self.cp[self.stop] = SEP

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.stop, positions, "left")


@lru_cache(1)
def _places(n: int) -> np.ndarray:
    return mix64(np.arange(n, dtype=U))


def piece_hashes(cp: np.ndarray, starts: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the pieces that begin at ``starts`` and run to the next; cells in ``skip`` don't count.

    A character's term is mixed with its place in the piece before terms are added, so that no two texts of two characters cancel out at any length.
    """
    if not len(starts):
        return np.zeros(0, U)
    cp = cp[starts[0] :]
    offs = starts - starts[0]
    lens = np.diff(offs, append=len(cp))
    pos = np.arange(len(cp), dtype=np.int64)
    pos -= np.repeat(offs, lens)
    longest = int(lens.max())
    value = _places(max(1 << 16, 1 << (longest - 1).bit_length()))[pos]
    value ^= cp
    value *= _M1
    value ^= value >> U(29)
    value *= _M2
    value ^= value >> U(32)
    if skip is not None:
        value[skip[starts[0] :]] = 0
    return mix64(np.add.reduceat(value, offs))


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of all cells of the ranges, one after the other."""
    stops = np.cumsum(lens)
    total = int(stops[-1]) if len(stops) else 0
    return np.arange(total) + np.repeat(starts - (stops - lens), lens)


def equal_ranges(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, a_lens: np.ndarray, b_lens: np.ndarray) -> np.ndarray:
    """Whether each range of ``a`` holds what its range of ``b`` holds."""
    out = a_lens == b_lens
    at = np.flatnonzero(out)
    lens = a_lens[at]
    mine = ranges(a_starts[at], lens)
    unlike = a[mine] != b[mine + np.repeat(b_starts[at] - a_starts[at], lens)]
    if unlike.any():
        out[np.repeat(at, lens)[unlike]] = False
    return out


_ASCII_WS = np.zeros(0x110001, bool)
_ASCII_WS[[0x20, *range(9, 14), int(SEP)]] = True


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (in cells) and hash of each word ``[^\\x20\\x09-\\x0D]+``, in order."""
    ws = _ASCII_WS[block.cp]
    edge = np.flatnonzero(np.diff(ws.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[::2], edge[1::2]  # the last cell is SEP, so each word ends
    return starts, ends, piece_hashes(block.cp, starts, ws)


def gram_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes; one entry for each start with k in the array."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = (total ^ word_hash[j : j + n]) * (_M1 if j % 2 else _M2)
            total ^= total >> U(32)
    return mix64(total)


def window_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """As ``gram_hashes``, by doubling: each step joins two hashes of half the words, in order."""
    joined = lambda a, b: mix64(a ^ mix64(b ^ _GOLD))
    done, h = 1, word_hash
    while 2 * done <= width and len(h) > done:
        h = joined(h[:-done], h[done:])
        done *= 2
    rest = width - done
    if len(word_hash) < width:
        return np.zeros(0, U)
    return joined(h[: len(h) - rest], h[rest:]) if rest else h


#: Character classes for the splitters.
LETTER, NUMBER, SPACE, OTHER, BREAK = 0, 1, 2, 3, 4


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point: letters, numbers, Unicode white space, the rest; SEP is BREAK."""
    major = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return np.append(out, np.uint8(BREAK))


def spread(flat: np.ndarray, lens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items of ``flat`` (entry e has lens[e] of them) laid out for the entries ``which``; end of each."""
    offs = np.cumsum(lens) - lens
    n = lens[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(offs[which] - (ends - n), n)
    return flat[index], ends
