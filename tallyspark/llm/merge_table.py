"""The prefix table of a merge-type vocabulary, filled for many stretches of text at once.

For every prefix of a text exactly one piece ends the prefix's encoding. The table holds these last
pieces. A piece that begins where a prefix ends, and is compatible with that prefix's last piece, is
the last piece of the longer prefix; compatible means that merging the joined text of the two gives
just these two. The pieces that begin at a place come from an automaton over all pieces. The ids are
read backwards through the finished table.

All stretches of a block advance together, one numpy step for each place and automaton depth, so
the cost does not depend on how often a stretch has been seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .textblocks import equal_ranges, ranges

DENSE = 128  # symbols with most automaton edges, which get a dense table
SLOTS = 1 << 21  # of remembered compatibility tests
UNSET = -(1 << 40)
KEPT_IDS = 1 << 21
TABLE_CHARS = 1 << 20  # of a block: larger blocks have fewer distinct stretches


class MergeTable:
    """``pieces``: text of each piece to its id; ``rank``: order in which merges are made (lower first).

    A symbol that is no piece stands for itself as ``-1 - symbol`` in the results.
    """

    def __init__(self, pieces: dict[str, int], rank: dict[str, float]):
        self.ids = pieces
        order = {p: i for i, p in enumerate(sorted((p for p in pieces if len(p) > 1), key=lambda p: (rank[p], pieces[p])))}
        self.rank = {p: order.get(p, -1) for p in pieces}
        self.names = {i: p for p, i in pieces.items()}
        self.length = np.ones(max(self.names) + 1, np.int64)
        self.halves: dict[str, tuple[str, str]] = {}
        reachable = []
        for p, i in pieces.items():
            self.length[i] = len(p)
            if len(p) > 1:
                *_, self.halves[p] = self.merges(p)
            if len(p) == 1 or "".join(self.halves[p]) == p:  # others end no prefix
                reachable.append(p)
        self._automaton(reachable)
        self.slot_key = np.full(SLOTS, -1, np.int64)
        self.slot_ok = np.zeros(SLOTS, bool)

    def _automaton(self, reachable: list[str]) -> None:
        edges: dict[tuple[int, str], int] = {}
        token = [-1]
        uses: dict[str, int] = {}
        for p in reachable:
            at = 0
            for c in p:
                to = edges.get((at, c))
                if to is None:
                    to = edges[at, c] = len(token)
                    token.append(-1)
                    uses[c] = uses.get(c, 0) + 1
                at = to
            token[at] = self.ids[p]
        self.token = np.array(token, np.int64)
        by_use = sorted(uses, key=lambda c: -uses[c])
        self.symbol = np.full(0x110001, -1, np.int32)
        for i, c in enumerate(by_use):
            self.symbol[ord(c)] = i
        self.dense = np.full((len(token), DENSE), -1, np.int32)
        rare = []
        for (at, c), to in edges.items():
            i = int(self.symbol[ord(c)])
            if i < DENSE:
                self.dense[at, i] = to
            else:
                rare.append(((at << 21) | i, to))
        rare.sort()
        self.rare_key = np.array([k for k, _ in rare] or [-1], np.int64)
        self.rare_to = np.array([t for _, t in rare] or [-1], np.int64)

    def merges(self, text: str) -> Iterator[tuple[str, str]]:
        """The pairs that merging joins, in order: the best pair of the text, leftmost of equals."""
        parts = list(text)
        yield "", ""
        while True:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                return
            i = best[1]
            yield parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def name(self, piece: int) -> str:
        return self.names[piece] if piece >= 0 else chr(-1 - piece)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives these two.

        Undo the merges of both sides from the latest on: the pieces stand unless some pair across
        the seam would have been joined before the merges still undone (on the left, equal ranks go
        first, as merging takes the leftmost).
        """
        a, b = self.name(left), self.name(right)
        rank, limit = self.rank, 1 << 40
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            if len(a) == 1 == len(b):
                return True
            if rank.get(a, -1) > rank.get(b, -1):
                limit, a = rank[a], self.halves[a][1]
            else:
                limit, b = rank[b] + 1, self.halves[b][0]

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = ((left + 0x110001) << 32) | right
        slot = ((key * np.int64(-7046029254386353131)) >> 43) & (SLOTS - 1)
        hit = self.slot_key[slot] == key
        ok = self.slot_ok[slot]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            keys, first, which = np.unique(key[miss], return_index=True, return_inverse=True)
            at = miss[first]
            said = np.fromiter(map(self.compatible, left[at].tolist(), right[at].tolist()), bool, len(at))
            self.slot_key[slot[at]], self.slot_ok[slot[at]] = keys, said
            ok[miss] = said[which]
        return ok

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next automaton states; -1 where no piece goes on."""
        to = self.dense[state, np.minimum(symbol, DENSE - 1)].astype(np.int64)
        odd = (symbol < 0) | (symbol >= DENSE)
        if odd.any():
            key = (state[odd].astype(np.int64) << 21) | symbol[odd]
            at = np.minimum(np.searchsorted(self.rare_key, key), len(self.rare_key) - 1)
            to[odd] = np.where((self.rare_key[at] == key) & (symbol[odd] >= 0), self.rare_to[at], -1)
        return to

    def encode(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all stretches ``cp[starts[i]:ends[i]]``, flat, and how many each has."""
        n = len(starts)
        order = np.argsort(starts - ends, kind="stable")  # longest first: those still running are a prefix
        begin, size = starts[order], (ends - starts)[order]
        off = np.cumsum(size + 1) - size - 1
        last = np.full(int((size + 1).sum()), UNSET, np.int64)
        symbols = self.symbol[cp]
        running = n
        for j in range(int(size[0]) if n else 0):
            running = int(np.searchsorted(-size, -j, "left"))  # size > j
            here = off[:running] + j
            before = last[here]
            if j:
                lone = before == UNSET
                if lone.any():
                    before[lone] = -1 - cp[begin[:running][lone] + j - 1].astype(np.int64)
                    last[here] = before
            who = np.arange(running)
            state = np.zeros(running, np.int64)
            depth = 0
            while len(who):
                state = self._step(state, symbols[begin[who] + (j + depth)])
                depth += 1
                on = state >= 0
                who, state = who[on], state[on]
                piece = self.token[state]
                full = np.flatnonzero(piece >= 0)
                if len(full):
                    w, p = who[full], piece[full]
                    if j:
                        ok = self._compatible(before[w], p)
                        w, p = w[ok], p[ok]
                    last[off[w] + (j + depth)] = p
                on = size[who] > j + depth
                if not on.all():
                    who, state = who[on], state[on]
        return self._read_back(cp, order, begin, size, off, last)

    def _read_back(self, cp, order, begin, size, off, last) -> tuple[np.ndarray, np.ndarray]:
        at = size.copy()
        count = np.zeros(len(size), np.int64)
        steps = []
        who = np.flatnonzero(at > 0)
        while len(who):
            piece = last[off[who] + at[who]]
            lone = piece == UNSET
            if lone.any():
                piece[lone] = -1 - cp[begin[who[lone]] + at[who[lone]] - 1].astype(np.int64)
            steps.append((who, piece))
            count[who] += 1
            at[who] -= np.where(piece < 0, 1, self.length[np.maximum(piece, 0)])
            who = who[at[who] > 0]
        counts = np.zeros(len(size), np.int64)
        counts[order] = count
        stop = np.cumsum(counts)[order]  # in the order given, counted from the stretches' own places
        flat = np.zeros(int(count.sum()), np.int64)
        for k, (who, piece) in enumerate(steps):
            flat[stop[who] - 1 - k] = piece
        return flat, counts


class Distinct:
    """Ids of distinct stretches, found by hash and compared as code points. Those of earlier blocks are kept, as far as ``KEPT_IDS`` ids go; then it starts afresh."""

    def __init__(self) -> None:
        self.hashes, self.ids, self.cells = np.zeros(0, np.uint64), np.zeros(0, "<u4"), np.zeros(0, np.uint32)
        self.starts = self.counts = self.cell_starts = self.cell_counts = np.zeros(0, np.int64)

    def encode(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct stretches ``cp[starts[i]:ends[i]]``, flat; how many each has; which of them each stretch is.

        ``encode`` gives flat ids and counts for the stretches at the places given to it.
        """
        lens = ends - starts
        own, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, own)
        new = np.append(self.hashes, np.uint64(0))[at] != own
        new |= at == len(self.hashes)
        if new.any():
            fresh = first[new]
            ids, counts = encode(fresh)
            if len(self.ids) + len(ids) > KEPT_IDS and len(self.ids):
                self.__init__()
                return self.encode(cp, starts, ends, hashes, encode)
            every = np.append(self.hashes, own[new])
            order = np.argsort(every, kind="stable")
            self.starts, self.counts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)[order], np.append(self.counts, counts)[order]
            self.cell_starts, self.cell_counts = np.append(self.cell_starts, len(self.cells) + np.cumsum(lens[fresh]) - lens[fresh])[order], np.append(self.cell_counts, lens[fresh])[order]
            self.hashes, self.ids = every[order], np.append(self.ids, ids.astype("<u4"))
            self.cells = np.append(self.cells, cp[ranges(starts[fresh], lens[fresh])].astype(np.uint32))
            at = np.searchsorted(self.hashes, own)
        kept = at[which]
        unlike = np.flatnonzero(~equal_ranges(cp, starts, self.cells, self.cell_starts[kept], lens, self.cell_counts[kept]))
        counts = self.counts[at]
        flat = self.ids[ranges(self.starts[at], counts)]
        if len(unlike):  # another stretch has this hash: its ids aren't kept
            ids, more = encode(unlike)
            which[unlike] = len(own) + np.arange(len(unlike))
            flat, counts = np.append(flat, ids.astype("<u4")), np.append(counts, more)
        return flat, counts, which
