"""Removal of word runs that occur elsewhere, by suffix automata of reference shards.

A window is ``window`` consecutive words. Every word covered by a window whose word sequence also
starts anywhere else is removed, in all its places. Windows are judged on the input.

Here the reference is the corpus itself. It grows with the corpus, so its automata can't be broadcast,
and meeting every document with every shard would take time that grows with the square. So
shards are dealt by content, and a document meets only the shards that hold something of it:

1. The anchor of a window is its smallest hash of ``GRAM`` words. Consecutive windows with one anchor
   form a segment. Equal windows have equal anchors, so only anchors with two places matter.
2. Each distinct segment of such an anchor is kept once, with its number of places, and goes to the
   shard of its anchor. Shards are bounded in words.
3. A shard builds the suffix automaton of its segments and streams them through: the matching
   statistic at a word is the longest run ending there that occurs twice, and where it reaches
   ``window`` a repeated window ends. Consecutive ones are one maximal span.
4. An anchor with more words than a shard may hold is dealt out again by whole windows, counted by
   128 bits of hash; that takes any number of segments, and gives the same spans.
5. Every segment's spans go back to its places, one row each, and are cut out of the texts.

Cases: null text counts as empty; texts shorter than a window lose nothing; equal texts of two ids
remove each other; rows of one id with unequal texts are documents of their own, equal rows remove
each other; an empty table gives no rows. What is left keeps its white space. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, frugal, rewritten, staged, texts_of
from .textblocks import Block, gram_hashes, mix64, row_blocks, window_hashes, words

WINDOW = 35
GRAM = 12
SHARD_WORDS = 200_000
_POSITION_BITS = np.uint64(28)
_WORD = re.compile(rb"[^ \t-\r]+")


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive entries."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // width)
    full = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    ahead = np.minimum.accumulate(full.reshape(rows, width), axis=1).ravel()
    back = np.minimum.accumulate(full.reshape(rows, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(block: Block, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document, first and last window, anchor hash, content hash."""
    starts, _, hashes = words(block)
    doc = block.doc_of(starts)
    n = len(starts) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    grams = gram_hashes(hashes, gram)
    cell = (grams >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
    anchor = sliding_min(cell, window - gram + 1)[:n] & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))
    anchor = anchor.astype(np.int64)
    valid = doc[:n] == doc[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (doc[1:n] != doc[: n - 1])
    first = np.flatnonzero(new & valid)
    stop = np.append(np.flatnonzero(new | ~valid), n)
    last = stop[np.searchsorted(stop, first, "right")] - 1
    # The content is its first and its last window, which meet or overlap, and how far apart they are.
    whole = window_hashes(hashes, window)
    content = mix64(whole[first] ^ mix64(whole[last] + (last - first).astype(np.uint64)))
    base = np.searchsorted(doc, doc[first], "left")
    return doc[first], first - base, last - base, grams[anchor[first]].view(np.int64), content.view(np.int64)


class SuffixAutomaton:
    """Suffix automaton of several word sequences with the number of places of each state."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _state(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.places.append(0)
        return len(self.length) - 1

    def _clone(self, p: int, c: bytes, q: int) -> int:
        k = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        self.link[q] = k
        return k

    def add(self, sequence: list[bytes], weight: int) -> None:
        at = 0
        nxt, link, length = self.next, self.link, self.length
        for c in sequence:
            q = nxt[at].get(c)
            if q is not None:
                at = q if length[q] == length[at] + 1 else self._clone(at, c, q)
            else:
                new = self._state(length[at] + 1, {}, 0)
                p = at
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                at = new
            self.places[at] += weight

    def close(self) -> None:
        """Count places for all states; then the longest suffix of each that has two."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in reversed(order):
            self.places[self.link[v]] += self.places[v]
        self.twice = [0] * len(self.length)
        for v in order:
            self.twice[v] = self.length[v] if self.places[v] >= 2 else self.twice[self.link[v]]

    def statistics(self, sequence: list[bytes]) -> Iterator[int]:
        """For each word of a sequence the length of the longest run ending there that occurs twice.

        Words that the automaton doesn't hold set it back, so any text can be streamed.
        """
        at = size = 0
        for c in sequence:
            while at and c not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if c in self.next[at]:
                at, size = self.next[at][c], size + 1
            yield size if self.places[at] >= 2 and at else min(size, self.twice[at])


def shard_hits(rows: list[tuple[int, int, int, bytes]], window: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """Repeated windows of a shard's segments ``(key, content, count, text)``: key, content, first and last of each span."""
    automaton = SuffixAutomaton()
    split = [r[3].split() for r in rows]
    for (_, _, n, _), seq in zip(rows, split, strict=True):
        automaton.add(seq, min(n, 2))
    automaton.close()
    for (key, content, _, _), seq in zip(rows, split, strict=True):
        first, last = [], []
        for i, m in enumerate(automaton.statistics(seq), 1 - window):
            if m >= window:
                if last and last[-1] == i - 1:
                    last[-1] = i
                else:
                    first.append(i)
                    last.append(i)
        if first:
            yield key, content, first, last


def two_hashes(segment: bytes, window: int) -> np.ndarray:
    """Two 64-bit hashes (rows) of each window of a segment."""
    _, _, hashes = words(Block([segment.decode()]))
    return np.stack([window_hashes(hashes, window), window_hashes(mix64(hashes), window)]).view(np.int64)


HITS = "key long, content long, first array<int>, last array<int>"


def _runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, names, tids = b.column("text").to_pylist(), b.column("doc_id").to_numpy(), b.column("tid").to_numpy()
            for lo, hi in row_blocks(texts):
                doc, first, last, key, content = anchor_runs(Block(texts[lo:hi]), window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(names[lo:hi][doc]), pa.array(tids[lo:hi][doc]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(key), pa.array(content)], names=["doc_id", "tid", "a", "b", "key", "content"])

    return docs.mapInArrow(frugal(run), "doc_id long, tid int, a int, b int, key long, content long")


def _segment_texts(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """Texts of the segments (key, content, n, large, doc_id, tid, a, b), fetched from their documents."""
    lists = wanted.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("a", "b", "key", "content", "n", "large")).alias("segments"))  # at most one per word of the document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, segments = b.column("text"), b.column("segments")
            for i in range(b.num_rows):
                w = texts[i].as_py().encode().split()
                rows = segments.slice(i, 1).flatten()
                own = {c: rows.field(c) for c in ("key", "content", "n", "large")}
                cut = [b" ".join(w[lo : hi + window]) for lo, hi in zip(rows.field("a").to_pylist(), rows.field("b").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*own.values(), pa.array(cut, pa.binary())], names=[*own, "segment"])

    return docs.join(lists, ["doc_id", "tid"]).mapInArrow(frugal(run), "key long, content long, n long, large boolean, segment binary")


def _shards(segments: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Spans of all segments whose anchor fits a shard; those of one anchor come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        words_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            hits = list(shard_hits(held, window))
            if hits:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), kinds, strict=True)], names=["key", "content", "first", "last"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "content", "n", "segment")), strict=True):
                if held and row[:2] == held[-1][:2]:
                    continue  # from an equal row
                if words_held >= shard_words and row[0] != held[-1][0]:
                    yield from flush()
                    held, words_held = [], 0
                held.append(row)
                words_held += row[3].count(b" ") + 1
        if held:
            yield from flush()

    return segments.repartition("key").sortWithinPartitions("key", "content").mapInArrow(frugal(run), HITS)


def _large_anchors(segments: DataFrame, window: int) -> DataFrame:
    """Spans of the segments of anchors that fit no shard, by counting their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, content, n, segment in zip(*(b.column(c).to_pylist() for c in ("key", "content", "n", "segment")), strict=True):
                one, two = two_hashes(segment, window)
                same = [pa.array(np.full(len(one), x)) for x in (key, content, n)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(one), dtype=np.int32)), pa.array(one), pa.array(two)], names=["key", "content", "n", "at", "one", "two"])

    # Dealt by content, which spreads an anchor's segments over all tasks.
    each = segments.dropDuplicates(["key", "content"]).repartition("content").mapInArrow(frugal(run), "key long, content long, n long, at int, one long, two long")
    each = staged(each, "windows")
    often = staged(each.groupBy("one", "two").agg(F.sum("n").alias("places")).filter("places >= 2").drop("places"), "often")
    of_segment = each.join(often, ["one", "two"]).groupBy("key", "content").agg(F.array_sort(F.collect_set("at")).alias("hits"))  # at most one per window of a segment
    edge = lambda step: F.filter("hits", lambda x: ~F.array_contains("hits", x + step))
    return of_segment.select("key", "content", edge(-1).alias("first"), edge(1).alias("last"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Word spans to remove of each document of ``docs`` (``doc_id``, ``tid``, ``text``) that has any.

    ``doc_id``, ``tid`` and ``spans`` (structs of ``from`` and ``to``, exclusive, which may overlap).
    """
    runs = staged(_runs(docs, window, gram), "runs")
    # Any place of a segment will do for its text: all columns of one row are taken.
    place = [F.first(c).alias(c) for c in ("doc_id", "tid", "a", "b")]
    each = staged(runs.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), *place), "each")
    size = F.sum(F.col("b") - F.col("a") + window)
    anchors = each.groupBy("key").agg(F.sum("n").alias("places"), (size > shard_words).alias("large")).filter("places >= 2").drop("places")
    anchors = staged(anchors, "anchors")  # so that a common anchor's rows can be split in the join
    segments = staged(_segment_texts(each.join(anchors, "key"), docs, window), "segments")
    hits = _shards(segments.filter("NOT large"), window, shard_words).unionByName(_large_anchors(segments.filter("large"), window))
    hits = staged(hits, "hits")  # one row per segment: the join makes one per place, and a common segment's places can be split
    dropped(each, anchors, segments)
    at = lambda f, l: F.struct((F.col("a") + f).alias("from"), (F.col("a") + l + window).alias("to"))  # noqa: E731, E741
    found = runs.join(hits, ["key", "content"], "left").select("doc_id", "tid", F.zip_with("first", "last", at).alias("spans"))
    spans = found.groupBy("doc_id", "tid").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most one per word of the document
    return spans.filter(F.size("spans") > 0)


def cut_words(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """Text without the words in the spans, the number of its words and of those removed."""
    raw = text.encode()
    if not spans:
        return text, len(raw.split()), 0
    starts = [m.start() for m in _WORD.finditer(raw)]
    ends = [*starts, len(raw)]
    out, at, removed = [], 0, 0
    for lo, hi in sorted(spans):
        lo = max(lo, at)
        if hi > lo:
            out.append(raw[ends[at] if at else 0 : ends[lo]])
            removed += hi - lo
            at = hi
    out.append(raw[ends[at] :])
    return b"".join(out).decode(), len(starts), removed


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: tuple[str, ...] = (), shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, the cleaned ``text`` and the ``keep`` columns of each document.

    ``docs`` needs ``doc_id`` and ``text``.
    """
    tid = F.hash("text").alias("tid")  # tells rows of one id apart
    spans = repeated_spans(texts_of(docs).select("doc_id", tid, "text"), window, gram, shard_words)
    own = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]

    def cut(text: str, spans: list[dict] | None) -> tuple:
        out, n, removed = cut_words(text, [(x["from"], x["to"]) for x in spans or ()])
        return n, removed, out

    return rewritten(texts_of(docs, keep).withColumn("tid", tid).join(spans, ["doc_id", "tid"], "left"), "spans", cut, own, keep)
