"""Collocations: phrases whose words meet more often than apart, from suffix automata of shards.

A text is lower-cased (A-Z alone) and split into pieces, and those into words. Everything is counted per language.

1. A shard is as many whole texts of a task as hold about ``SHARD_BYTES``. Its generalised suffix automaton is built to a bounded depth:
   states are sets of places where phrases of at most ``depth`` words end, found by sorting places level by level, on the phrase
   one word shorter and the word in front. A shard can name each substring of its states once, with the size of its end set.
2. Nearly all phrases are rare, so shards first give fingerprints alone: five bytes a phrase, in one row for each range of fingerprints.
   A range's rows are summed together, and those that reach ``least`` set a bit in a bitmap of ``FILTER_BITS``, the only thing that is broadcast.
   A frequent phrase always has its bit; the bitmap saves work and decides nothing. Ranges follow the session's shuffle partitions.
3. Shards are built again over the words whose bit is set, and give the substrings whose bit is, as text, with their counts; these are summed per
   language and phrase, and those below ``least`` go. The root's count is the number of words.
4. A phrase's cuts meet the counts of their two parts by joins. The parts of a phrase without its first word (its suffix link) and without
   its last are what it may subsume; longer phrases need no look, as what lies between counts at least as much.

The dictionary of a shard is exact, and phrases are compared as strings between shards: nothing is decided on hashes. A common phrase has
a row per shard, not per place. Each language's first phrases are found in two rounds of windows, dealt by language and hash first.

Cases: a null text holds nothing; a null language is ``und``; a text longer than a shard is a shard of its own; equal rows count as often as they
come; ties are ordered by count, then phrase; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, parallelism, staged
from .textblocks import U, mix64

SHARD_BYTES = 4 << 20
FILTER_BITS = 1 << 27
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)
_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_END = 0xFF  # after each text: no byte of UTF-8
_BREAK[[*b".,;:!?", *range(10, 14), _END]] = True
_SPACE[[0x20, 0x09]] = True
_GAP = _SPACE | _BREAK


class Words:
    """Words of texts in order: ``symbol`` (per language and word) and ``piece`` of each, and a dictionary of symbols."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        data = np.frombuffer(b"".join([t.translate(_FOLD) + b"\xff" for t in texts]), np.uint8)
        gap = _GAP[data]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
        start, stop = edge[::2], edge[1::2]  # a text's last cell is a gap, so each word stops
        # Words and the gaps between them alternate, so that one run of offsets holds both.
        bounds = np.append(np.stack([start, stop], 1).ravel(), len(data)).astype(np.int64)
        both = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = both.take(pa.array(np.arange(0, len(bounds) - 1, 2))).dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        stops = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        text = np.searchsorted(stops, start, "right")
        breaks = np.append(0, np.cumsum(_BREAK[data], dtype=np.int64))
        self.piece = breaks[start]
        size = max(len(coded.dictionary), 1)
        pairs, self.symbol = np.unique(langs[text] * size + word, return_inverse=True)
        self.words, self.langs = coded.dictionary.take(pa.array(pairs % size)), pairs // size


class BoundedAutomaton:
    """Generalised suffix automaton of word sequences, for phrases of at most ``depth`` words.

    A state is the phrases that end at the same places, each a suffix of the longest: ``longest`` and ``shortest`` have their numbers of words,
    ``places`` the size of their end set, ``end`` one place of it, and ``link`` the state of the longest phrase's longest suffix that ends
    elsewhere too (-1: the root, which ends everywhere).
    """

    def __init__(self, symbol: np.ndarray, piece: np.ndarray, depth: int):
        at, width = np.arange(len(symbol)), int(symbol.max()) + 1 if len(symbol) else 1
        group, levels, first = np.zeros(len(symbol), np.int64), [], 0
        for k in range(1, depth + 1):  # ends of each phrase of k words, sorted by the phrase without its first word and then that word
            front = at - k + 1
            inside = (front >= 0) & (piece[front] == piece[at])  # before the first word, front counts from the end, and isn't inside
            at, group, front = at[inside], group[inside], front[inside]
            made, one, group, places = np.unique(group * width + symbol[front], return_index=True, return_inverse=True, return_counts=True)
            shorter = made // width
            levels.append((at[one], places, shorter))
        low = np.zeros(0, np.int64)  # of each phrase: words of the shortest phrase that ends at the same places
        rows = []
        for k, (end, places, shorter) in enumerate(levels, 1):
            same = places == levels[k - 2][1][shorter] if k > 1 else np.zeros(len(end), bool)
            below = low
            low = np.full(len(end), k)
            if k > 1:
                low[same] = below[shorter[same]]
                rows[-1][4][shorter[same]] = False  # a longer phrase stands for the state
            rows.append((end, np.full(len(end), k), low, places, np.ones(len(end), bool), shorter))
        keep = [r[4] for r in rows]
        self.end, self.longest, self.shortest, self.places = (np.concatenate([r[i][m] for r, m in zip(rows, keep, strict=True)]) if rows else np.zeros(0, np.int64) for i in range(4))
        self.link = np.full(len(self.end), -1)
        number = []  # state of each phrase that is the longest of its state
        for m in keep:
            number.append(np.where(m, first + np.cumsum(m) - 1, -1))
            first += int(m.sum())
        for k, r in enumerate(rows, 1):
            mine, up = np.flatnonzero(r[4]), np.flatnonzero(r[4])
            for j in range(k, 0, -1):  # from the longest phrase up to the one that ends elsewhere too
                here = r[2][mine] <= j
                up[here] = rows[j - 1][5][up[here]]
                if j > 1:
                    done = r[2][mine] == j
                    self.link[number[k - 1][mine[done]]] = number[j - 2][up[done]]

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A place where each phrase of k words ends, and in how many it does."""
        own = (self.shortest <= k) & (k <= self.longest)
        return self.end[own], self.places[own]


def _fold_in(total: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return mix64((total << U(1)) ^ h)


class Shard:
    """Texts of several languages with the automaton of their words."""

    def __init__(self, texts: list[bytes], langs: list[str], depth: int, seen: np.ndarray | None = None):
        self.names = sorted(set(langs))
        code = {n: i for i, n in enumerate(self.names)}
        w = self.words = Words(texts, np.fromiter((code[x] for x in langs), np.int64, len(langs)))
        salt = np.array([xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) for n in self.names] or [0], np.uint64)
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in w.words.to_pylist()), np.uint64, len(w.words)) ^ salt[w.langs]
        self.total = np.bincount(w.langs[w.symbol], minlength=len(self.names))
        symbol, piece = w.symbol, w.piece
        if seen is not None:  # a phrase with a rare word is rare: such a word ends a piece
            kept = _has(seen, mix64(self.hash))[symbol]
            piece = (np.cumsum(~kept) + piece)[kept]
            symbol = symbol[kept]
        self.symbol, self.seen, self.automaton = symbol, seen, BoundedAutomaton(symbol, piece, depth)

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, a place and count of each phrase of k words (of those that ``seen`` may hold)."""
        end, places = self.automaton.phrases(k)
        prints = mix64(self.hash[self.symbol[end - k + 1]])
        for j in range(1, k):
            prints = _fold_in(prints, self.hash[self.symbol[end - k + 1 + j]])
        if self.seen is None:
            return prints, end, places
        kept = _has(self.seen, prints)
        return prints[kept], end[kept], places[kept]

    def text(self, end: np.ndarray, k: int) -> pa.Array:
        parts = [self.words.words.take(pa.array(self.symbol[end - k + 1 + j])) for j in range(k)]
        return parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))


def _bit(prints: np.ndarray) -> np.ndarray:
    """Place in the bitmap, from the low 32 bits."""
    return prints & U(FILTER_BITS - 1)


def _has(seen: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the bits of fingerprints."""
    at = _bit(prints)
    return (seen[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)


def _shards(docs: DataFrame, shard_bytes: int, give: Callable[[list[bytes], list[str]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``give`` yields for the texts and languages of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        langs: list[str] = []
        held = 0
        for b in batches:
            for text, lang in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("lang").to_pylist(), strict=True):
                if texts and held + len(text) > shard_bytes:
                    yield from give(texts, langs)
                    texts, langs, held = [], [], 0
                texts.append(text)
                langs.append(lang)
                held += len(text) + 1
        if texts:
            yield from give(texts, langs)

    return docs.mapInArrow(frugal(run), schema)


def frequent_prints(docs: DataFrame, depth: int, least: int, shard_bytes: int) -> np.ndarray:
    """Bitmap of the fingerprints that count ``least`` or more, as 64-bit words: always of one size."""
    bits = max(6, (4 * parallelism(docs.sparkSession) - 1).bit_length())  # the high bits of a fingerprint name its range, the low 32 tell it apart there
    kind = np.uint8 if least < 256 else np.uint32

    def give(texts: list[bytes], langs: list[str]) -> Iterator[pa.RecordBatch]:
        shard = Shard(texts, langs, depth)
        prints, counts = (np.concatenate(x) for x in zip(*(shard.phrases(k)[::2] for k in range(1, depth + 1)), strict=True))
        order = np.argsort(prints)
        prints, counts = prints[order], np.minimum(counts[order], least).astype(kind)
        ranges = (prints >> U(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.diff(ranges, prepend=-1))
        low = prints.astype(np.uint32)
        cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(first, np.append(first[1:], len(x)), strict=False)], pa.binary())
        yield from pa.table([pa.array(ranges[first].astype(np.int32)), cut(low), cut(counts)], names=["range", "ids", "counts"]).to_batches(1 << 10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, counts = -1, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(ids)
            order = np.argsort(every, kind="stable")
            every, n = every[order], np.concatenate(counts)[order]
            first = np.flatnonzero(np.diff(every.astype(np.int64), prepend=-1))
            often = every[first[np.add.reduceat(n.astype(np.int64), first) >= least]]
            bit = _bit(often.astype(U))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> U(6)).astype(np.int64)), pa.array((U(1) << (bit & U(63))).view(np.int64))], names=["cell", "bits"])

        for b in batches:
            for r, i, c in zip(*(b.column(x).to_pylist() for x in ("range", "ids", "counts")), strict=True):
                if r != at and ids:
                    yield from flush()
                    ids, counts = [], []
                at = r
                ids.append(np.frombuffer(i, np.uint32))
                counts.append(np.frombuffer(c, kind))
        if ids:
            yield from flush()

    rows = _shards(docs, shard_bytes, give, "range int, ids binary, counts binary").repartition("range").sortWithinPartitions("range")
    cells = rows.mapInArrow(frugal(run), "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    seen = np.zeros(FILTER_BITS // 64, U)
    seen[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(U)
    return seen


def phrase_counts(docs: DataFrame, depth: int = 3, least: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang``, ``words``, ``phrase`` and ``f`` of each phrase of up to ``depth`` words that counts ``least`` or more; the empty phrase counts all words."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    seen = docs.sparkSession.sparkContext.broadcast(frequent_prints(own, depth, least, shard_bytes))

    def give(texts: list[bytes], langs: list[str]) -> Iterator[pa.RecordBatch]:
        shard = Shard(texts, langs, depth, seen.value)
        names = pa.array(shard.names, pa.string())
        batch = lambda lang, k, phrase, f: pa.table([lang, pa.array(np.full(len(f), k, np.int32)), phrase, pa.array(f.astype(np.int64))], names=["lang", "words", "phrase", "f"])
        yield from batch(names, 0, pa.array([""] * len(names), pa.string()), shard.total).to_batches()
        for k in range(1, depth + 1):
            _, end, places = shard.phrases(k)
            lang = names.take(pa.array(shard.words.langs[shard.symbol[end]]))
            yield from batch(lang, k, shard.text(end, k).cast(pa.binary()).cast(pa.string()), places).to_batches(1 << 16)

    counts = _shards(own, shard_bytes, give, "lang string, words int, phrase string, f long").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return counts.filter((F.col("f") >= least) | (F.col("words") == 0) & (F.col("f") > 0))


def _cut(k: Column) -> tuple[Column, Column]:
    """The first k words of ``phrase`` and the rest."""
    first = F.substring_index("phrase", " ", k) if isinstance(k, int) else F.expr("substring_index(phrase, ' ', k)")
    return first, F.substring(F.col("phrase"), F.length(first) + 2, F.length("phrase"))


def _first_of_each(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``rank``, the first ``most`` of each language by score, count and phrase."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    deal = F.pmod(F.xxhash64("phrase"), F.lit(parallelism(rows.sparkSession)))
    best = rows.withColumn("_deal", deal).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))).filter(F.col("rank") <= most)
    return best.drop("_deal").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, covers: int = 50, most: int = 2000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each language's first ``most`` phrases of 2 to ``longest`` words.

    ``a`` is the phrase's count (``least`` at least), ``l`` and ``r`` those of the parts at its weakest cut, ``n`` the language's words, ``score`` the millionths
    of a * a / (l * r), rounded down. A phrase goes if one that holds it counts ``covers`` percent of it. ``docs`` needs ``text`` and ``lang``.
    """
    counts = staged(phrase_counts(docs, longest, least, shard_bytes), "phrases")
    phrases = counts.filter("words > 0").select("lang", "phrase", "f")
    found = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    left, right = _cut(F.col("k"))
    cuts = cuts.withColumn("left", left).withColumn("right", right)
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))").cast("decimal(38,0)")
    cuts = cuts.withColumn("over", score).withColumn("under", (wide("l") * wide("r")).cast("decimal(38,0)")).withColumn("score", F.expr("CAST(over DIV under AS BIGINT)"))
    weakest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    inside = found.filter("words > 2").withColumn("k", F.col("words") - 1)
    held = inside.withColumn("part", F.explode(F.array(_cut(F.col("k"))[0], _cut(1)[1]))).groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = weakest.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covers * F.col("a")))
    kept = kept.select("lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), F.col("w.score").alias("score"))
    total = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return _first_of_each(kept, most).join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
