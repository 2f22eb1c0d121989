"""Near-duplicate join: MinHash banding for candidates, n-gram sets for the verdict.

A document's set holds its runs of ``n`` words (words are ``[^\\x20\\x09-\\x0D]+``); a text of fewer
words has its whole word sequence as the only element. Two documents are linked if the Jaccard
similarity of their sets is at least ``threshold``, decided in integers on the full sets.

1. Documents with one word sequence are copies and are carried on as one.
2. ``bands`` hashes of ``rows`` minima each: ``banding`` takes the most selective number of rows
   whose number of bands, within the number of minima given, misses a pair at the threshold with
   probability below ``miss``.
3. Band hashes are shuffled. The pairs that share a bucket are checked first, by their sketches (a byte
   of each minimum): two members are tied if so many bytes are equal that a pair at the threshold
   misses it by ``SPREAD`` standard deviations at most. Who is like the bucket's first member needs no more; the
   others are held against all. A bucket of more than ``BUCKET`` members ties all to its first one instead,
   since what follows decides either way.
4. Components of the ties are clusters. Sets are fetched once for documents in clusters. A cluster larger
   than a block is dealt into blocks, and each pair of blocks is a piece of work of its own, so no task
   holds a cluster. In a piece of work all pairs are verified by products of incidence matrices; what
   leaves it is one row per document: its number of links and one tie of a spanning forest.
5. Components of the verified ties are the classes.

A set's elements are 64-bit hashes of its runs of words, and word sequences are told apart by two of them.

Cases: null text counts as empty; documents without words have no set and are linked to nothing.
Copies are linked (similarity 1) and counted, but never expanded into pairs. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, staged, texts_of
from .components import components
from .textblocks import Block, gram_hashes, mix64, row_blocks, words

N_WORDS = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction
MISS = 1e-5
MINIMA = 256
SPREAD = 5.0
BUCKET = 1024
BLOCK_DOCS = 400
BLOCK_GRAMS = 1_000_000
COLUMNS = 4096


def banding(threshold: float, miss: float, minima: int) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands, at most ``minima`` hashes in all, reach the recall."""
    best = (minima, 1)
    for rows in range(1, minima + 1):
        bands = next((b for b in range(1, minima // rows + 1) if (1 - threshold**rows) ** b <= miss), 0)
        if not bands:
            return best
        best = (bands, rows)
    return best


def gram_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set elements of a block in document order, their documents, and two hashes of each word sequence."""
    starts, _, hashes = words(block)
    doc = block.doc_of(starts)
    docs = len(block.stop)
    grams = gram_hashes(hashes, n)
    inside = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
    count = np.bincount(doc, minlength=docs)
    base = np.cumsum(count) - count
    order = np.arange(len(hashes), dtype=np.uint64) - base[doc].astype(np.uint64)
    whole = []
    for seed in (0x51ED270B, 0x2545F491):
        term = mix64(hashes ^ mix64(order * np.uint64(2) + np.uint64(seed)))
        total = np.zeros(docs, np.uint64)
        if len(term):
            filled = np.flatnonzero(count)
            total[filled] = np.add.reduceat(term, base[filled])
        whole.append(mix64(total + count.astype(np.uint64)))
    short = np.flatnonzero((count > 0) & (count < n))
    element = np.concatenate([grams[inside], whole[0][short]])
    owner = np.concatenate([doc[: len(grams)][inside], short])
    by = np.argsort(owner, kind="stable")
    return element[by], owner[by], whole[0].view(np.int64), whole[1].view(np.int64)


def band_hashes(element: np.ndarray, owner: np.ndarray, docs: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (documents x bands) and sketches (documents x minima); documents without elements have no meaning there."""
    rng = np.random.Generator(np.random.PCG64(20240607))
    factor = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)
    out, sketch = np.zeros((docs, bands), np.uint64), np.zeros((docs, bands * rows), np.uint8)
    if not len(element):
        return out, sketch
    filled, at = np.unique(owner, return_index=True)
    x = (element >> np.uint64(32)).astype(np.uint32)
    y = np.empty_like(x)
    for b in range(bands):
        band = np.full(len(filled), np.uint64(b))
        for r in range(b * rows, (b + 1) * rows):
            np.multiply(x, factor[r], out=y)
            np.add(y, shift[r], out=y)
            y ^= y >> np.uint32(15)
            least = np.minimum.reduceat(y, at)
            sketch[filled, r] = least.astype(np.uint8)
            band = mix64(band ^ least.astype(np.uint64))
        out[filled, b] = band
    return out, sketch


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in row_blocks(texts):
                element, owner, one, two = gram_sets(Block(texts[lo:hi]), n)
                sig, sketch = band_hashes(element, owner, hi - lo, bands, rows)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, bands, dtype=np.int32)), pa.array(sig.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.bincount(owner, minlength=hi - lo)), pa.array(one), pa.array(two), flat, pa.array([x.tobytes() for x in sketch], pa.binary())], names=["doc_id", "n_grams", "one", "two", "bands", "sketch"])

    return docs.mapInArrow(frugal(run), "doc_id long, n_grams long, one long, two long, bands array<long>, sketch binary")


def least_equal(threshold: tuple[int, int], minima: int) -> int:
    """Equal bytes of two sketches that a pair at the threshold has, but for ``SPREAD`` standard deviations."""
    t = threshold[0] / threshold[1]
    return int(minima * t - SPREAD * (minima * t * (1 - t)) ** 0.5)


def bucket_ties(sketch: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Ties of a spanning forest of a bucket's members (places), like pairs connected.

    Each member in turn that isn't like an earlier centre becomes a centre and is held against all. Two members like
    two centres haven't met then, so what is left is to hold the groups against one another.
    """
    group = np.full(len(sketch), -1)
    root = np.arange(len(sketch))
    for c in range(len(sketch)):
        if group[c] < 0:
            like = np.flatnonzero((sketch == sketch[c]).sum(axis=1) >= least)
            group[like[group[like] < 0]] = c
            for i in like.tolist():
                if root[i] != root[c]:
                    yield i, c
                    root[root == root[i]] = root[c]
    for x in range(len(sketch)):
        others = np.flatnonzero(root != root[x])
        if group[x] != x and len(others):
            for i in others[(sketch[others] == sketch[x]).sum(axis=1) >= least].tolist():
                if root[i] != root[x]:
                    yield i, x
                    root[root == root[i]] = root[x]


def _bucket_ties(members: DataFrame, least: int) -> DataFrame:
    """Ties of members (``bucket``, ``rep``, ``sketch``) that are alike; a bucket's members come together."""

    def ties(bucket: np.ndarray, rep: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.diff(first, append=len(bucket))
        centre = np.repeat(first, size)
        like = (sketch == sketch[centre]).sum(axis=1) >= least
        whole = np.minimum.reduceat(like, first)  # all are like the first one
        plain = np.repeat(whole, size) & (np.arange(len(rep)) != centre)
        src, dst = [rep[plain]], [rep[centre[plain]]]
        for lo, n in zip(first[~whole].tolist(), size[~whole].tolist(), strict=True):
            if found := list(bucket_ties(sketch[lo : lo + n], least)):
                i, j = np.array(found).T
                src.append(rep[lo + i])
                dst.append(rep[lo + j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = b.column("bucket").to_numpy(), b.column("rep").to_numpy(), np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            now = now if held is None else tuple(map(np.concatenate, zip(held, now, strict=True)))
            cut = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0  # the last bucket may go on
            if cut:
                yield from ties(*(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
        if held is not None:
            yield from ties(*held)

    return members.repartition("bucket").sortWithinPartitions("bucket", "rep").mapInArrow(frugal(run), "src long, dst long")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """Distinct set elements of each document, sorted, as 64-bit integers in binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in row_blocks(texts):
                element, owner, _, _ = gram_sets(Block(texts[lo:hi]), n)
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                sets = [np.unique(element[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in b.schema.names if c != "text"), pa.array(sets, pa.binary())], names=[*(c for c in b.schema.names if c != "text"), "grams"])

    schema = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(frugal(run), f"{schema}, grams binary")


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Which pairs of sets reach the threshold: a matrix, of ``left`` with itself if ``right`` is None.

    Sets are sorted distinct integers. Only elements that two sets share have a column.
    """
    both = left + (right or [])
    size = np.fromiter(map(len, both), np.int64, len(both))
    element = np.concatenate(both) if both else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(both)), size)
    by = np.argsort(element, kind="stable")
    element, owner = element[by], owner[by]
    new = np.ones(len(element), bool)
    new[1:] = element[1:] != element[:-1]
    column = np.cumsum(new) - 1
    times = np.bincount(column)
    keep = times[column] > 1
    owner, column = owner[keep], column[keep]
    if len(column):
        column = np.cumsum(np.append(False, column[1:] != column[:-1]))
    n = len(left)
    common = np.zeros((n, len(right) if right is not None else n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        part = np.zeros((len(both), min(COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        part[owner[i:j], column[i:j] - lo] = 1
        common += part[:n] @ (part[n:] if right is not None else part).T
    a, b = size[:n, None], size[n:][None, :] if right is not None else size[None, :n]
    shared = common.astype(np.int64)
    p, q = threshold
    out = (shared * (p + q) >= p * (a + b)) & (a > 0) & (b > 0)
    if right is None:
        np.fill_diagonal(out, False)
    return out


def _forest(match: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component in a symmetric matrix."""
    root = np.arange(len(match))
    while True:
        near = np.where(match, root[None, :], len(match)).min(axis=1, initial=len(match))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _work(rows: list[tuple[int, int, int, np.ndarray]], crossed: bool, threshold: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
    """One piece of work: (block side, id, copies, set) rows to (id, links to other sets, tie)."""
    rows.sort(key=lambda r: (r[0], r[1]))
    ids = np.array([r[1] for r in rows])
    copies = np.array([r[2] for r in rows])
    if not crossed:
        match = linked([r[3] for r in rows], None, threshold)
    else:
        n = sum(r[0] == 0 for r in rows)
        match = np.zeros((len(rows), len(rows)), bool)
        match[:n, n:] = linked([r[3] for r in rows[:n]], [r[3] for r in rows[n:]], threshold)
        match |= match.T
    root = _forest(match)
    links = match @ copies
    for i in np.flatnonzero(match.any(axis=1)).tolist():
        yield int(ids[i]), int(links[i]), int(ids[root[i]])


def _verified(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links and ties of documents with ``rep``, ``copies``, ``cluster``, ``parts``, ``grams``."""
    block = F.pmod(F.xxhash64("rep"), "parts")
    dealt = sets.withColumn("own", block.cast("long")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "copies", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[tuple[int, int, int]] = []

        def done(force: bool) -> Iterator[pa.RecordBatch]:
            if out and (force or len(out) > 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["rep", "links", "tie"])
                out.clear()

        for b in batches:
            for *k, side, rep, copies, grams in zip(*(b.column(c).to_pylist() for c in ("cluster", "i", "j", "side", "rep", "copies", "grams")), strict=True):
                if k != key:
                    if held:
                        out.extend(_work(held, key[1] != key[2], threshold))
                        yield from done(False)
                    key, held = k, []
                held.append((side, rep, copies, np.frombuffer(grams, np.uint64)))
        if held:
            out.extend(_work(held, key[1] != key[2], threshold))
        yield from done(True)

    return dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(frugal(run), "rep long, links long, tie long")


def jaccard_classes(docs: DataFrame, n: int = N_WORDS, threshold: tuple[int, int] = THRESHOLD, miss: float = MISS, minima: int = MINIMA) -> DataFrame:
    """``doc_id``, ``class_id`` (smallest document of its class), ``copy_id`` (smallest with its words), ``n_links``.

    ``n_links`` counts the other documents at the threshold or above, copies included.
    ``docs`` needs ``doc_id`` (unique) and ``text``.
    """
    docs = texts_of(docs)
    bands, rows = banding(threshold[0] / threshold[1], miss, minima)
    sig = staged(_signatures(docs, n, bands, rows), "signatures")
    full = sig.filter("n_grams > 0")
    copies = staged(full.groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "copies")
    reps = full.join(copies.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    bucket = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("bucket"))  # the band's number is in the hash
    shared = bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("centre")).filter("n > 1")
    shared = staged(shared, "buckets")  # so that a large bucket can be split in the join
    member = bucket.join(shared, "bucket")
    of_doc = member.filter(F.col("n") <= BUCKET).groupBy("rep").agg(F.collect_list("bucket").alias("buckets"))  # at most one per band
    sketched = of_doc.join(reps.select(F.col("doc_id").alias("rep"), "sketch"), "rep").select("rep", "sketch", F.explode("buckets").alias("bucket"))
    ties = _bucket_ties(sketched, least_equal(threshold, bands * rows))
    ties = ties.unionByName(member.filter((F.col("n") > BUCKET) & (F.col("rep") != F.col("centre"))).select(F.col("rep").alias("src"), F.col("centre").alias("dst")))
    clusters = components(ties).select(F.col("node").alias("rep"), F.col("label").alias("cluster"))
    member = clusters.join(copies.select("rep", "copies"), "rep").join(full.select(F.col("doc_id").alias("rep"), "n_grams"), "rep")
    member = staged(member, "members")
    load = member.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n_grams") / BLOCK_GRAMS)).cast("long").alias("parts"))
    wanted = member.join(load, "cluster").select("rep", "copies", "cluster", "parts")
    sets = _sets(docs.join(wanted, docs["doc_id"] == wanted["rep"]).drop("doc_id"), n)
    found = staged(_verified(sets, threshold), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("rep").alias("src"), F.col("tie").alias("dst")))
    of_copy = copies.join(links, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    of_copy = staged(of_copy.select("one", "two", "rep", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    with_copy = full.select("doc_id", "one", "two").join(of_copy, ["one", "two"])
    alone = sig.filter("n_grams = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return with_copy.select("doc_id", "class_id", F.col("rep").alias("copy_id"), "n_links").unionByName(alone)
