"""Best-fit packing of token sequences by bin completion.

Documents become ids with an end id; only those longer than the capacity are cut, into full pieces
with the shorter one first. What is packed is then the count of pieces of each length, at most
``capacity`` numbers whatever the corpus, and the search runs on the driver over these counts:

* best-fit decreasing gives the incumbent; the sum of lengths, and of pieces over half with what of the
  smaller ones can't go beside them, gives the bound;
* bin completion takes the longest piece left and enumerates the fillings of the rest of its sequence,
  of the largest pieces first, whose waste is within an allowance. Which sums the pieces left can
  make is kept as bits, so the enumeration has no dead ends, and no cap: it goes on as far as the search asks;
* a filling is dominated, and left out, if another piece fits too, or if some of its pieces could be exchanged
  for a single longer one that is left and fits, or for one as long as several together;
* a branch is cut when the waste it has spent exceeds what a solution better than the incumbent could afford.
  A filling is used as often as the counts allow, then less often;
* allowances are tried from none to many: without any, small pieces are used up early; with a large one, they
  are kept for last. Each has its share of ``node_limit`` nodes. The search ends as soon as the bound is reached, which proves
  the result; else with the limit, and ``sequences`` and ``least_sequences`` show the gap.

Pieces get a number within their length by salted ranks (no length is sorted in one task), and the
plan, a few thousand rows at most, turns numbers into places.

Cases: null or empty text is the end id alone, one piece. Equal documents are packed each by
itself. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import model
from .common import frugal, parallelism, staged, texts_of
from .textblocks import row_blocks

CAPACITY = 1024
#: Waste that a sequence may have above the least, in the order in which the search tries it.
ALLOWANCES = (0, 10, 1, 6, 2, 16, 4, 30)
NODE_LIMIT = 16_000
Plan = list[tuple[tuple[int, ...], int]]
PIECES = "doc_id long, piece int, start long, length long, ids binary"
PLAN = "length long, lo long, hi long, each long, first_sequence long, first_offset long"


def token_pieces(docs: DataFrame, vocab_path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: its number, the document's ids before it, its length and its ids (LE 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(vocab_path)
        end = np.array([end_id], "<u4")
        for b in batches:
            texts, names = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for lo, hi in row_blocks(texts, 4 << 20):
                out: list[tuple] = []
                for doc, ids in zip(names[lo:hi], m.encode(texts[lo:hi]), strict=True):
                    ids = np.append(ids, end)
                    at, to = 0, len(ids) % capacity or min(len(ids), capacity)
                    k = 0
                    while at < len(ids):
                        out.append((doc, k, at, to - at, ids[at:to].tobytes()))
                        at, to, k = to, to + capacity, k + 1
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return texts_of(docs).mapInArrow(frugal(run), PIECES)


def best_fit_plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: fillings and how often each is used."""
    left = counts.copy()
    plan = []
    while left.any():
        fill, room = [], capacity
        use = left.copy()
        while room:
            fits = np.flatnonzero(use[: room + 1])
            if not len(fits):
                break
            fill.append(int(fits[-1]))
            use[fits[-1]] -= 1
            room -= int(fits[-1])
        plan.append(_apply(left, fill))
    return plan


def _apply(left: np.ndarray, fill: list[int]) -> tuple[tuple[int, ...], int]:
    """Use a filling as often as the counts allow."""
    sizes, each = np.unique(fill, return_counts=True)
    times = int((left[sizes] // each).min())
    left[sizes] -= each * times
    return tuple(fill), times


def sums(left: np.ndarray, lengths: list[int], room: int) -> list[int]:
    """For each place in ``lengths`` the sums up to ``room`` that the pieces from there on can make, as bits."""
    out, reach, mask = [1], 1, (1 << room + 1) - 1
    for size in reversed(lengths):
        times, step = min(int(left[size]), room // size), 1
        while times > 0:
            step = min(step, times)
            reach |= reach << size * step & mask
            times, step = times - step, step * 2
        out.append(reach)
    return out[::-1]


def _of_sum(left: np.ndarray, lengths: list[int], reach: list[int], total: int, at: int = 0) -> Iterator[list[int]]:
    """All fillings of one sum, largest pieces first."""
    if not total:
        yield []
        return
    for i in range(at, len(lengths)):
        if not reach[i] >> total & 1:
            return
        size = lengths[i]
        for k in range(min(int(left[size]), total // size), 0, -1):
            if reach[i + 1] >> total - k * size & 1:
                for rest in _of_sum(left, lengths, reach, total - k * size, i + 1):
                    yield [size] * k + rest


def dominated(fill: list[int], left: np.ndarray, waste: int) -> bool:
    """Whether one that is left could be added to a filling, or exchanged for pieces of it: longer and fitting, or as long as several."""
    some, several = 0, 0  # sums of any pieces, and of two or more, as bits
    for size in fill:
        several |= (several | some) << size
        some |= some << size | 1 << size
    free = left > 0
    for size in set(fill):
        free[size] = left[size] > fill.count(size)
    bits = int.from_bytes(np.packbits(free, bitorder="little").tobytes(), "little")
    return bool(bits & several or waste and bits & _above(some | 1, waste))


def _above(some: int, waste: int) -> int:
    """Bits 1 to ``waste`` above each bit."""
    reach, width = some << 1, 1
    while width < waste:
        step = min(width, waste - width)
        reach, width = reach | reach << step, width + step
    return reach


def fillings(left: np.ndarray, capacity: int, allowance: int) -> Iterator[list[int]]:
    """Undominated fillings around the longest piece whose waste is at most ``allowance`` above the least, largest pieces first."""
    longest = int(np.flatnonzero(left)[-1])
    rest = left.copy()
    rest[longest] -= 1
    room = capacity - longest
    lengths = np.flatnonzero(rest[: room + 1])[::-1].tolist()
    reach = sums(rest, lengths, room)
    best = reach[0].bit_length() - 1
    each = (_of_sum(rest, lengths, reach, total) for total in range(best, max(best - allowance, 0) - 1, -1) if reach[0] >> total & 1)
    for fill in heapq.merge(*each, reverse=True):
        if not dominated(fill, rest, room - sum(fill)):
            yield [longest, *fill]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: for each small length, pieces over half and what of those between can't go beside them."""
    size = np.arange(len(counts))
    best = -(-int((counts * size).sum()) // capacity)
    for small in range(capacity // 2 + 1):
        alone, beside = counts[capacity - small + 1 :].sum(), slice(capacity // 2 + 1, capacity - small + 1)
        free = int(counts[beside].sum()) * capacity - int((counts * size)[beside].sum())
        over = int((counts * size)[small : capacity // 2 + 1].sum()) - free
        best = max(best, int(alone + counts[beside].sum()) + max(0, -(-over // capacity)))
    return best


def _complete(counts: np.ndarray, capacity: int, incumbent: Plan, node_limit: int) -> Plan:
    """The best plan that branch-and-bound finds, the incumbent if there is no better one."""
    total = int((counts * np.arange(len(counts))).sum())
    bound, best = lower_bound(counts, capacity), sum(t for _, t in incumbent)

    def branches(left: np.ndarray, allowance: int) -> Iterator[tuple[list[int], int]]:
        for fill in fillings(left, capacity, allowance):
            sizes, each = np.unique(fill, return_counts=True)
            for times in range(int((left[sizes] // each).min()), 0, -1):
                yield fill, times

    for allowance in ALLOWANCES:
        # A level: the counts left there, sequences used, waste spent, and the branches still to try.
        stack = [(counts, 0, 0, branches(counts, allowance))] if counts.any() else []
        trail: Plan = []
        nodes = 0
        while stack and best > bound and nodes < node_limit // len(ALLOWANCES):
            left, used, waste, more = stack[-1]
            del trail[len(stack) - 1 :]
            step = next(more, None)
            if step is None:
                stack.pop()
                continue
            nodes += 1
            fill, times = step
            waste += times * (capacity - sum(fill))
            if waste > (best - 1) * capacity - total:
                continue
            left = left.copy()
            sizes, each = np.unique(fill, return_counts=True)
            left[sizes] -= each * times
            trail.append((tuple(fill), times))
            if left.any():
                stack.append((left, used + times, waste, branches(left, allowance)))
            elif used + times < best:
                best, incumbent = used + times, list(trail)
    return incumbent


def pack_counts(counts: np.ndarray, capacity: int = CAPACITY, node_limit: int = NODE_LIMIT) -> tuple[Plan, int]:
    """Fillings and how often each is used, over ``counts[length]`` pieces, and the least number of sequences possible."""
    counts = counts.astype(np.int64)
    bound = lower_bound(counts, capacity)
    plan = _complete(counts, capacity, best_fit_plan(counts, capacity), node_limit)
    return plan, bound


def place_pieces(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id``, ``piece`` and ``length``; other columns stay.

    ``sequences`` (used in all) and ``least_sequences`` (no packing has fewer) are the same in every row.

    ``pieces`` is read three times, so pass a staged table.
    """
    lanes = parallelism(spark)
    laned = pieces.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lanes)))
    per_lane = laned.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("n"))
    before = per_lane.select("length", "lane", (F.sum("n").over(Window.partitionBy("length").orderBy("lane")) - F.col("n")).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    rows, taken, sequence = [], np.zeros(capacity + 1, np.int64), 0
    packed, least = pack_counts(counts, capacity)
    for fill, times in packed:
        offset = 0
        for size in sorted(set(fill), reverse=True):
            each = fill.count(size)
            rows.append((size, int(taken[size]), int(taken[size]) + each * times, each, sequence, offset))
            taken[size] += each * times
            offset += each * size
        sequence += times
    plan = spark.createDataFrame(rows, PLAN)
    number = F.row_number().over(Window.partitionBy("length", "lane").orderBy("doc_id", "piece")) - 1
    numbered = laned.withColumn("_n", number).join(before, ["length", "lane"]).withColumn("_n", F.col("_n") + F.col("before"))
    placed = numbered.join(F.broadcast(plan), (numbered["length"] == plan["length"]) & (F.col("_n") >= F.col("lo")) & (F.col("_n") < F.col("hi")))
    q = F.col("_n") - F.col("lo")
    kept = [numbered[c] for c in pieces.columns]
    return placed.select(*kept, (F.col("first_sequence") + F.floor(q / F.col("each"))).cast("long").alias("sequence_id"), (F.col("first_offset") + F.pmod(q, F.col("each")) * numbered["length"]).cast("long").alias("offset"), F.lit(sequence).cast("long").alias("sequences"), F.lit(least).cast("long").alias("least_sequences"))


def pack_documents(docs: DataFrame, vocab_path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their ids and places: cut, packed and ready to be written by ``sequence_id``."""
    return place_pieces(docs.sparkSession, staged(token_pieces(docs, vocab_path, end_id, capacity), "pieces"), capacity)
