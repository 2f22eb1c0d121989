"""Nearest neighbours by inner product with randomly rotated one-bit codes.

1. Cells: a k-means fit on at most ``SAMPLE_BYTES`` of vectors gives at most ``MAX_CELLS`` centres. Every
   vector is indexed in the cell of its nearest centre.
2. Codes: the vector's residual from its centre is rotated by a fixed random rotation. Its code is the
   sign of each component, packed into 64-bit words, with two scalars: the residual's norm and the
   correction, the inner product of its direction with its code's direction.
3. Estimates: a query is rotated and quantised to ``PLANES`` bits a component; its inner product with a
   code is a sum of population counts of words. Divided by the correction, times the norm, and
   with the query's product with the centre, it estimates the inner product. The error bound is
   ``WIDTH`` standard deviations of the rotation's error, and the query's rounding in full.
4. Choice: a query first meets a block of its own cell; its k-th best score there is a floor under
   the final one, and what was found there is kept. Then it meets the other blocks of every cell whose best possible score (product with the
   centre plus norm times the cell's radius) reaches the floor. Block by block only vectors whose upper bound
   reaches the best floor so far are reranked with the original vectors, in double precision.

Every row is indexed, no cell or block is capped, and a large cell is dealt into blocks. So only the
error bounds can lose a neighbour, each with probability 0.0014 at most (and less the farther it is above the floor).
Where vectors have no cells to speak of, all queries meet all blocks, and codes save the reranking alone.

Cases: vectors that are null, empty, zero or hold a null, NaN or infinite component take no part; shorter
vectors count as padded with zeros; ties go to the smaller id; a query is not its own neighbour; with
fewer candidates than k all are returned. Extra columns are ignored. Rows of one id are vectors and
queries of their own, but none is a neighbour of its own id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, staged

WIDTH = 3.0
PLANES = 8
QUERY_BLOCK = 1024
BLOCK_BYTES = 16 << 20
LEAST_BLOCK = 1024
CELLS_AT_ONCE = 1 << 17
LIKELY = 16
SAMPLE_BYTES = 8 << 20
MAX_CELLS = 256
RESULT = "query_row long, query_id long, vec_id long, score double"


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(7)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """k-means from the first rows of a sample in random order."""
    at = sample[:cells].copy()
    for _ in range(rounds):
        home = np.argmax(sample @ at.T - (at**2).sum(axis=1) / 2, axis=1)
        total = np.zeros_like(at)
        np.add.at(total, home, sample)
        n = np.bincount(home, minlength=len(at))
        at[n > 0] = total[n > 0] / n[n > 0, None]
    return at


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    out = np.packbits(bits, axis=1)
    return np.pad(out, ((0, 0), (0, -out.shape[1] % 8))).view(np.uint64)


def encode(residual: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norms and corrections; a residual of zero has norm 0 and correction 1."""
    scale = np.abs(residual).max(axis=1, keepdims=True, initial=0)
    unit = residual / np.where(scale > 0, scale, 1)
    length = np.linalg.norm(unit, axis=1)
    unit = unit / np.where(length > 0, length, 1)[:, None] @ turn
    correction = np.abs(unit).sum(axis=1) / math.sqrt(residual.shape[1])
    return packed(unit >= 0), length * scale[:, 0], np.where(length > 0, correction, 1)


@dataclass
class Quantised:
    """Rotated queries in ``PLANES`` bits a component: planes, smallest component, step, sum of components, norm."""

    planes: list[np.ndarray]
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, queries: np.ndarray, turn: np.ndarray) -> Quantised:
        q = queries @ turn
        low = q.min(axis=1)
        step = (q.max(axis=1) - low) / (2**PLANES - 1)
        level = np.rint((q - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.uint16)
        return cls([packed(level >> j & 1 > 0) for j in range(PLANES)], low, step, q.sum(axis=1), np.linalg.norm(queries, axis=1))

    def products(self, codes: np.ndarray, dim: int) -> np.ndarray:
        """Estimated inner products of the queries with the directions of the codes."""
        level = np.zeros((len(self.low), len(codes)), np.uint16 if dim < 256 else np.uint32)
        both, count = np.empty(level.shape, np.uint64), np.empty(level.shape, np.uint8)
        for plane in reversed(self.planes):
            level <<= 1
            for w in range(codes.shape[1]):
                np.bitwise_and(plane[:, w, None], codes[None, :, w], out=both)
                level += np.bitwise_count(both, out=count)
        ones = np.bitwise_count(codes).sum(axis=1)
        return (2 * (self.low[:, None] * ones[None, :] + self.step[:, None] * level) - self.total[:, None]) / math.sqrt(dim)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component by component: the measure itself."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def search_block(qid: np.ndarray, queries: np.ndarray, floor: np.ndarray, cid: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norm: np.ndarray, correction: np.ndarray, centre: np.ndarray, k: int, turn: np.ndarray, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a cell's block for each query, of those that reach its floor: query and candidate places, scores.

    ``seen``, if given, gets the number of pairs met, of those reranked and, where it has a third place, of the products taken for floors.
    """
    dim = queries.shape[1]
    gain = norm / correction
    spread = np.sqrt(np.maximum(1 - correction**2, 0)) / math.sqrt(max(dim - 1, 1)) * WIDTH
    best: list[tuple[np.ndarray, ...]] = []
    some = max(1, CELLS_AT_ONCE // max(1, len(cid)))
    for lo in range(0, len(qid), some):
        x, least = queries[lo : lo + some], floor[lo : lo + some]
        asked = Quantised.of(x, turn)
        est = (x @ centre)[:, None] + asked.products(codes, dim) * gain
        own = qid[lo : lo + some, None] == cid[None, :]
        est[own] = -np.inf
        take = min(LIKELY * k, len(cid))
        if take >= k:  # the k-th best of those that look best is a floor, known exactly
            likely = np.argpartition(est, len(cid) - take, axis=1)[:, len(cid) - take :]
            value = np.stack([vectors[js] @ v for v, js in zip(x, likely, strict=True)])
            value[np.take_along_axis(own, likely, axis=1)] = -np.inf
            least = np.maximum(least, np.partition(value, take - k, axis=1)[:, take - k])
        least = least - 1e-9 * np.abs(least)  # products summed in another order differ in the last digits
        est += (asked.norm[:, None] * spread + (math.sqrt(dim) * asked.step)[:, None]) * gain
        choice = (est >= least[:, None]) & ~own
        # A quick product first; what may reach the floor gets the measure itself.
        near = []
        for v, row, enough in zip(x, choice, least, strict=True):
            js = np.flatnonzero(row)
            near.append(js[vectors[js] @ v >= enough])
        if seen is not None:
            seen[0] += est.size
            seen[1] += int(choice.sum())
            seen[2:] = [seen[2] + (len(x) * take if take >= k else 0)] if len(seen) > 2 else []
        q, c = np.repeat(np.arange(len(x)), [len(js) for js in near]), np.concatenate(near)
        score = in_order(x[q], vectors[c])
        by = np.lexsort((cid[c], -score, q))
        q, c, score = q[by], c[by], score[by]
        first = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        best.append((q[first] + lo, c[first], score[first]))
    return tuple(map(np.concatenate, zip(*best, strict=True)))


def _search(pieces: DataFrame, at: np.ndarray, k: int, dim: int) -> DataFrame:
    """Best scores within each piece, of rows with ``cell``, ``lane``, ``q`` and ``side`` (0 for queries); a piece is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            side, ids, rows = (t.column(c).to_numpy() for c in ("side", "vec_id", "row"))
            a, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(c):
                return
            x = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(-1, dim)
            codes = np.frombuffer(b"".join(t.column("code").take(pa.array(c)).to_pylist()), np.uint64).reshape(len(c), -1)
            floor, norm, correction = (t.column(n).to_numpy() for n in ("floor", "norm", "correction"))
            for lo in range(0, len(a), QUERY_BLOCK):
                some = a[lo : lo + QUERY_BLOCK]
                q, n, score = search_block(ids[some], x[some], floor[some], ids[c], x[c], codes, norm[c], correction[c], at[key[0]], k, turn)
                yield pa.RecordBatch.from_arrays([pa.array(rows[some][q]), pa.array(ids[some][q]), pa.array(ids[c][n]), pa.array(score)], names=["query_row", "query_id", "vec_id", "score"])

        for b in batches:
            where = np.stack([b.column(c).to_numpy() for c in ("cell", "lane", "q")])
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    if tuple(where[:, lo]) != key and held:
                        yield from done()
                        held = []
                    key = tuple(where[:, lo])
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from done()

    return pieces.repartition("cell", "lane", "q").sortWithinPartitions("cell", "lane", "q").mapInArrow(frugal(run), RESULT)


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: k nearest of each row that ``is_query`` (a Column) holds for."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    valid = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    count, widest = valid.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    dim = widest or 1
    block = max(LEAST_BLOCK, BLOCK_BYTES // (8 * dim))
    rows = lambda column: np.array([[*v, *[0.0] * (dim - len(v))] for v in column.to_pylist()], float).reshape(-1, dim)
    cells = max(1, min(MAX_CELLS, -(-count // block)))
    sample = rows(valid.orderBy(F.xxhash64("vec_id")).limit(max(cells, SAMPLE_BYTES // (8 * dim))).select("embedding").toArrow().column(0)) if cells > 1 else np.zeros((1, dim))
    at = centres(sample, cells)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        for b in batches:
            if b.num_rows:
                x = rows(b.column("embedding"))
                cell = np.argmax(x @ at.T - (at**2).sum(axis=1) / 2, axis=1)
                codes, norm, correction = encode(x - at[cell], turn)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("asks"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(correction), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "asks", "cell", "code", "norm", "correction", "vector"])

    indexed = valid.mapInArrow(frugal(index), "vec_id long, asks boolean, cell int, code binary, norm double, correction double, vector binary")
    indexed = staged(indexed.withColumn("row", F.monotonically_increasing_id()), "index")
    sizes = {r["cell"]: r for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("radius")).collect()}  # at most MAX_CELLS rows
    lanes = [-(-sizes[c]["n"] // block) if c in sizes else 0 for c in range(cells)]
    radius = np.array([sizes[c]["radius"] if c in sizes else -np.inf for c in range(cells)])
    asking = indexed.filter("asks").count()
    turns = max(1, -(-asking // QUERY_BLOCK))
    of_cell = F.get(F.array(*map(F.lit, lanes)), F.col("cell"))
    lot = lambda seed, n: F.pmod(F.xxhash64("row", F.lit(seed)), n).cast("int")
    columns = ("cell", "lane", "q", "side", "row", "vec_id", "vector", "code", "norm", "correction", "floor")
    nothing = F.lit(float("-inf")).alias("floor")
    holds = indexed.withColumn("lane", lot(1, of_cell)).withColumn("side", F.lit(1)).withColumn("floor", nothing)
    home = indexed.filter("asks").withColumn("lane", lot(2, of_cell)).withColumn("side", F.lit(0)).withColumn("floor", nothing)
    first = staged(_search(holds.unionByName(home).withColumn("q", F.lit(0)).select(*columns), at, k, dim), "first")
    floors = first.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("reached"))  # at most k rows a query
    met = indexed.filter("asks").withColumn("met_cell", F.col("cell")).withColumn("met_lane", lot(2, of_cell))
    asks = met.join(floors, F.col("row") == F.col("query_row"), "left").withColumn("floor", F.coalesce("reached", nothing))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("vector").to_pylist()), np.float64).reshape(-1, dim)
            length = np.linalg.norm(x, axis=1)[:, None]
            most = x @ at.T + length * radius[None, :] * (1 + 1e-9) + 1e-9 * length
            found = (most >= b.column("floor").to_numpy()[:, None]) & np.isfinite(radius)  # a cell may be empty
            cuts = np.append(0, np.cumsum(found.sum(axis=1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.nonzero(found)[1].astype(np.int32)))], names=[*b.schema.names, "cells"])

    kept = "row long, vec_id long, vector binary, code binary, norm double, correction double, floor double, met_cell int, met_lane int"
    asks = staged(asks.select(*(c.split()[0] for c in kept.split(", "))).mapInArrow(frugal(reach), f"{kept}, cells array<int>"), "asks")
    asks = asks.withColumn("cell", F.explode("cells")).withColumn("lane", F.explode(F.sequence(F.lit(0), of_cell - 1))).withColumn("side", F.lit(0)).withColumn("q", lot(3, F.lit(turns)))
    asks = asks.filter((F.col("cell") != F.col("met_cell")) | (F.col("lane") != F.col("met_lane")))  # what the block at home holds is known
    holds = holds.join(asks.select("cell", "lane", "q").distinct(), ["cell", "lane"])  # a block goes to the turns that reach it
    best = _search(asks.select(*columns).unionByName(holds.select(*columns)), at, k, dim).unionByName(first)
    rank = F.row_number().over(Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
