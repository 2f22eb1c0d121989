"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes are embedded; ``FILTERS`` filters of ``WIDTH`` bytes run over the whole text every ``STRIDE`` bytes. The
text is covered by chunks of two ``HALF``-byte halves, each overlapping the next by one half; every
filter is max-pooled over a chunk, the pooled values are combined by their mean and their maximum
over all chunks, and one hidden layer turns these into one probability. There is no prefix or cap:
a longer text has more chunks.

Training runs on the driver over a bounded sample of labelled texts: ``SAMPLE`` rows, half of each
label where there are enough, the smallest hashes of their ids, of texts up to ``SAMPLE_BYTES``
bytes. A fifth of the sample is kept back to set the cut: the logit is shifted so that 0.7 lies
between the labels there, and at most at the lowest two-hundredth of label 1.

Cases: null or empty text is scored as text of no bytes; null labels teach nothing, and a document labelled
twice takes its largest label; without rows of both labels every score is 0.5. Equal texts
have equal scores. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal
from .textblocks import row_blocks

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 4, 8, 2, 24, 16
HALF = 256
SAMPLE = 3200
SAMPLE_BYTES = 20_000
EPOCHS = 16
BATCH = 48
CUT = 0.7
_ROWS = HALF // STRIDE


def halves(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded by zeros to whole halves, with room for a filter before and behind; halves of each.

    What a filter sees beyond a text's halves is the zeros before the next text.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = (size + 2 * WIDTH + HALF - 1) // HALF
    buffer = np.zeros(int(n.sum()) * HALF + WIDTH, np.uint8)
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        buffer[at + WIDTH : at + WIDTH + len(t)] = np.frombuffer(t, np.uint8)
        at += k * HALF
    return buffer, n


@dataclass
class ByteNet:
    p: dict[str, np.ndarray]
    shift: float = 0.0

    @staticmethod
    def new(seed: int = 11) -> ByteNet:
        r = np.random.Generator(np.random.PCG64(seed))
        f = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        return ByteNet({"embed": f(256, EMBED, k=0.5), "filter": f(WIDTH * EMBED, FILTERS, k=0.25), "bias": np.zeros(FILTERS, np.float32), "w1": f(2 * FILTERS, HIDDEN, k=0.2), "b1": np.zeros(HIDDEN, np.float32), "w2": f(HIDDEN, 1, k=0.3), "b2": np.zeros(1, np.float32)})

    def pooled(self, buffer: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maximum of each filter over each half, and its row if asked for."""
        p = self.p
        count = (len(buffer) - WIDTH) // HALF
        out = np.empty((count, FILTERS), np.float32)
        rows = np.empty((count, FILTERS), np.int64) if where else None
        for lo in range(0, count, 512):
            hi = min(count, lo + 512)
            seen = buffer[lo * HALF : hi * HALF + WIDTH]
            if hi - lo < 512 and not where:  # products of one shape, so that a text's score doesn't hang on its neighbours
                seen = np.concatenate([seen, np.zeros((512 - hi + lo) * HALF, np.uint8)])
            x = p["embed"][seen]
            view = np.lib.stride_tricks.as_strided(x, ((len(seen) - WIDTH) // STRIDE, WIDTH * EMBED), (x.strides[0] * STRIDE, x.strides[1]))
            y = (np.ascontiguousarray(view) @ p["filter"]).reshape(-1, _ROWS, FILTERS)[: hi - lo]
            if where:
                rows[lo:hi] = y.argmax(axis=1)
                out[lo:hi] = np.take_along_axis(y, rows[lo:hi][:, None, :], axis=1)[:, 0]
            else:
                out[lo:hi] = y.max(axis=1)
        return np.maximum(out + p["bias"], 0), rows

    def features(self, pool: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mean and maximum over chunks, and which half gave each chunk its value."""
        last = np.cumsum(n) - 1
        chunk = pool.copy()
        second = np.zeros(pool.shape, bool)
        inner = np.ones(len(pool), bool)
        inner[last] = False
        i = np.flatnonzero(inner)
        second[i] = pool[i + 1] > pool[i]
        chunk[i] = np.maximum(pool[i], pool[i + 1])
        keep = inner | np.repeat(n == 1, n)  # the last half alone is no chunk unless the text has no other
        start = np.cumsum(n) - n
        kept = np.maximum(n - 1, 1)
        mean = np.add.reduceat(np.where(keep[:, None], chunk, 0), start, axis=0) / kept[:, None]
        most = np.maximum.reduceat(chunk, start, axis=0)
        return np.concatenate([mean, most], axis=1).astype(np.float32), chunk, second, keep

    def logits(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        buffer, n = halves(texts)
        x, *_ = self.features(self.pooled(buffer)[0], n)
        h = np.maximum((x[:, :, None] * self.p["w1"]).sum(axis=1) + self.p["b1"], 0)
        return (h * self.p["w2"][:, 0]).sum(axis=1).astype(np.float64) + float(self.p["b2"][0]) + self.shift

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))

    def gradient(self, texts: list[bytes], label: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        buffer, n = halves(texts)
        pool, rows = self.pooled(buffer, True)
        x, chunk, second, keep = self.features(pool, n)
        z = x @ p["w1"] + p["b1"]
        h = np.maximum(z, 0)
        out = (h @ p["w2"] + p["b2"])[:, 0]
        d = ((1 / (1 + np.exp(-out)) - label) / len(label)).astype(np.float32)[:, None]
        g = {"w2": h.T @ d, "b2": d.sum(axis=0)}
        dh = (d @ p["w2"].T) * (z > 0)
        g["w1"], g["b1"] = x.T @ dh, dh.sum(axis=0)
        dx = dh @ p["w1"].T
        start = np.cumsum(n) - n
        dc = np.repeat(dx[:, :FILTERS] / np.maximum(n - 1, 1)[:, None], n, axis=0) * keep[:, None]
        top = np.repeat(x[:, FILTERS:], n, axis=0)
        tie = chunk == top
        tie = tie & (np.cumsum(tie, axis=0) - np.repeat(np.cumsum(tie, axis=0)[start] - tie[start], n, axis=0) == 1)
        dc += np.repeat(dx[:, FILTERS:], n, axis=0) * tie
        dp = np.where(second, 0, dc)
        dp[1:] += np.where(second[:-1], dc[:-1], 0)
        dp *= pool > 0
        g["bias"] = dp.sum(axis=0)
        i, f = np.nonzero(dp)
        at = i * HALF + rows[i, f] * STRIDE
        seen = buffer[at[:, None] + np.arange(WIDTH)]  # bytes under the filter where it was largest
        v = dp[i, f]
        part = p["embed"][seen].reshape(len(i), WIDTH * EMBED) * v[:, None]
        g["filter"] = np.stack([np.bincount(f, part[:, k], FILTERS) for k in range(WIDTH * EMBED)]).astype(np.float32)
        back = (p["filter"].T[f] * v[:, None]).reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(seen.ravel(), back[:, k], 256) for k in range(EMBED)], axis=1).astype(np.float32)
        return g

    def train(self, texts: list[bytes], label: np.ndarray, epochs: int = EPOCHS, rate: float = 4e-3, seed: int = 5) -> None:
        """Adam over shuffled batches; both labels weigh the same if the sample has as many."""
        r = np.random.Generator(np.random.PCG64(seed))
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for e in range(epochs):
            order = r.permutation(len(texts))
            for lo in range(0, len(texts), BATCH):
                take = order[lo : lo + BATCH]
                g = self.gradient([texts[i] for i in take], label[take])
                step += 1
                lr = rate * (1 - 0.8 * e / epochs)
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ByteNet | None:
    """Network from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``quality``)."""
    known = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = whole.filter(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id").join(known, "doc_id").withColumn("draw", F.xxhash64("doc_id"))
    # Ids are drawn first: each task sends its lowest ones to the driver, and texts are fetched for those drawn alone.
    drawn = [r for q in (0, 1) for r in rows.filter(F.col("quality") == q).orderBy("draw", "doc_id").limit(sample // 2).collect()]
    if len({r["quality"] for r in drawn}) < 2:
        return None
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in drawn], docs.select("doc_id").schema).distinct()  # at most ``sample`` rows
    fetched = {r["doc_id"]: r["text"] for r in whole.join(F.broadcast(chosen), "doc_id", "left_semi").collect()}
    got = [{"text": fetched[r["doc_id"]], "quality": r["quality"]} for r in drawn]
    label = np.array([r["quality"] for r in got], np.float32)
    texts = [r["text"].encode() for r in got]
    aside = np.arange(len(got)) % 5 == 4
    net = ByteNet.new()
    net.train([t for t, x in zip(texts, aside, strict=True) if not x], label[~aside])
    held = aside if len(set(label[aside].tolist())) == 2 else ~aside
    z = net.logits([t for t, x in zip(texts, held, strict=True) if x])
    low, high = np.quantile(z[label[held] == 1], 0.005), np.quantile(z[label[held] == 0], 0.99)
    net.shift = float(np.log(CUT / (1 - CUT)) - min(low, (low + high) / 2))
    return net


def score(docs: DataFrame, net: ByteNet | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of each whole text."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    if net is None:
        return kept.select(*keep, F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").to_pylist()
            for lo, hi in row_blocks(texts):
                s = net.scores([t.encode() for t in texts[lo:hi]])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in keep), pa.array(s)], names=[*keep, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes if c != "_text")
    return kept.mapInArrow(frugal(run), f"{schema}, score double")
