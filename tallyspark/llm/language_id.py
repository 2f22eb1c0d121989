"""Language identification by multilingual mixture inference.

Model: for each language the smoothed likelihood of character trigrams (lower case, words padded by
one space, hashed to ``BUCKETS``), counted over all training texts. A word's likelihood under
a language is the product over its letters' trigrams. A document is a mixture: every word comes from one
language, and expectation-maximisation estimates the proportions. The language set is selected by
penalised likelihood, log-likelihood less ``PENALTY`` * size * log(words): from the best single language, the
language whose addition or removal gains most is added or removed, with the proportions re-estimated, until
nothing gains. The predicted language has the largest proportion in the set; the score is that proportion.

The model has ``BUCKETS`` numbers for each language, and languages are a closed list of labels, so it
is small whatever the corpus; training counts are summed by Spark.

Cases: a null text or one without letters is ``und`` with score 0; rows with null text or language
teach nothing; with no training rows everything is ``und``; ties go to the language first in
alphabetical order. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal
from .textblocks import LETTER, Block, char_classes, mix64, row_blocks

BUCKETS = 1 << 14
SMOOTHING = 0.5
ROUNDS = 8
PENALTY = 1.0
UNKNOWN = "und"


def letter_trigrams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, starts of words among the letters, document of each word."""
    cp = block.cp
    letter = char_classes()[cp] == LETTER
    cell = np.where(letter, cp, np.uint32(32)).astype(np.uint64)
    at = np.flatnonzero(letter)
    if not len(at):
        return at, at, at
    left = np.where(at > 0, cell[at - 1], np.uint64(32))
    bucket = mix64((left << np.uint64(42)) | (cell[at] << np.uint64(21)) | cell[at + 1]) & np.uint64(BUCKETS - 1)
    start = np.flatnonzero(np.append(True, np.diff(at) > 1))
    return bucket.astype(np.int64), start, block.doc_of(at[start])


def estimate(like: np.ndarray, count: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document after so many rounds of expectation-maximisation, and its log-likelihood.

    ``like`` has a row for each word, ``count`` words belong to each document in turn.
    """
    first = np.cumsum(count) - count
    for _ in range(rounds):
        part = like * np.repeat(share, count, axis=0)
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, first, axis=0) / count[:, None]
    return share, np.add.reduceat(np.log((like * np.repeat(share, count, axis=0)).sum(axis=1)), first)


@dataclass
class LanguageModel:
    languages: list[str]
    log_likelihood: np.ndarray  # BUCKETS x languages

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[str]]:
        """Language, score and the selected set (comma-separated, largest first) of each text."""
        names, scores, sets = [UNKNOWN] * len(texts), np.zeros(len(texts)), [""] * len(texts)
        if not self.languages:
            return names, scores, sets
        block = Block([t.lower() for t in texts])
        bucket, start, doc = letter_trigrams(block)
        if not len(start):
            return names, scores, sets
        score = np.add.reduceat(self.log_likelihood[bucket], start, axis=0)
        top = score.max(axis=1, keepdims=True)
        like = np.maximum(np.exp(score - top), 1e-30)
        filled, first, count = np.unique(doc, return_index=True, return_counts=True)

        n = len(self.languages)
        share, _ = estimate(like, count, np.full((len(filled), n), 1 / n), ROUNDS)
        # One language: no proportions to estimate.
        value = np.add.reduceat(np.log(like), first, axis=0) - PENALTY * np.log(count + 1)[:, None]
        chosen = np.arange(n) == value.argmax(axis=1)[:, None]
        best, best_value = chosen.astype(float), value.max(axis=1)
        active = np.arange(len(filled))
        while len(active):
            mine = np.repeat(np.isin(np.arange(len(filled)), active, assume_unique=True), count)
            gained = np.zeros(len(active), bool)
            before, own, own_count = chosen[active], like[mine], count[active]
            for j in range(n):
                trial = before ^ (np.arange(n) == j)
                start = np.where(trial, np.maximum(share[active], 1e-6), 0)
                empty = ~trial.any(axis=1)
                start[empty] = 1 / n
                got, seen = estimate(own, own_count, start / start.sum(axis=1, keepdims=True), ROUNDS // 2)
                value = seen - PENALTY * trial.sum(axis=1) * np.log(own_count + 1)
                better = ~empty & (value > best_value[active] + 1e-9)
                at = active[better]
                chosen[at], best[at], best_value[at] = trial[better], got[better], value[better]
                gained |= better
            active = active[gained]
        size = chosen.sum(axis=1)
        pick = best.argmax(axis=1)
        rank = np.argsort(-best, axis=1, kind="stable")
        for i, d in enumerate(filled.tolist()):
            names[d] = self.languages[pick[i]]
            sets[d] = ",".join(self.languages[j] for j in rank[i, : size[i]])
        scores[filled] = np.clip(best[np.arange(len(filled)), pick], 0, 1)
        return names, scores, sets


def fit(docs: DataFrame) -> LanguageModel:
    """Model from all rows of ``docs`` with ``text`` and ``lang``."""
    bounded_batches(docs.sparkSession)
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for lo, hi in row_blocks(texts):
                bucket, start, doc = letter_trigrams(Block([t.lower() for t in texts[lo:hi]]))
                if not len(start):
                    continue
                of = np.repeat(doc, np.diff(start, append=len(bucket)))
                listed = sorted(set(langs[lo:hi]))
                index = {x: i for i, x in enumerate(listed)}
                code = np.array([index[x] for x in langs[lo:hi]])[of]
                got = np.bincount(code * BUCKETS + bucket, minlength=len(listed) * BUCKETS).reshape(len(listed), BUCKETS)
                for x, row in zip(listed, got, strict=True):
                    total[x] = total[x] + row if x in total else row
        for x, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(frugal(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    table = np.zeros((BUCKETS, len(languages)))
    if languages:
        index = {x: i for i, x in enumerate(languages)}
        table[found.column("bucket").to_numpy(), [index[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    total = table.sum(axis=0, keepdims=True)
    return LanguageModel(languages, np.log((table + SMOOTHING) / (total + SMOOTHING * BUCKETS)).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``languages`` (the selected set) of each whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in row_blocks(texts, 1 << 19):
                names, scores, sets = model.predict(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(scores), pa.array(sets, pa.string())], names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(frugal(run), "doc_id long, lang_pred string, score double, languages string")
