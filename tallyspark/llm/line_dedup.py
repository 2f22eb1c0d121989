"""Removal of repeated runs of lines, by prefix doubling over sequences of line ids.

Lines are the parts between line feeds that hold a word (anything but space and tab to carriage
return); other lines are never counted or removed. A run is ``min_lines`` such lines in a row of one
document. A line is removed if it lies in a run that also begins earlier: in a document of smaller
id, or further up in the same one. The first copy of everything stays. With ``min_words``, shorter
runs count too: those of at least so many words, and those that are all the lines of their document.

The suffix array is built as far as removal needs it: a suffix's name after k lines is made of the
names at its start and k/2 lines on (a hash of line ids at first), and suffixes whose name is
unique drop out of the later rounds. At depth ``min_lines`` equal names are the intervals of longest
common prefix ``min_lines`` or more; the union of their later members' runs is what longer maximal
runs would give. Shorter runs are read off at their own length on the way there. Names are compared as
pairs of 64-bit hashes at the length read off (one line: as one hash).

Cases: null text counts as empty. Equal rows: the document of the smallest id stays whole. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, rewritten, staged, texts_of
from .textblocks import SEP, Block, piece_hashes, row_blocks, words

MIN_LINES = 3
MIN_WORDS = 5  # of a shorter run, as many as a shingle of the Jaccard join


def line_ids(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of each line with a word: text, place among those of its text, 64-bit id, words, and lines of the text."""
    block = Block(texts)
    ends = np.flatnonzero((block.cp == 10) | (block.cp == SEP))
    starts = np.append(0, ends[:-1] + 1)
    at, _, _ = words(block)
    count = np.diff(np.searchsorted(at, np.append(starts, len(block.cp))))
    full = np.flatnonzero(count)
    # A line's end cell is skipped, so that a text's last line has the id of an equal line elsewhere.
    ids = piece_hashes(block.cp, starts, (block.cp == 10) | (block.cp == SEP)) if len(starts) else np.zeros(0, np.uint64)
    doc = block.doc_of(starts[full])
    lines = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(full)) - (np.cumsum(lines) - lines)[doc]
    return doc, place, ids[full].view(np.int64), count[full], lines[doc]


def _ids(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id``, ``at`` (place among the document's lines with words), ``name`` (id of the line), ``words`` and ``of`` (lines of the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, names = b.column("text").to_pylist(), b.column("doc_id").to_numpy()
            for lo, hi in row_blocks(texts):
                doc, *rest = line_ids(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(names[lo:hi][doc]), *map(pa.array, (rest[0].astype(np.int32), rest[1], rest[2].astype(np.int32), rest[3].astype(np.int32)))], names=["doc_id", "at", "name", "words", "of"])

    return docs.mapInArrow(frugal(run), "doc_id long, at int, name long, words int, of int").filter(F.col("of") >= least)


def _shared(names: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose name another row has too."""
    often = staged(names.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").drop("_n"), "often")  # so that a common name's rows can be split in the join
    return names.join(often, keys, "left_semi")


def _pairs(names: DataFrame, step: int) -> DataFrame:
    """Each suffix with its name and the name ``step`` lines on, where both are still in play."""
    ahead = F.first(F.struct("name", "upto")).over(Window.partitionBy("doc_id").orderBy("at").rangeBetween(step, step))
    return names.withColumn("ahead", ahead).filter("ahead IS NOT NULL").select("doc_id", "at", F.col("name").alias("left"), F.col("ahead.name").alias("right"), "before", "ahead.upto", "of")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """Starts of runs that also begin earlier: ``doc_id``, ``at``, ``n`` (lines of the run)."""
    names = _shared(staged(_ids(docs, min_lines if min_words is None else 1), "ids"), ["name"])
    # Words before and up to the end of a run; lines that are gone are in no repeated run, so their words cancel out.
    upto = F.sum("words").over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    names = staged(names.withColumn("upto", upto).select("doc_id", "at", "name", (F.col("upto") - F.col("words")).alias("before"), "upto", "of"), "lines")
    depth, found = 1, []
    for n in range(min_lines if min_words is None else 1, min_lines + 1):
        while 2 * depth < n:
            pairs = _pairs(names, depth).withColumn("name", F.xxhash64("left", "right")).drop("left", "right")
            names = staged(_shared(pairs, ["name"]), "lines")
            depth *= 2
        runs = staged(_pairs(names, n - depth), "lines") if n > 1 else names.withColumn("left", F.col("name")).withColumnRenamed("name", "right")
        first = runs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "at")).alias("one")).filter("n >= 2").drop("n")
        first = staged(first, "first")
        counted = runs if n == min_lines else runs.filter((F.col("upto") - F.col("before") >= min_words) | (F.col("of") == n))
        found.append(counted.join(first, ["left", "right"]).filter(F.struct("doc_id", "at") != F.col("one")).select("doc_id", "at", F.lit(n).alias("n")))
    return reduce(DataFrame.unionByName, found)


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, keep: tuple[str, ...] = (), min_words: int | None = None) -> DataFrame:
    """``doc_id``, ``n_lines`` (with words), ``n_removed``, the cleaned ``text`` and the ``keep`` columns.

    ``docs`` needs ``doc_id`` (unique) and ``text``.
    """
    starts = repeated_runs(texts_of(docs), min_lines, min_words).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("_starts"))  # at most min_lines per line of the document
    own = [("n_lines", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]

    def cut(text: str, starts: list[dict] | None) -> tuple:
        lines = text.split("\n")
        real = [i for i, x in enumerate(lines) if x.encode().split()]
        gone = {real[k] for s in starts or () for k in range(s["at"], s["at"] + s["n"])}
        return len(real), len(gone), "\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text

    return rewritten(texts_of(docs, keep).join(starts, "doc_id", "left"), "_starts", cut, own, keep)
