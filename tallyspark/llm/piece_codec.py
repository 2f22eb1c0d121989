"""Encoding and decoding with a merge-type piece vocabulary through a prefix table.

Method: ``merge_table`` holds, for each prefix of a text, the unique piece that ends the prefix's
encoding, found from automaton matches and pair-compatibility tests; the ids are recovered backwards.

No piece of the vocabulary holds a space behind another character, and none holds a line feed, so
prefixes never interact across the start of a run of spaces or a line feed; both facts are checked
when the model is loaded (the split is not made where they don't hold). The table is therefore kept
once for each distinct stretch of a block between such points.

Cases: null text counts as empty; an empty text has the begin and end ids only and decodes to
an empty text. Characters outside the vocabulary become byte pieces. A literal U+2581 counts as
a space, as in the format itself. Repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal, texts_of
from .merge_table import TABLE_CHARS, Distinct, MergeTable
from .textblocks import SEP, Block, piece_hashes, row_blocks, spread

SPACE_MARK = "▁"
SCHEMA = "doc_id long, ids binary, decoded string"
_codecs: dict[str, "PieceCodec"] = {}


class PieceCodec:
    """A vocabulary with merge priorities, its prefix table and the bytes of each id."""

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        pieces = {p.replace(SPACE_MARK, " "): i for i, p in enumerate(names) if not special[i]}
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.byte_ids = {int(p[1:-1], 16): i for i, p in enumerate(names) if sp.is_byte(i)}
        byte_of = {i: b for b, i in self.byte_ids.items()}
        raw = [bytes([byte_of[i]]) if i in byte_of else b"" if special[i] else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)]
        self.raw_lens = np.fromiter(map(len, raw), np.int64, n)
        self.raw_flat = np.frombuffer(b"".join(raw), np.uint8)
        self.split_spaces = not any(" " in p.lstrip(" ") for p in pieces)
        self.split_lines = not any("\n" in p for p in pieces)
        self.distinct = Distinct()
        self.table = MergeTable(pieces, {p: -sp.get_score(i) for p, i in pieces.items()})

    def stretches(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the stretches whose encodings don't depend on each other; False for separators."""
        cp = block.cp
        cut = cp == SEP
        cut[1:] |= cut[:-1].copy()
        cut[0] = True
        if self.split_spaces:
            space = cp == 32
            cut[1:] |= space[1:] & ~space[:-1]
        if self.split_lines:
            line = cp == 10
            cut |= line
            cut[1:] |= line[:-1]
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(cp)), cp[starts] != SEP

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, flat, and where each text's ids end."""
        starts, ends, real = self.stretches(block)
        hashes = piece_hashes(block.cp, starts)
        starts, ends, hashes = starts[real], ends[real], hashes[real]
        flat, counts, which = self.distinct.encode(block.cp, starts, ends, hashes, lambda at: self.encode_stretches(block.cp, starts[at], ends[at]))
        ids, stops = spread(flat, counts, which)
        return ids, np.append(0, stops)[np.searchsorted(starts, block.stop, "left")]

    def encode_stretches(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts; characters outside the vocabulary as bytes."""
        flat, counts = self.table.encode(cp, starts, ends)
        if (flat < 0).any():
            as_bytes = [np.array([self.byte_ids[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")]) for x in flat[flat < 0].tolist()]
            width = np.ones(len(flat), np.int64)
            width[flat < 0] = [len(x) for x in as_bytes]
            counts = np.diff(np.append(0, np.cumsum(width))[np.append(0, np.cumsum(counts))])
            flat = np.repeat(flat, width)
            flat[flat < 0] = np.concatenate(as_bytes)
        return flat, counts


def codec(model_path: str) -> PieceCodec:
    """The model of this path, loaded once in each worker."""
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


def encode_texts(c: PieceCodec, texts: list[str]) -> Iterator[tuple[bytes, str]]:
    """Ids with begin and end as little-endian 32-bit integers, and the text decoded from the ids."""
    bos, eos = (np.array([x], "<u4").tobytes() for x in (c.bos, c.eos))
    for lo, hi in row_blocks(texts, TABLE_CHARS):
        block = Block([" " + t.replace(SPACE_MARK, " ") if t else "" for t in texts[lo:hi]])
        ids, ends = c.encode_block(block)
        raw, raw_stops = spread(c.raw_flat, c.raw_lens, ids)  # decoded from the ids alone
        at = raw_at = 0
        for to, raw_to in zip(ends.tolist(), np.append(0, raw_stops)[ends].tolist(), strict=True):
            yield bos + ids[at:to].tobytes() + eos, raw[raw_at:raw_to].tobytes().removeprefix(b" ").decode("utf-8", "replace")
            at, raw_at = to, raw_to


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit, begin and end included) and ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in row_blocks(texts, 4 << 20):
                got = list(encode_texts(c, texts[lo:hi]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.string())], names=["doc_id", "ids", "decoded"])

    return texts_of(docs).mapInArrow(frugal(run), SCHEMA)
