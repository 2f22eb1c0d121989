"""Corpus pipeline: quality, repeated lines, near duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)``, with ``docs`` the rows that the stage before it left, and all but
the last return the columns of ``documents``; ``n_chars`` follows the text. A document whose text
is cut away whole stays as a row with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import jaccard_join, line_dedup, packing, quality_cnn, substring_dedup
from tallyspark.llm.common import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_KEPT = ("lang", "source")


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    net = quality_cnn.fit(docs, labels)
    if net is None:
        return docs.select(*COLUMNS)
    return quality_cnn.score(docs.withColumn("whole", F.col("text")), net, ("doc_id", "whole", "lang", "source", "n_chars")).filter(F.col("score") >= quality_cnn.CUT).select("doc_id", F.col("whole").alias("text"), "lang", "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go."""
    return _documents(line_dedup.line_dedup(docs, keep=_KEPT, min_words=line_dedup.MIN_WORDS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class stays."""
    first = jaccard_join.jaccard_classes(docs).filter("doc_id = class_id").select("doc_id")
    return docs.select(*COLUMNS).join(first, "doc_id", "left_semi")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated runs of words go."""
    return _documents(substring_dedup.substring_dedup(docs, keep=_KEPT))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in the training sequences."""
    import public_tokenizers

    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    digest = staged(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.place_pieces(spark, digest).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("substring dedup", passages), ("best-fit packing", pack)]

#: The classifier's scores and the tokenizer's ids can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
