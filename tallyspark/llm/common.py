"""Helpers shared by the training-data operators: shared staging tables and input shaping."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import row_blocks

BATCH_BYTES = 4 << 20
_BATCH_BYTES, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only on a local master (tests, one machine) may the session name none: a temporary folder is made then, once
    per application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        made = tempfile.TemporaryDirectory(prefix="tallyspark-", ignore_cleanup_errors=True)
        atexit.register(made.cleanup)
        _own_dirs[app] = f"file://{made.name}"
    return _own_dirs[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read any more; everything made of them must be staged itself."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._staged_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of about ``BATCH_BYTES`` from now on, unless the session has a size of its own.

    A batch is held in the JVM, in the Python worker and there again as strings, by every worker of an executor.
    """
    if spark.conf.get(_BATCH_BYTES, _DEFAULT_BATCH) == _DEFAULT_BATCH:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def frugal(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """``run``, after which its Python worker gives freed memory back: workers live on from task to task."""

    def frugally(batches: Iterator[Any]) -> Iterator[Any]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return frugally


def texts_of(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``text`` (null as empty) and the columns to keep, as one struct named ``_kept``.

    Other columns are left out, so they never clash with an operator's own.
    """
    bounded_batches(docs.sparkSession)
    kept = [F.struct(*(F.col(c) for c in keep)).alias("_kept")] if keep else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *kept)


def rewritten(rows: DataFrame, by: str, rewrite: Callable[[str, Any], tuple], own: list[tuple[str, pa.DataType]], keep: tuple[str, ...]) -> DataFrame:
    """``doc_id``, what ``rewrite`` gives for the text and the column ``by``, and the kept columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, extra = b.column("text").to_pylist(), b.column(by).to_pylist()
            for lo, hi in row_blocks(texts, 4 << 20):
                got = zip(*map(rewrite, texts[lo:hi], extra[lo:hi]), strict=True)
                cols = [pa.array(c, t) for c, (_, t) in zip(got, own, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in ["doc_id", *["_kept"] * bool(keep)]), *cols], names=["doc_id", *["_kept"] * bool(keep), *(n for n, _ in own)])

    kept = f"_kept {rows.schema['_kept'].dataType.simpleString()}, " if keep else ""
    schema = "doc_id long, " + kept + ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in own)
    out = rows.mapInArrow(frugal(run), schema)
    return out.select("doc_id", *(n for n, _ in own), *(F.col("_kept")[c].alias(c) for c in keep))


def parallelism(spark: SparkSession) -> int:
    """Partitions for a keyed exchange: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
