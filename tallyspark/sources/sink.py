"""Release texts as files of their own: ``<entity>-<period, else accession, else unknown>.txt`` in one folder.

A Spark data source with a writer: each task writes its files beside the folder's, under a name of its own attempt, and tells the driver which;
when all tasks have ended they are moved to their names, and what a failed task or a failed job has written is deleted.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, f"_job-{uuid.uuid4().hex}"

    def _path(self, *parts: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri("/".join((self.folder, *parts)))

    def write(self, iterator: Iterator[Row]) -> Written:
        attempt, names = uuid.uuid4().hex, []
        for row in iterator:
            store, path = self._path(self.job, attempt)
            store.create_dir(path)
            with store.open_output_stream(f"{path}/{row['name']}", compression=None) as out:
                out.write((row["text"] or "").encode())
            names.append(row["name"])
        return Written(attempt, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = self._path()
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.type == fs.FileType.File and f.path.endswith(".txt"):
                    store.delete_file(f.path)
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{folder}/{self.job}/{m.attempt}/{name}", f"{folder}/{name}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        store, path = self._path(self.job)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


class ReleaseFiles(DataSource):
    """Format ``release_files``: rows of name and text, option ``folder`` (a URI that executors share)."""

    @classmethod
    def name(cls) -> str:
        return "release_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["folder"].rstrip("/"), overwrite)


def release_names(releases: DataFrame) -> DataFrame:
    """``name`` and ``text`` of releases (entity, period, accession, text), one row a name: of several for one quarter, the one with the latest accession."""
    label = F.concat_ws("-", F.coalesce("entity", F.lit("unknown")), F.coalesce("period", "accession", F.lit("unknown")))
    named = releases.withColumn("name", F.concat(F.regexp_replace(label, r"[/\\\x00]", "_"), F.lit(".txt")))
    return named.groupBy("name").agg(F.max_by("text", F.struct(F.coalesce("accession", F.lit("")), "text")).alias("text"))


def write_release_files(releases: DataFrame, folder: str, overwrite: bool = False) -> None:
    spark = releases.sparkSession
    spark.dataSource.register(ReleaseFiles)
    uri = folder if re.match(r"[a-z0-9]+:", folder) else f"file://{folder}"
    release_names(releases).write.format("release_files").mode("overwrite" if overwrite else "append").option("folder", uri).save()


def release_lines(report: DataFrame, releases: DataFrame) -> DataFrame:
    """The fetch report of each issuer as lines: ``issuer``, ``line_no``, ``line``.

    ``report`` has issuer, source, requested, fetched and missing; ``releases`` issuer, nth, period, title, url, n_figures, n_chars and warnings.
    """
    of = lambda r: F.concat(F.array(F.concat(F.lit("  "), F.rpad(F.coalesce(r["period"], F.lit("?")), 10, " "), F.lit(" "), F.rpad(F.substring(r["title"], 1, 58), 58, " "), F.lit(" figures "), F.lpad(r["n_figures"].cast("string"), 4, " "), F.lit("  chars "), F.lpad(r["n_chars"].cast("string"), 7, " ")), F.concat(F.repeat(F.lit(" "), F.lit(13)), r["url"])), F.transform(r["warnings"], lambda w: F.concat(F.repeat(F.lit(" "), F.lit(13)), F.lit("warning: "), w)))
    listed = releases.groupBy("issuer").agg(F.array_sort(F.collect_list(F.struct("nth", "period", "title", "url", "n_figures", "n_chars", "warnings"))).alias("r"))
    head = F.array(F.concat(F.lit("Fetched "), F.col("fetched").cast("string"), F.lit("/"), F.col("requested").cast("string"), F.lit(" quarterly releases via "), F.col("source")))
    body = F.coalesce(F.flatten(F.transform("r", of)), F.array().cast("array<string>"))
    lines = F.concat(head, body, F.transform("missing", lambda m: F.concat(F.lit("  MISSING    "), m)))
    return report.join(listed, "issuer", "left").select("issuer", F.posexplode(lines).alias("line_no", "line"))
