"""Tables that several plans read: written once, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master that names none, a temporary one of the application."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        made = tempfile.TemporaryDirectory(prefix="tallyspark-facts-", ignore_cleanup_errors=True)
        atexit.register(made.cleanup)
        _own[app] = f"file://{made.name}"
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop)
    return path


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` written once as Parquet and read back: its lineage is cut, lost executors don't lose it, and what reads it takes the columns and rows that it needs."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
