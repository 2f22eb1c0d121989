"""Ingest verbs: facts into a store, and one event for each report, whose payload is the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import escaped
from .store import FactStore

ACTOR = "system:ingestion"


def _text(name: str, value: Column, kind: str) -> Column:
    if kind == "array<string>":
        value = F.concat(F.lit("["), F.array_join(F.transform(value, escaped), ","), F.lit("]"))
    elif kind == "string":
        value = escaped(value)
    return F.concat(F.lit(f'"{name}":'), F.coalesce(value.cast("string"), F.lit("null")))


def ingest_events(report: DataFrame, timestamp: str, actor: str = ACTOR) -> DataFrame:
    """INGEST events of reports, ready to be chained: the payload is canonical JSON of a report's columns but the tenant."""
    fields = [_text(n, F.col(n), t) for n, t in sorted(report.dtypes) if n != "tenant_id"]
    payload = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return report.select(F.struct("tenant_id", payload.alias("payload")).alias("ord"), F.lit(timestamp).alias("timestamp"), F.lit(actor).alias("actor"), F.lit("ingest").alias("type"), "tenant_id", payload.alias("payload"))


def ingest(store: FactStore, facts: DataFrame, report: DataFrame, timestamp: str, actor: str = ACTOR) -> DataFrame:
    """Take facts into the store; the events of their reports, for the log."""
    store.add(facts)
    return ingest_events(report, timestamp, actor)


def guidance_report(facts: DataFrame, skipped: DataFrame) -> DataFrame:
    """Of each release: facts ingested, and the sentences that gave none, in order."""
    took = facts.groupBy("tenant_id", F.split("source_ref", "#")[0].alias("accession")).agg(F.count(F.lit(1)).alias("ingested"))
    left = skipped.groupBy("tenant_id", "accession").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "skipped"))), lambda s: s["skipped"]).alias("skipped_tags"))
    none = F.array().cast("array<string>")
    out = took.join(left, ["tenant_id", "accession"], "full").select("tenant_id", F.concat(F.lit("guidance_8k:"), F.col("accession")).alias("source"), F.coalesce("ingested", F.lit(0)).alias("ingested"), F.coalesce("skipped_tags", none).alias("skipped_tags"))
    return out.withColumn("skipped", F.size("skipped_tags").cast("long"))
