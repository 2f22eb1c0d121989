"""The fact store: versions, restatements, scopes, predicates and coverage.

A fact is one value of (tenant, entity, metric, period) as of a date. Later values are new versions;
ties on the date go to the later ``ingest_seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import period_rank

FACTS = (
    "id string, tenant_id string, entity string, metric string, period string, value decimal(28,6), unit string, quantum decimal(28,6), "
    "source_type string, source_ref string, source_label string, source_excerpt string, source_url string, as_of string, confidence string, ingest_seq long"
)
SCOPE = ["tenant_id", "entity", "metric", "period"]
#: Source types that count as filed.
FILED = ("edgar_xbrl", "filing_line")
_VERSION = ("as_of", "ingest_seq", "value", "unit", "quantum", "source_type", "source_ref", "source_label", "source_excerpt", "source_url")


def is_filed(source_type: Column, ref: Column) -> Column:
    return source_type.isin(*FILED) & (ref != "none")


def of_tenant(df: DataFrame, tenant: str | None) -> DataFrame:
    return df if tenant is None else df.filter(F.col("tenant_id") == tenant)


def latest_facts(facts: DataFrame) -> DataFrame:
    """The last version of each scope; a partial aggregate, so common scopes don't meet in one task."""
    kept = [c for c in facts.columns if c not in SCOPE]
    return facts.groupBy(*SCOPE).agg(F.max_by(F.struct(*kept), F.struct("as_of", "ingest_seq")).alias("v")).select(*SCOPE, "v.*")


def fact_scopes(facts: DataFrame) -> DataFrame:
    """One row per scope with its ``latest`` version and the value and unit of each ``older`` one that was filed, oldest first."""
    filed = F.when(is_filed(F.col("source_type"), F.col("source_ref")), F.struct("as_of", "ingest_seq", "value", "unit"))
    both = facts.groupBy(*SCOPE).agg(F.max(F.struct(*_VERSION)).alias("latest"), F.array_sort(F.collect_list(filed)).alias("filed"))
    last = F.struct(*(F.col("latest")[c].alias(c) for c in ("as_of", "ingest_seq", "value", "unit")))
    return both.select(*SCOPE, "latest", F.filter("filed", lambda v: v != last).alias("older"))


def restatements(values: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows whose value differs from the one before it in the group: A, B, A are three versions."""
    w = Window.partitionBy(*group).orderBy(*order)
    return values.withColumn("_before", F.lag("value").over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("value"))).drop("_before")


def within_lookback(values: DataFrame, quarters: int, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Rows whose period lies in the last ``quarters`` up to the newest period of their company (all its metrics)."""
    newest = values.groupBy(*by).agg(F.max(period_rank(F.col("period"))).alias("_newest"))
    return values.join(newest, list(by)).filter(period_rank(F.col("period")) > F.col("_newest") - quarters).select(*values.columns)


def coverage(facts: DataFrame, shown: int = 6) -> DataFrame:
    """Periods of each tenant, entity and metric: how many, and the last few with the count of earlier ones."""
    each = facts.groupBy("tenant_id", "entity", "metric").agg(F.array_sort(F.collect_set("period")).alias("periods"))
    n = F.size("periods")
    last = F.array_join(F.when(n > shown, F.slice("periods", -shown, shown)).otherwise(F.col("periods")), ", ")
    return each.select("tenant_id", "entity", "metric", n.cast("long").alias("n_periods"), F.when(n > shown, F.concat(last, F.lit(" (+"), (n - shown).cast("string"), F.lit(" earlier)"))).otherwise(last).alias("shown"))


def default_entity(facts: DataFrame) -> DataFrame:
    """First ingested entity of each tenant that is no segment; else the tenant's name in capitals."""
    whole = F.when(~F.contains("entity", F.lit(":")), F.col("entity"))
    return facts.groupBy("tenant_id").agg(F.coalesce(F.min_by(whole, F.when(whole.isNotNull(), F.col("ingest_seq"))), F.upper("tenant_id")).alias("entity"))


def add_facts(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store with new facts; the job stops if an id is there already or comes twice, and nothing is added then."""
    every = store.select("id").unionByName(new.select("id")).groupBy("id").count().filter("count > 1")
    if (twice := every.first()) is not None:
        raise ValueError(f"duplicate fact id: {twice['id']}")
    return store.unionByName(new.select(*store.columns))


def fact_by_id(facts: DataFrame, fact_id: str) -> DataFrame:
    return facts.filter(F.col("id") == fact_id)


def facts_by_ids(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Each of the ``ids`` with its fact as one struct, null where there is none."""
    known = facts.select("id", F.struct(*facts.columns).alias("fact"))
    return ids.select("id").distinct().join(known, "id", "left")


def reported_metrics(facts: DataFrame) -> DataFrame:
    """Metrics that each entity has facts for."""
    return facts.groupBy("tenant_id", "entity").agg(F.array_sort(F.collect_set("metric")).alias("metrics"))


def segment_keywords(facts: DataFrame) -> DataFrame:
    """Keywords of each tenant's segments with their entity, in order of first ingestion (the last entity of a keyword counts)."""
    part = F.lower(F.regexp_extract("entity", r"^[^:]*:(.*)$", 1))
    seg = facts.filter(F.contains("entity", F.lit(":"))).select("tenant_id", part.alias("keyword"), "entity", "ingest_seq")
    return seg.groupBy("tenant_id", "keyword").agg(F.max_by("entity", "ingest_seq").alias("entity"), F.min("ingest_seq").alias("first_seq"))
