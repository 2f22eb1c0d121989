"""Filed facts: simplified filing instances, reported-fact feeds, filing indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import quantity as Q
from ..operators.facts import restatements, within_lookback
from .vocabulary import tags_table

#: Units of a reported-fact feed that are read.
KNOWN_UNITS = ("USD", "USD/shares", "USD/share", "shares", "pure")
SOURCE_TYPES = ("edgar_xbrl", "filing_line", "management_input", "internal_close")
INSTANCE = (
    "accession string, entity string, facts array<struct<tag:string,metric:string,entity:string,period:string,value:string,unit:string,decimals:int,"
    "source_type:string,source_ref:string,label:string,excerpt:string,source_url:string,as_of:string,confidence:string>>"
)
FEED = "cik long, entityName string, facts struct<`us-gaap`:map<string,struct<label:string,units:map<string,array<struct<start:string,end:string,val:string,accn:string,form:string,filed:string,frame:string>>>>>>"


def _report(df: DataFrame, source: Column, distinct: bool) -> DataFrame:
    tags = F.array_sort(F.collect_set("skipped")) if distinct else F.array_sort(F.collect_list("skipped"))
    return df.groupBy("tenant_id", source.alias("source")).agg(F.count_if(F.col("skipped").isNull()).alias("ingested"), F.count("skipped").alias("skipped"), tags.alias("skipped_tags"))


def instance_facts(instances: DataFrame, metrics: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """Facts of simplified instances and a report for each accession. What maps to no metric is reported, never guessed."""
    raw = instances.select(F.coalesce("accession", F.lit("unknown")).alias("accession"), F.coalesce("entity", F.lit("unknown")).alias("issuer"), F.posexplode("facts").alias("i", "f"))
    tags = tags_table(metrics).select("tag", F.col("metric").alias("by_tag"))
    rows = raw.withColumn("tag", F.col("f.tag")).join(tags, "tag", "left").withColumn("metric", F.coalesce("f.metric", "by_tag"))
    known = metrics.select(F.col("id").alias("metric"), F.col("unit").alias("m_unit"))
    rows = rows.join(known, "metric", "left").withColumn("tenant_id", F.lit(tenant)).withColumn("skipped", F.when(F.col("m_unit").isNull(), F.coalesce("tag", F.lit("<no-tag>"))))
    kind = F.coalesce("f.source_type", F.lit("edgar_xbrl"))
    entity = F.coalesce("f.entity", "issuer")
    facts = rows.filter("skipped IS NULL").select(
        F.concat_ws(":", "accession", entity, "metric", "f.period", F.coalesce("f.as_of", F.col("i").cast("string"))).alias("id"), "tenant_id", entity.alias("entity"), "metric", F.col("f.period").alias("period"),
        F.col("f.value").try_cast(Q.DEC).alias("value"), F.col("m_unit").alias("unit"), Q.quantum_of_decimals(F.col("f.decimals")).alias("quantum"),
        F.when(kind.isin(*SOURCE_TYPES), kind).otherwise(F.raise_error(F.concat(F.lit("unknown source type: "), kind))).alias("source_type"),
        F.coalesce("f.source_ref", F.when(F.col("tag").isNotNull(), F.concat_ws("#", "accession", "tag")), F.lit("none")).alias("source_ref"),
        F.coalesce("f.label", F.lit("")).alias("source_label"), F.coalesce("f.excerpt", F.lit("")).alias("source_excerpt"), F.col("f.source_url").alias("source_url"),
        F.coalesce("f.as_of", F.lit("1970-01-01")).alias("as_of"), F.coalesce("f.confidence", F.lit("high")).alias("confidence"), F.col("i").cast("long").alias("ingest_seq"),
    )
    return facts, _report(rows, F.concat(F.lit("edgar_xbrl:"), F.col("accession")), distinct=False)


def filing_url(cik: Column, accession: Column) -> Column:
    """Index page of a filing; null unless the accession has its canonical shape."""
    base = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), accession, F.lit("-index.htm"))
    return F.when(accession.rlike(r"^\d{10}-\d{2}-\d{6}$"), base)


def feed_facts(feeds: DataFrame, metrics: DataFrame, tenant: str, quarters: int = 12) -> tuple[DataFrame, DataFrame]:
    """Facts of reported-fact feeds (one company a row): restatements as versions, within a lookback of quarters, each company's own."""
    concept = feeds.select(F.coalesce("cik", F.lit(0)).alias("cik"), F.coalesce("entityName", F.col("cik").cast("string")).alias("entity"), F.explode("facts.us-gaap").alias("concept", "c"))
    return unit_facts(concept.select("cik", "entity", "concept", F.col("c.label").alias("label"), F.explode("c.units").alias("u", "occ")), metrics, tenant, quarters)


def unit_facts(units: DataFrame, metrics: DataFrame, tenant: str, quarters: int = 12) -> tuple[DataFrame, DataFrame]:
    """``feed_facts`` of a row for each unit of each concept: cik, entity, concept, label, u, occ (the occurrences)."""
    unit = units.withColumn("tag", F.concat(F.lit("us-gaap:"), F.col("concept"))).join(tags_table(metrics).withColumnRenamed("unit", "m_unit"), "tag", "left")
    skip = F.when(F.col("metric").isNull(), F.col("concept")).when(~F.col("u").isin(*KNOWN_UNITS), F.concat(F.col("concept"), F.lit("["), F.col("u"), F.lit("]")))
    unit = unit.withColumn("skipped", skip)
    occ = unit.filter("skipped IS NULL").select("cik", "entity", "metric", "m_unit", "tag", "label", F.posexplode("occ").alias("i", "o"))
    occ = occ.withColumn("period", P.occurrence_period(F.col("o.frame"), F.col("o.start"), F.col("o.end"))).withColumn("value", F.col("o.val").try_cast(Q.DEC)).filter("value IS NOT NULL AND period IS NOT NULL")
    occ = occ.select("cik", "entity", "metric", "m_unit", "tag", "label", "period", "value", "i", F.coalesce("o.filed", F.lit("")).alias("filed"), F.coalesce("o.accn", F.lit("")).alias("accn"))
    kept = restatements(within_lookback(occ, quarters, ("cik", "entity")), ["cik", "entity", "metric", "period"], ["filed", "accn", "tag", "i"])
    seq = F.row_number().over(Window.partitionBy("entity").orderBy("metric", "period", "filed", "accn", "tag", "i"))  # one company's kept versions
    facts = kept.withColumn("k", seq).select(
        F.concat(F.concat_ws(":", "accn", "entity", "metric", "period"), F.lit(":v"), F.col("k").cast("string")).alias("id"), F.lit(tenant).alias("tenant_id"), "entity", "metric", "period", "value", F.col("m_unit").alias("unit"),
        F.lit(0).cast(Q.DEC).alias("quantum"), F.lit("edgar_xbrl").alias("source_type"), F.concat_ws("#", "accn", "tag").alias("source_ref"), F.coalesce("label", F.lit("")).alias("source_label"), F.lit("").alias("source_excerpt"),
        filing_url(F.col("cik"), F.col("accn")).alias("source_url"), F.col("filed").alias("as_of"), F.lit("high").alias("confidence"), F.col("k").cast("long").alias("ingest_seq"),
    )
    skipped = unit.filter("skipped IS NOT NULL").groupBy("entity").agg(F.array_sort(F.collect_set("skipped")).alias("skipped_tags"))
    report = facts.groupBy("entity").agg(F.count(F.lit(1)).alias("ingested")).join(skipped, "entity", "full_outer").select(F.lit(tenant).alias("tenant_id"), "entity", F.coalesce("ingested", F.lit(0)).alias("ingested"), F.coalesce("skipped_tags", F.array().cast("array<string>")).alias("skipped_tags"))
    return facts, report


def filing_rows(submissions: DataFrame) -> DataFrame:
    """Filings of an index with parallel arrays, bare or under ``filings.recent``; a missing array counts as empty strings."""
    if "filings" in submissions.columns:
        submissions = submissions.select("issuer", "filings.recent.*")
    keys = ("accessionNumber", "filingDate", "reportDate", "items", "form")
    have = set(submissions.columns)
    cols = [(F.col(k) if k in have else F.array().cast("array<string>")).alias(k) for k in keys]
    z = submissions.select("issuer", *cols).select("issuer", F.posexplode(F.arrays_zip(*keys)).alias("i", "z"))
    return z.select("issuer", "i", *(F.coalesce(F.col("z")[k], F.lit("")).alias(k) for k in keys))


def earnings_filings(filings: DataFrame) -> DataFrame:
    return filings.filter((F.col("form") == "8-K") & F.array_contains(F.transform(F.split("items", ","), lambda x: F.trim(x)), "2.02"))


def issuer_label(tickers: Column, name: Column) -> Column:
    return F.coalesce(F.get(tickers, F.lit(0)), name, F.lit("unknown"))


def cik_of(tickers: DataFrame, wanted: DataFrame) -> DataFrame:
    """CIK of each wanted ``ticker``, whatever its case; the job stops on one that isn't there."""
    known = tickers.select(F.upper("ticker").alias("t"), F.col("cik_str").alias("cik"))
    return wanted.join(known, F.upper("ticker") == F.col("t"), "left").select("ticker", F.when(F.col("cik").isNotNull(), F.col("cik")).otherwise(F.raise_error(F.concat(F.lit("unknown ticker: "), F.col("ticker")))).alias("cik"))
