"""JSON payloads as they come, as VARIANT: feeds with names that nobody listed, filing instances, labelled cases. What doesn't parse is kept apart.

``payloads`` have file, pos (in a file of lines), raw text and ``v``, null where the text is no JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filings import INSTANCE

OCCURRENCES = "array<struct<start:string,end:string,val:string,accn:string,form:string,filed:string,frame:string>>"
CASE = ("id", "entity", "metric", "period", "text", "expected")


def read_payloads(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """One payload a file, or one a line."""
    rows = spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).filter("trim(raw) <> ''")
    return rows.withColumn("v", F.try_parse_json("raw"))


def corrupt(payloads: DataFrame) -> DataFrame:
    """Payloads that are no JSON, or no object."""
    return payloads.filter(F.col("v").isNull() | (~F.schema_of_variant("v").startswith("OBJECT"))).select("file", "raw")


def _sql(df: DataFrame, text: str) -> DataFrame:
    return df.sparkSession.sql(text, p=df)


def feed_units(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units of every concept of feeds, as ``filings.unit_facts`` takes them: cik, entity, concept, label, u, occ; and what has another shape: file, concept, u.

    Concepts and units are taken by the names they have in the payload. No schema says which there may be.
    """
    rows = _sql(payloads, """
        SELECT file, coalesce(try_variant_get(v, '$.cik', 'long'), 0) AS cik, coalesce(try_variant_get(v, '$.entityName', 'string'), try_variant_get(v, '$.cik', 'string'), '0') AS entity,
               c.key AS concept, try_variant_get(c.value, '$.label', 'string') AS label, u.key AS u, u.value AS listed
        FROM {p} AS p, LATERAL variant_explode(try_variant_get(v, '$.facts.us-gaap', 'variant')) AS c, LATERAL variant_explode_outer(try_variant_get(c.value, '$.units', 'variant')) AS u
        WHERE v IS NOT NULL""")
    rows = rows.withColumn("occ", F.try_variant_get("listed", "$", OCCURRENCES))
    return rows.filter("occ IS NOT NULL").drop("file", "listed"), rows.filter("occ IS NULL").select("file", "concept", "u")


def instances(payloads: DataFrame) -> DataFrame:
    """Simplified filing instances, as ``filings.instance_facts`` takes them."""
    kind = f"struct<{INSTANCE.replace(' string', ':string').replace(' array', ':array').replace(', ', ',')}>"
    return payloads.withColumn("i", F.try_variant_get("v", "$", kind)).filter("i.facts IS NOT NULL").select("i.*")


def golden_cases(payloads: DataFrame) -> DataFrame:
    """Labelled cases of golden sets: the set's name, tenant and filing, and each case with its place in the set."""
    fields = ", ".join(f"try_variant_get(c.value, '$.{x}', 'string') AS {x}" for x in CASE)
    return _sql(payloads, f"""
        SELECT file, try_variant_get(v, '$.name', 'string') AS name, try_variant_get(v, '$.tenant', 'string') AS tenant_id, try_variant_get(v, '$.filing_fixture', 'string') AS filing, c.pos AS pos, {fields}
        FROM {{p}} AS p, LATERAL variant_explode(try_variant_get(v, '$.cases', 'variant')) AS c WHERE v IS NOT NULL""")


def case_claims(cases: DataFrame) -> DataFrame:
    """Cases as claims to verify, with what is ``expected`` of each."""
    span = F.struct((F.col("pos") * 2).alias("start"), (F.col("pos") * 2 + 1).alias("end"))
    return cases.select(F.col("id").alias("claim_id"), "tenant_id", F.concat(F.lit("eval-"), F.col("name")).alias("document_id"), "entity", "metric", "period", F.col("text").alias("displayed_text"), span.alias("span"), F.lit("high").alias("detect_confidence"), "expected")
