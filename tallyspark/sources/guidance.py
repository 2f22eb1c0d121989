"""Forward guidance in prose: sentences to facts, with Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import quantity as Q

#: Verbs of guidance, and the keywords of each metric, most specific first.
VERBS = r"(?iU)\b(expects?|anticipates?|outlook|guidance|forecasts?|projects?|we see|guides?|reaffirms?|reiterates?|raises?|raising|now sees?)\b"
KEYWORDS = (
    ("eps_guidance", "currency", r"(?iU)\b(eps|earnings per share|per[- ]share)\b"),
    ("operating_margin_guidance", "percent", r"(?iU)\boperating margin|margin\b"),
    ("revenue_guidance", "currency", r"(?iU)\b(total revenue|net revenue|revenue|net sales|sales|topline)\b"),
)
_SCALE = r"(?:billion|million|thousand|trillion|bn|mm|[bmkt])?"
_MONEY = rf"\$\s?\d[\d,]*(?:\.\d+)?\s*{_SCALE}"
_SHAPES = {
    "currency": (rf"(?iU){_MONEY}\s*(?:to|through|[-–—])\s*\$?\s?\d[\d,]*(?:\.\d+)?\s*{_SCALE}", rf"(?iU){_MONEY}"),
    "percent": (r"(?iU)\d[\d,]*(?:\.\d+)?\s*%?\s*(?:to|through|[-–—])\s*\d[\d,]*(?:\.\d+)?\s*%", r"(?iU)\d[\d,]*(?:\.\d+)?\s*%"),
}


def _figure(region: Column, unit: str) -> Column:
    """A range's midpoint, else the first single figure, of the given unit."""
    span, single = _SHAPES[unit]
    r = Q.parse_range(F.regexp_extract(region, span, 0))
    q = Q.parse_quantity(F.regexp_extract(region, single, 0))
    return F.coalesce(F.when(r.isNotNull(), Q.midpoint(r)), F.when(q["unit"] == unit, q))


def guidance_facts(releases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and skipped sentences of releases: tenant_id, entity, accession, base_period, as_of, label, text."""
    s = releases.select("*", F.posexplode(F.split("text", r"(?U)(?<=[.!?])\s+")).alias("n", "raw")).withColumn("sentence", Q.strip(F.col("raw"))).filter((F.col("sentence") != "") & F.col("sentence").rlike(VERBS))
    s = s.withColumn("period", P.guidance_period(F.col("sentence"), F.coalesce("base_period", F.lit(""))))
    at = lambda pattern: F.length(F.get(F.split("sentence", pattern, 2), F.lit(0)))
    hits = F.array_sort(F.array_compact(F.array(*(F.when(F.col("sentence").rlike(p), F.struct(at(p).alias("at"), F.lit(m).alias("metric"), F.lit(u).alias("unit"))) for m, u, p in KEYWORDS))))
    s = s.withColumn("hits", hits)
    ends = F.transform("hits", lambda h, i: F.struct(h["metric"].alias("metric"), h["unit"].alias("unit"), h["at"].alias("at"), F.coalesce(F.get("hits", i + 1)["at"], F.length("sentence")).alias("end")))
    each = s.select("*", F.posexplode_outer(ends).alias("k", "h")).withColumn("region", F.expr("substring(sentence, h.at + 1, h.end - h.at)"))
    got = each.withColumn("q", F.when(F.col("h.unit") == "percent", _figure(F.col("region"), "percent")).otherwise(_figure(F.col("region"), "currency")))
    got = got.withColumn("sound", F.col("q").isNotNull() & F.col("period").isNotNull() & F.col("h").isNotNull())
    first = F.row_number().over(Window.partitionBy("tenant_id", "entity", "accession", "h.metric", "period").orderBy("n", "k"))
    kept = got.filter("sound").withColumn("first", first).filter("first = 1")
    facts = kept.select(
        F.concat(F.col("accession"), F.lit(":exhibit-99.1:"), F.concat_ws(":", "entity", "h.metric", "period")).alias("id"), "tenant_id", "entity", F.col("h.metric").alias("metric"), "period", "q.value", "q.unit", "q.quantum",
        F.lit("filing_line").alias("source_type"), F.concat(F.col("accession"), F.lit("#exhibit-99.1")).alias("source_ref"), F.coalesce("label", F.lit("Form 8-K · Exhibit 99.1 · forward guidance")).alias("source_label"), F.col("sentence").alias("source_excerpt"),
        F.lit(None).cast("string").alias("source_url"), F.coalesce("as_of", F.lit("1970-01-01")).alias("as_of"), F.lit("high").alias("confidence"), (F.col("n") * 10 + F.col("k")).cast("long").alias("ingest_seq"),
    )
    won = kept.select("accession", "n").distinct()
    skipped = s.join(won, ["accession", "n"], "left_anti").select("tenant_id", "accession", "n", F.substring("sentence", 1, 60).alias("skipped"))
    return facts, skipped
