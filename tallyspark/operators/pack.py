"""Documents and close packs: verdict counts, what may be published, the accuracy gate, highlighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rules
from .facts import SCOPE, fact_scopes
from .staging import settled
from .verify import VERDICTS, parsed, verify_parsed

DOC = ["tenant_id", "document_id"]


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(*DOC).agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))


def publishable(documents: DataFrame, verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """Documents without a blocking verdict or finding."""
    bad = verdicts.filter("is_blocking").select(*DOC).union(findings.filter("severity = 'block'").select(*DOC)).distinct().withColumn("bad", F.lit(True))
    return documents.select(*DOC).join(bad, DOC, "left").select(*DOC, F.col("bad").isNull().alias("publishable"))


def verify_documents(documents: DataFrame, claims: DataFrame, facts: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts and findings of all documents. What they all read is written once: parsed claims, scopes of facts, documents."""
    verdicts, findings, _ = _verified(documents, claims, facts, metrics)
    return verdicts, findings


def _verified(documents: DataFrame, claims: DataFrame, facts: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    read, scopes, documents = settled(parsed(claims, metrics), "claims"), settled(fact_scopes(facts), "scopes"), settled(documents, "documents")
    latest = rules.Latest(scopes.select(*SCOPE, "latest.*"))
    return verify_parsed(read, scopes, claims.columns), rules.document_findings(documents, read, latest, metrics), read


def verify_close_pack(documents: DataFrame, claims: DataFrame, facts: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Verdicts, findings, findings across documents, and for each tenant whether its pack may be published."""
    verdicts, findings, read = _verified(documents, claims, facts, metrics)
    across = rules.consistency_across(read)
    docs = publishable(documents, verdicts, findings).groupBy("tenant_id").agg(F.bool_and("publishable").alias("ok"))
    pack = docs.join(across.select("tenant_id").distinct().withColumn("bad", F.lit(True)), "tenant_id", "left").select("tenant_id", (F.col("ok") & F.col("bad").isNull()).alias("publishable"))
    return verdicts, findings, across, pack


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(F.round(part / whole, 4))


def eval_report(cases: DataFrame) -> DataFrame:
    """Accuracy of ``verdict`` against ``expected``: flagged is anything but traced; a missed flag is a false negative."""
    flagged, should = F.col("verdict") != "traced", F.col("expected") != "traced"
    n = cases.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == F.col("expected")).alias("exact"), F.count_if(flagged & should).alias("tp"), F.count_if(flagged & ~should).alias("fp"), F.count_if(~flagged & should).alias("fn"), F.count_if(~flagged & ~should).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("*", _share(F.col("exact"), F.col("total"), 1.0).alias("exact_accuracy"), _share(tp, tp + fp, 1.0).alias("flag_precision"), _share(tp, tp + fn, 1.0).alias("flag_recall"), _share(fn, tp + fn, 0.0).alias("false_negative_rate"))


def eval_passes(report: DataFrame) -> DataFrame:
    return report.select(((F.col("false_negative_rate") <= 0) & (F.col("exact_accuracy") >= 0.95) & (F.col("flag_precision") >= 0.9)).alias("passes"))


def highlights(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Spans to mark, in order; one that begins before the end of those marked so far is left out."""
    rows = claims.filter("span IS NOT NULL").select(*DOC, "claim_id", "span.start", "span.end").join(verdicts.select(*DOC, "claim_id", "verdict"), [*DOC, "claim_id"], "left")
    listed = rows.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("start", "end", "claim_id", F.coalesce("verdict", F.lit("untraced")).alias("verdict")))).alias("s"))
    item = "array<struct<start:int,end:int,claim_id:string,verdict:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(item).alias("kept"))
    step = lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(x["end"].cast("int").alias("at"), F.concat(acc["kept"], F.array(x)).cast(item).alias("kept"))).otherwise(acc)
    return listed.select(*DOC, F.explode(F.aggregate(F.col("s").cast(item), start, step, lambda acc: acc["kept"])).alias("h")).select(*DOC, "h.*")


def claims_in_order(claims: DataFrame) -> DataFrame:
    """Place of each claim in its document by span; a claim without a span counts as at the start."""
    w = Window.partitionBy(*DOC).orderBy(F.coalesce("span.start", F.lit(0)), "claim_id")
    return claims.withColumn("place", F.row_number().over(w))
