"""Verdicts: every claim is bound to stored facts, or recomputed from them, in one pass of joins.

``claims`` have claim_id, tenant_id, document_id, entity, metric, period, displayed_text, detect_confidence
and span (start, end); ``metrics`` is the vocabulary's table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import quantity as Q
from .facts import SCOPE, fact_scopes, is_filed

VERDICTS = ("traced", "needs_review", "conflict", "untraced")
IDENTITY = ("ratio", "ratio_pct", "sum")
GROWTH = ("yoy_growth", "qoq_growth", "delta_bps")


def parsed(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """Claims with their quantity ``q``, range ``r`` and metric's ``spec``: worked out once for all that follows."""
    spec = metrics.select(F.col("id").alias("metric"), F.struct(*metrics.columns).alias("spec"))
    return claims.join(spec, "metric", "left").withColumn("q", Q.parse_quantity(F.col("displayed_text"))).withColumn("r", Q.parse_range(F.col("displayed_text")))


def operands(claims: DataFrame) -> DataFrame:
    """One row per fact that a derived claim is computed from: claim_id, role, ord, and its scope. Takes parsed claims."""
    s, p = F.col("spec"), F.col("period")
    op = lambda role, i, metric, period: F.struct(F.lit(role).alias("role"), F.lit(i).alias("ord"), metric.alias("metric"), period.alias("period"))
    prior = F.when(s["kind"] == "qoq_growth", P.prior_quarter(p)).otherwise(P.prior_year(p))
    pair = F.array(op("a", 0, s["base"], p), op("b", 1, s["base"], prior))
    ratio = F.array(op("a", 0, s["numerator"], p), op("b", 1, s["denominator"], p))
    total = F.transform(s["components"], lambda m, i: F.struct(F.lit("s").alias("role"), i.alias("ord"), m.alias("metric"), p.alias("period")))
    year = F.array(*(op("s", i, s["base"], P.prior_quarter(p, i)) for i in range(4)))
    need = F.when(s["kind"].isin(*GROWTH), pair).when(s["kind"].isin("ratio", "ratio_pct"), ratio).when((s["kind"] == "sum") & (F.size(s["components"]) > 0), total).when(s["kind"] == "ttm_sum", year)
    each = claims.filter(s["kind"].isNotNull()).select("claim_id", "tenant_id", "document_id", "entity", F.size(need).alias("n"), F.explode(need).alias("o"))
    return each.select("claim_id", "tenant_id", "document_id", "entity", "n", "o.*")


def resolved(need: DataFrame, latest: DataFrame) -> DataFrame:
    """Operands gathered from the latest facts: one row per claim, without those that miss one."""
    got = need.join(latest.select(*SCOPE, "value", "source_type", "source_ref", "source_url", "as_of"), SCOPE)
    by_role = lambda r: F.max(F.when(F.col("role") == r, F.col("value")))
    url = F.min_by("source_url", F.when(F.col("source_url").isNotNull(), F.col("ord")))
    out = got.groupBy("claim_id", "tenant_id", "document_id", "n").agg(F.count(F.lit(1)).alias("k"), by_role("a").alias("a"), by_role("b").alias("b"), F.sum(F.when(F.col("role") == "s", F.col("value"))).try_cast(Q.DEC).alias("s"), F.bool_and(is_filed(F.col("source_type"), F.col("source_ref"))).alias("filed"), F.max("as_of").alias("d_as_of"), url.alias("d_url"))
    return out.filter("k = n").drop("k", "n")


def derived_value(kind: Column) -> Column:
    """Struct of ``num`` and ``den`` of the recomputed figure and its unit; null where it can't be computed."""
    a, b, one = F.col("a"), F.col("b"), F.lit(1).cast(Q.DEC)
    frac = lambda n, d, u: F.struct(n.try_cast(Q.DEC).alias("num"), d.try_cast(Q.DEC).alias("den"), F.lit(u).alias("unit"))
    return (
        F.when(kind.isin("yoy_growth", "qoq_growth") & (b != 0), frac((a - b) * 100, b, "percent"))
        .when((kind == "delta_bps") & a.isNotNull() & b.isNotNull(), frac((a - b) * 100, one, "basis_points"))
        .when((kind == "ratio_pct") & (b != 0), frac(a * 100, b, "percent"))
        .when((kind == "ratio") & (b != 0), frac(a, b, "ratio"))
        .when(kind.isin("sum", "ttm_sum"), frac(F.col("s"), one, "currency"))
    )


def derived_display(d: Column, unit: Column) -> Column:
    return Q.display(Q.quotient(d["num"], d["den"]), unit)


def derived_match(q: Column, d: Column) -> Column:
    return F.when(d["den"] == 1, Q.matches(q["value"], q["quantum"], d["num"])).otherwise(Q.matches_fraction(q["value"], q["quantum"], d["num"], d["den"]))


def identity(spec: Column) -> Column:
    return F.when(spec["kind"] == "sum", F.array_join(spec["components"], " + ")).when(spec["kind"].isin("ratio", "ratio_pct"), F.concat(spec["numerator"], F.lit(" / "), spec["denominator"])).otherwise(F.concat(spec["kind"], F.lit("("), spec["base"], F.lit(")")))


def scopes_needed(claims: DataFrame) -> DataFrame:
    """Every scope that parsed claims read: their own (role ``own``) and those of their operands, with each claim's columns as one struct ``c``."""
    s, p = F.col("spec"), F.col("period")
    op = lambda role, i, metric, period: F.struct(F.lit(role).alias("role"), F.lit(i).alias("ord"), metric.alias("metric"), period.alias("period"))
    prior = F.when(s["kind"] == "qoq_growth", P.prior_quarter(p)).otherwise(P.prior_year(p))
    pair = F.array(op("a", 0, s["base"], p), op("b", 1, s["base"], prior))
    ratio = F.array(op("a", 0, s["numerator"], p), op("b", 1, s["denominator"], p))
    total = F.transform(s["components"], lambda m, i: F.struct(F.lit("s").alias("role"), i.alias("ord"), m.alias("metric"), p.alias("period")))
    more = F.when(s["kind"].isin(*GROWTH), pair).when(s["kind"].isin("ratio", "ratio_pct"), ratio).when((s["kind"] == "sum") & (F.size(s["components"]) > 0), total)
    need = F.concat(F.array(op("own", -1, F.col("metric"), p)), F.coalesce(more, F.array().cast("array<struct<role:string,ord:int,metric:string,period:string>>")))
    each = claims.select(F.struct(*claims.columns).alias("c"), F.size(need).alias("n"), F.explode(need).alias("o"))
    return each.select("c", "n", F.col("c.tenant_id").alias("tenant_id"), F.col("c.entity").alias("entity"), "o.*")


def with_sources(need: DataFrame, scopes: DataFrame) -> DataFrame:
    """Claims with their own scope's ``latest`` and ``older`` and, where all operands have a value, with those: one join for all that is needed."""
    met = need.join(scopes, SCOPE, "left")
    own, v = F.col("role") == "own", F.col("latest")
    by_role = lambda r: F.max(F.when(F.col("role") == r, v["value"]))
    part = ~own & v.isNotNull()
    url = F.min_by(F.when(~own, v["source_url"]), F.when(part & v["source_url"].isNotNull(), F.col("ord")))
    out = met.groupBy("c", "n").agg(
        F.max(F.when(own, v)).alias("latest"), F.max(F.when(own, F.col("older"))).alias("older"), F.count_if(part).alias("k"), by_role("a").alias("a"), by_role("b").alias("b"),
        F.sum(F.when(F.col("role") == "s", v["value"])).try_cast(Q.DEC).alias("s"), F.bool_and(F.when(part, is_filed(v["source_type"], v["source_ref"]))).alias("filed"), F.max(F.when(part, v["as_of"])).alias("d_as_of"), url.alias("d_url"),
    )
    whole = (F.col("n") > 1) & (F.col("k") == F.col("n") - 1)
    return out.select("c.*", "latest", "older", *(F.when(whole, F.col(x)).alias(x) for x in ("a", "b", "s", "filed", "d_as_of", "d_url")))


def verify_claims(claims: DataFrame, facts: DataFrame, metrics: DataFrame, tolerance: str = "0") -> DataFrame:
    """Verdict, reason, source value and provenance of each claim; first rung that holds wins. Claims have ids of their own; equal rows give one verdict."""
    return verify_parsed(parsed(claims, metrics), fact_scopes(facts), claims.columns, tolerance)


def verify_parsed(claims: DataFrame, scopes: DataFrame, columns: list[str], tolerance: str = "0") -> DataFrame:
    """``verify_claims`` of parsed claims against scopes (``fact_scopes``, or those of a store); ``columns`` are kept."""
    kept = [F.col(c) for c in columns]
    rows = with_sources(scopes_needed(claims), scopes)
    rows = rows.withColumn("d", F.when(F.col("latest").isNull() & F.col("filed"), derived_value(F.col("spec.kind"))))
    q, last, d = F.col("q"), F.col("latest"), F.col("d")
    slack = F.lit(tolerance).cast("decimal(10,8)")
    unit = F.coalesce(F.col("spec.unit"), last["unit"])
    fits = lambda v: (v["unit"] == q["unit"]) & (Q.matches(q["value"], q["quantum"], v["value"]) | ((slack > 0) & (v["value"] != 0) & (F.abs(q["value"] - v["value"]) <= slack * F.abs(v["value"]))))
    stale = F.get(F.filter("older", lambda v: F.coalesce(fits(v), F.lit(False))), F.lit(0))
    rows = rows.withColumn("stale", stale)
    low = F.col("detect_confidence") == "low"
    d_fits = F.coalesce((q["unit"] == F.when(F.col("spec.kind").isin("sum", "ratio"), F.col("spec.unit")).otherwise(d["unit"])) & derived_match(q, d), F.lit(False))
    rung = (
        F.when(last.isNull() & d.isNull(), 0)
        .when(last.isNull() & (q.isNull() | low), 1)
        .when(last.isNull() & d_fits, 2)
        .when(last.isNull(), 3)
        .when(~is_filed(last["source_type"], last["source_ref"]), 4)
        .when(q.isNull(), 5)
        .when(low, 6)
        .when(F.coalesce(fits(last), F.lit(False)), 7)
        .when(F.col("stale").isNotNull(), 8)
        .otherwise(9)
    )
    rows = rows.withColumn("rung", rung)
    names = ("untraced", "needs_review", "traced", "conflict", "needs_review", "needs_review", "needs_review", "traced", "conflict", "conflict")
    reasons = ("no source in the fact store", "derived figure needs a reader", "recomputed from filed figures", "differs from the recomputed figure", "source is not filed", "text is not a single figure", "detected with low confidence", "matches the filed source", "superseded: the source was restated", "differs from the filed source")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("rung") + 1)
    made, stored = d.isNotNull(), last.isNotNull()
    provenance = F.when(stored, F.struct(last["source_type"].alias("source_type"), last["source_ref"].alias("ref"), last["source_label"].alias("label"), last["source_excerpt"].alias("excerpt"), last["source_url"].alias("url"))).when(
        made, F.struct(F.lit("derived").alias("source_type"), F.concat(F.lit("derived:"), identity(F.col("spec"))).alias("ref"), F.col("spec.label").alias("label"), identity(F.col("spec")).alias("excerpt"), F.col("d_url").alias("url"))
    )
    return rows.select(
        *kept,
        pick(names).alias("verdict"),
        pick(reasons).alias("reason"),
        F.when(stored, Q.display(last["value"], last["unit"])).when(made, derived_display(d, F.coalesce(unit, d["unit"]))).alias("source_value"),
        F.when(stored, last["as_of"]).when(made, F.col("d_as_of")).alias("source_as_of"),
        provenance.alias("provenance"),
        pick(names).isin("conflict", "untraced").alias("is_blocking"),
    )
