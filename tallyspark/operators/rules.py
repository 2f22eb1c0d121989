"""Rules over documents and claims. Each takes parsed claims and gives findings of one schema."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import quantity as Q
from . import verify as V
from .facts import SCOPE, latest_facts

FINDINGS = ("rule", "severity", "tenant_id", "document_id", "metric", "claim_id", "detail")
#: Words of direction, what looks ahead, and what counts as safe harbor.
UP = ("expanded", "increased", "grew", "rose", "improved", "higher", "up")
DOWN = ("declined", "decreased", "fell", "contracted", "dropped", "lower", "down")
TRIGGER = r"(?iU)\b(we expect|expects?|we anticipate|anticipates?|outlook|guidance|looking ahead|for the (?:second|third|fourth|first) quarter|full[- ]year|we believe we will|projected?|forecast)\b"
HARBOR = r"(?iU)\b(safe[- ]harbor|forward[- ]looking statements?|Private Securities Litigation Reform Act|Section 27A|Section 21E)\b"
MIDPOINT = r"(?iU)midpoint[^$%\d]{0,20}?(\$?\s?\d[\d,]*(?:\.\d+)?\s*(?:billion|million|thousand|trillion|bn|mm|[bmkt])?|\d{1,3}(?:\.\d+)?\s?%)"


@dataclass(frozen=True)
class Latest:
    """Facts of which there is one version a scope: rules take them as they are."""

    rows: DataFrame


def _latest(facts: DataFrame | Latest) -> DataFrame:
    return facts.rows if isinstance(facts, Latest) else latest_facts(facts)


def _found(df: DataFrame, rule: str, detail: Column | str, severity: str = "block") -> DataFrame:
    have = set(df.columns)
    cols = {"rule": F.lit(rule), "severity": F.lit(severity), "detail": F.lit(detail) if isinstance(detail, str) else detail.cast("string")}
    return df.select(*(cols.get(c, F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in FINDINGS))


def units(claims: DataFrame) -> DataFrame:
    bad = claims.filter(F.col("q").isNotNull() & (F.col("q.unit") != F.col("spec.unit")))
    return _found(bad, "units.unit_mismatch", F.concat_ws(" is not ", F.col("q.unit"), F.col("spec.unit")))


def inverted_ranges(claims: DataFrame) -> DataFrame:
    return _found(claims.filter(F.col("r.low.value") > F.col("r.high.value")), "ranges.inverted_range", F.col("displayed_text"))


def midpoints(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """A document's first stated midpoint against each of its ranges, at the stated precision."""
    said = F.regexp_extract(F.coalesce("text", F.lit("")), MIDPOINT, 1)
    stated = documents.select("tenant_id", "document_id", Q.parse_quantity(Q.strip(said)).alias("m")).filter("m IS NOT NULL")
    rows = claims.filter("r IS NOT NULL").join(stated, ["tenant_id", "document_id"])
    mid = Q.midpoint(F.col("r"))
    bad = rows.filter((F.col("m.unit") == F.col("r.low.unit")) & ~Q.matches(F.col("m.value"), F.col("m.quantum"), mid["value"]))
    return _found(bad, "ranges.midpoint_mismatch", Q.display(mid["value"], mid["unit"]))


def derived(claims: DataFrame, facts: DataFrame | Latest) -> DataFrame:
    """Growth, basis points, trailing sums, sums and ratios recomputed from the latest facts, filed or not."""
    got = V.resolved(V.operands(claims), _latest(facts))
    rows = claims.join(got, ["claim_id", "tenant_id", "document_id"]).withColumn("d", V.derived_value(F.col("spec.kind")))
    kind, q, d = F.col("spec.kind"), F.col("q"), F.col("d")
    assumed = kind.isin("sum", "ratio", "ratio_pct")  # the claimed unit is taken as meant
    bad = rows.filter(q.isNotNull() & d.isNotNull() & (assumed | (q["unit"] == d["unit"])) & ~V.derived_match(q, d)).withColumn("got", V.derived_display(d, F.coalesce("spec.unit", d["unit"])))
    of = lambda kinds, rule: _found(bad.filter(kind.isin(*kinds)), rule, F.col("got"))
    return of((*V.GROWTH, "ttm_sum"), "derived.recomputation_mismatch").unionByName(of(("sum",), "derived.sum_mismatch")).unionByName(of(("ratio", "ratio_pct"), "derived.ratio_mismatch"))


def non_gaap(claims: DataFrame, facts: DataFrame | Latest, metrics: DataFrame) -> DataFrame:
    """Prominence of the GAAP counterpart, and the bridge from it by the declared adjustments."""
    doc = ["tenant_id", "document_id"]
    ours = claims.filter("spec.is_non_gaap").withColumn("counterpart", F.col("spec.gaap_counterpart"))
    said = claims.select(*doc, F.col("metric").alias("counterpart")).distinct()
    missing = _found(ours.join(said, [*doc, "counterpart"], "left_anti"), "reg_g.equal_prominence", "GAAP counterpart is not presented")
    paired = ours.join(said, [*doc, "counterpart"], "left_semi")
    at = lambda role, i, m: F.struct(F.lit(role).alias("role"), F.lit(i).alias("ord"), m.alias("metric"))
    legs = F.concat(F.array(at("n", 0, F.col("metric")), at("g", 1, F.col("counterpart"))), F.transform("spec.adjustments", lambda m: F.struct(F.lit("x").alias("role"), F.lit(2).alias("ord"), m.alias("metric"))))
    need = paired.select("claim_id", *doc, "entity", "period", F.size("spec.adjustments").alias("n"), F.col("metric").alias("of"), F.explode(legs).alias("o")).select("claim_id", *doc, "entity", "period", "n", "of", "o.role", "o.metric")
    got = need.join(_latest(facts).select(*SCOPE, "value", "quantum"), SCOPE, "left")
    pick = lambda r, c="value": F.max(F.when(F.col("role") == r, F.col(c)))
    sums = got.groupBy("claim_id", *doc, "of", "n").agg(pick("n").alias("own"), pick("n", "quantum").alias("quantum"), pick("g").alias("gaap"), F.sum(F.when(F.col("role") == "x", F.col("value"))).alias("adds"), F.count_if((F.col("role") == "x") & F.col("value").isNotNull()).alias("k")).withColumnRenamed("of", "metric")
    no_leg = sums.filter("own IS NULL OR gaap IS NULL")
    step = F.when(F.col("quantum") > 0, F.col("quantum")).otherwise(F.lit("0.01").cast(Q.DEC))
    total = (F.col("gaap") + F.col("adds")).cast(Q.DEC)
    off = sums.filter("own IS NOT NULL AND gaap IS NOT NULL AND n > 0 AND k = n").filter(Q.round_to(total, step) != F.col("own"))
    return missing.unionByName(_found(no_leg, "reg_g.reconciliation_required", "a leg of the reconciliation is missing")).unionByName(_found(off, "reg_g.reconciliation_arithmetic", Q.number_text(total)))


def ordering(claims: DataFrame) -> DataFrame:
    """Non-GAAP figure before its GAAP counterpart, by first place in the document."""
    doc = ["tenant_id", "document_id"]
    first = claims.filter("span IS NOT NULL").groupBy(*doc, "metric").agg(F.min("span.start").alias("at"), F.max("spec.gaap_counterpart").alias("counterpart"), F.bool_or("spec.is_non_gaap").alias("non_gaap"))
    other = first.select(*doc, F.col("metric").alias("counterpart"), F.col("at").alias("gaap_at"))
    return _found(first.filter("non_gaap").join(other, [*doc, "counterpart"]).filter("at < gaap_at"), "reg_g.equal_prominence_ordering", "non-GAAP figure comes first", "warn")


def forward_looking(documents: DataFrame, claims: DataFrame, facts: DataFrame | Latest) -> DataFrame:
    doc = ["tenant_id", "document_id"]
    soft = _latest(facts).filter("source_type = 'management_input'").select(*SCOPE)
    ahead = claims.join(soft, SCOPE, "left_semi").groupBy(*doc).agg(F.array_join(F.array_sort(F.collect_set("metric")), ", ").alias("soft"))
    text = F.coalesce("text", F.lit(""))
    rows = documents.join(ahead, doc, "left").filter((text.rlike(TRIGGER) | F.col("soft").isNotNull()) & ~text.rlike(HARBOR))
    return _found(rows, "forward_looking.safe_harbor_required", F.coalesce("soft", F.lit("")))


def directional(documents: DataFrame, claims: DataFrame, facts: DataFrame | Latest) -> DataFrame:
    """The word of direction near a metric's label against the sign of its change over a year; once a metric."""
    latest = _latest(facts).select(*SCOPE, "value")
    prior = latest.select("tenant_id", "entity", "metric", F.col("period").alias("prior"), F.col("value").alias("before"))
    rows = claims.filter("spec IS NOT NULL").join(latest, SCOPE).withColumn("prior", P.prior_year(F.col("period"))).join(prior, ["tenant_id", "entity", "metric", "prior"])
    rows = rows.join(documents.select("tenant_id", "document_id", F.lower("text").alias("low")), ["tenant_id", "document_id"])
    at = F.instr(F.col("low"), F.lower("spec.label"))
    near = F.regexp_extract_all(F.substring("low", at, F.lit(120)), F.lit(r"[a-z]+"), F.lit(0))
    word = F.when(at > 0, F.when(F.arrays_overlap(near, F.array(*map(F.lit, UP))), "up").when(F.arrays_overlap(near, F.array(*map(F.lit, DOWN))), "down"))
    moved = F.when(F.col("value") > F.col("before"), "up").when(F.col("value") < F.col("before"), "down")
    bad = rows.withColumn("word", word).withColumn("moved", moved).filter("word <> moved")
    rank = F.row_number().over(Window.partitionBy("tenant_id", "document_id", "metric").orderBy("claim_id"))
    return _found(bad.withColumn("k", rank).filter("k = 1"), "directional.sign_mismatch", F.concat_ws(" but ", F.col("word"), F.col("moved")))


def _disagree(claims: DataFrame, group: list[str]) -> DataFrame:
    """Groups with two uses neither of which rounds to the other, or of unequal units.

    The coarser use decides of two. So at each precision the extremes are held against the extremes
    of all uses that are as precise or more; a group has a few dozen precisions at most.
    """
    use = claims.filter("q IS NOT NULL").select(*group, "q.unit", "q.quantum", "q.value")
    level = use.groupBy(*group, "unit", "quantum").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    finer = Window.partitionBy(*group, "unit").orderBy("quantum")
    level = level.withColumn("low", F.min("least").over(finer)).withColumn("high", F.max("most").over(finer))
    apart = ~Q.matches(F.col("most"), F.col("quantum"), F.col("low")) | ~Q.matches(F.col("least"), F.col("quantum"), F.col("high"))
    sets = level.groupBy(*group).agg((F.bool_or(apart) | (F.min("unit") != F.max("unit"))).alias("apart"))
    return sets.filter("apart").drop("apart")


USES = 20  # listed of a group; the rest are counted


def _listed_uses(claims: DataFrame, groups: DataFrame, group: list[str], most: int) -> DataFrame:
    """Groups with their first ``most`` uses as text, those that aren't figures too, in order of document and place.

    The limit is taken in each task before a group's uses meet, so a figure used very often doesn't gather in one.
    """
    use = claims.join(groups, group, "left_semi")
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("document_id", F.coalesce("span.start", F.lit(0)), "claim_id"))
    first = use.withColumn("nth", nth).filter(F.col("nth") <= most).withColumn("shown", F.concat("document_id", F.lit(": '"), F.coalesce("displayed_text", F.lit("")), F.lit("'")))
    listed = first.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "shown"))), lambda x: x["shown"]).alias("uses"))
    total = use.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > F.size("uses"), F.concat(F.lit("; and "), (F.col("n") - F.size("uses")).cast("string"), F.lit(" more"))).otherwise("")
    return listed.join(total, group).withColumn("detail", F.concat(F.concat_ws(" ", "entity", "period"), F.lit(": "), F.array_join("uses", "; "), more))


def consistency_within(claims: DataFrame, most: int = USES) -> DataFrame:
    group = ["tenant_id", "document_id", "entity", "metric", "period"]
    return _found(_listed_uses(claims, _disagree(claims, group), group, most), "consistency.intra_document_mismatch", F.col("detail"))


def consistency_across(claims: DataFrame, most: int = USES) -> DataFrame:
    group = ["tenant_id", "entity", "metric", "period"]
    return _found(_listed_uses(claims, _disagree(claims, group), group, most).withColumn("document_id", F.lit(None).cast("string")), "consistency.cross_document_mismatch", F.col("detail"))


def document_findings(documents: DataFrame, claims: DataFrame, facts: DataFrame | Latest, metrics: DataFrame) -> DataFrame:
    """All findings of single documents. ``claims`` are parsed."""
    parts = [non_gaap(claims, facts, metrics), ordering(claims), forward_looking(documents, claims, facts), derived(claims, facts), directional(documents, claims, facts), units(claims), consistency_within(claims), inverted_ranges(claims), midpoints(documents, claims)]
    return reduce(DataFrame.unionByName, parts)
