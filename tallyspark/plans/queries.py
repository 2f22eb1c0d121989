"""Queries over the star schema, each with DuckDB SQL that reckons the same from the integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import quantity as Q
from ..operators import audit, facts as FA, pack, rules
from ..operators.claims import detect_figures, extract_claims
from ..operators.staging import settled
from ..operators.verify import parsed, verify_claims
from ..sources import documents as D
from ..sources import filings, guidance, releases
from ..sources.vocabulary import aliases_table, default_aliases, default_metrics, metrics_table, vocabulary
from . import more, star, wider
from .base import BASE, KEY as _KEY, PAIRS as _PAIRS, facts as _facts_sql, million as _m

def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return star.facts(spark, sf)


def facts_latest(spark, sf):
    return FA.latest_facts(_facts(spark, sf)).select("entity", "metric", "period", (F.col("value") * 10000).cast("long").alias("amount"), "as_of")


def facts_restatements(spark, sf):
    f = FA.restatements(_facts(spark, sf), ["entity", "metric", "period"], ["as_of", "ingest_seq"])
    return f.groupBy("entity", "metric", "period").agg(F.count(F.lit(1)).alias("versions"))


def facts_lookback(spark, sf):
    """Nations stop reporting at different quarters, and some look a quarter ahead."""
    q = star.quarters(spark, sf).filter("y * 4 + q <= 8007 - c_nationkey % 4")
    return FA.within_lookback(star.facts_of(q), 8).groupBy("entity", "metric", "period").agg(F.count(F.lit(1)).alias("facts"))


def facts_coverage(spark, sf):
    return FA.coverage(_facts(spark, sf)).select("entity", "metric", "n_periods", "shown")


def default_entity(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    f = n.select(F.lit(star.TENANT).alias("tenant_id"), F.explode(F.array(F.concat(F.col("n_name"), F.lit(":Part")), F.col("n_name"))).alias("entity"), F.col("n_nationkey").cast("long").alias("ingest_seq"))
    return FA.default_entity(f)


def parse_quantity(spark, sf):
    c = star.tie_out_claims(star.quarters(spark, sf)).withColumn("q", Q.parse_quantity(F.col("displayed_text")))
    return c.select("entity", "period", (F.col("q.value") * 10000).cast("long").alias("amount"), (F.col("q.quantum") * 10000).cast("long").alias("quantum"), F.col("q.unit").alias("unit"))


def parse_range(spark, sf):
    c = star.range_claims(star.quarters(spark, sf)).withColumn("r", Q.parse_range(F.col("displayed_text")))
    return c.select("entity", "period", (F.col("r.low.value") * 10000).cast("long").alias("low"), (F.col("r.high.value") * 10000).cast("long").alias("high"))


def display_quantity(spark, sf):
    return FA.latest_facts(_facts(spark, sf)).select("entity", "metric", "period", Q.display(F.round("value", 2).cast(Q.DEC), F.col("unit")).alias("shown"))


def period_arith(spark, sf):
    p = F.col("period")
    return star.quarters(spark, sf).select("entity", "period", P.prior_year(p).alias("prior_year"), P.prior_quarter(p).alias("prior_quarter"), P.next_quarter(p).alias("next_quarter"), P.period_rank(p).cast("long").alias("rank"))


def _verdicts(spark, q, claims) -> DataFrame:
    """Verdicts of claims against the facts of the quarters that they were made from."""
    return verify_claims(claims, star.facts_of(q), star.metrics(spark))


def tie_out_verdicts(spark, sf):
    q = star.quarters(spark, sf)
    return _verdicts(spark, q, star.tie_out_claims(q)).select("entity", "period", "metric", "verdict", "is_blocking")


def superseded_conflicts(spark, sf):
    q = star.quarters(spark, sf)
    v = _verdicts(spark, q, star.tie_out_claims(q))
    return v.filter(F.col("reason").startswith("superseded")).select("entity", "period")


def _growth(spark, sf, metric, back):
    q = star.quarters(spark, sf)
    return _verdicts(spark, q, star.growth_claims(q, metric, back)).select("entity", "period", "verdict")


def derived_yoy(spark, sf):
    return _growth(spark, sf, "revenue_growth_yoy", 4)


def derived_qoq(spark, sf):
    return _growth(spark, sf, "revenue_growth_qoq", 1)


def derived_sum(spark, sf):
    q = star.quarters(spark, sf)
    c = star._claim(q, "release", 4, "revenue_parts", star.millions(F.col("v2") + F.when(F.col("k") % 3 == 0, 100_000_000).otherwise(0)))
    return _verdicts(spark, q, c).select("entity", "period", "verdict")


def derived_ratio_pct(spark, sf):
    q = star.quarters(spark, sf)
    up = F.when(F.col("k") % 3 == 0, F.expr("v2 div 1000")).otherwise(F.lit(0))
    c = star._claim(q, "release", 4, "return_share", F.concat(star.tenth(F.col("v2") - F.col("v1") + up, F.col("v2")), F.lit("%")))
    return _verdicts(spark, q, c).select("entity", "period", "verdict")


def derived_bps(spark, sf):
    q = star.quarters(spark, sf)
    levels = q.withColumn("level", star.level())
    was = levels.select(F.col("entity").alias("e"), F.col("period").alias("p"), F.col("level").alias("was"))
    rows = levels.join(was, (F.col("e") == F.col("entity")) & (F.col("p") == P.prior_year(F.col("period"))))
    d = F.col("level") - F.col("was")
    n = F.floor((F.abs(d) + 50) / 100).cast("long") + F.when(F.col("k") % 3 == 0, 1).otherwise(0)
    c = star._claim(rows, "release", 4, "margin_points", F.concat(F.when(d < 0, "-").otherwise(""), n.cast("string"), F.lit(" bps")))
    return _verdicts(spark, q, c).select("entity", "period", "verdict")


def derived_ttm(spark, sf):
    q = star.quarters(spark, sf)
    total = F.sum("v2").over(Window.partitionBy("entity").orderBy("t").rangeBetween(-3, 0))
    n = F.count("v2").over(Window.partitionBy("entity").orderBy("t").rangeBetween(-3, 0))
    rows = q.withColumn("t", F.col("y") * 4 + F.col("q") - 1).withColumn("s", total).withColumn("n", n).filter("n = 4")
    c = star._claim(rows, "release", 4, "revenue_ttm", star.millions(F.col("s") + F.when(F.col("k") % 3 == 0, 100_000_000).otherwise(0)))
    return rules.derived(parsed(c, star.metrics(spark)), star.facts_of(q)).select("document_id", "rule")


def _reg_g(spark, sf):
    q = star.quarters(spark, sf)
    return rules.non_gaap(parsed(star.gaap_claims(q), star.metrics(spark)), star.facts_of(q), star.metrics(spark)).select("document_id", "metric", "rule")


def reg_g_prominence(spark, sf):
    return _reg_g(spark, sf).filter("rule = 'reg_g.equal_prominence'")


def reg_g_bridge(spark, sf):
    return _reg_g(spark, sf).filter("rule <> 'reg_g.equal_prominence'")


def reg_g_ordering(spark, sf):
    return rules.ordering(parsed(star.gaap_claims(star.quarters(spark, sf)), star.metrics(spark))).select("document_id", "metric", "severity")


def forward_looking(spark, sf):
    q = star.quarters(spark, sf)
    return rules.forward_looking(star.documents(q), parsed(star.range_claims(q), star.metrics(spark)), star.facts_of(q)).select("document_id", "detail")


def directional(spark, sf):
    q = star.quarters(spark, sf)
    return rules.directional(star.documents(q), parsed(star.tie_out_claims(q), star.metrics(spark)), star.facts_of(q)).select("document_id", "detail")


def unit_mismatch(spark, sf):
    q = star.quarters(spark, sf)
    text = F.when(F.col("k") % 3 == 0, "12.5%").when(F.col("k") % 3 == 1, "50 bps").otherwise("$5")
    return rules.units(parsed(star._claim(q, "release", 1, "total_revenue", text), star.metrics(spark))).select("document_id", "detail")


def intra_doc(spark, sf):
    read = settled(parsed(star.repeated_claims(star.quarters(spark, sf)), star.metrics(spark)), "claims")
    return rules.consistency_within(read).select("document_id", "metric")


def cross_doc(spark, sf):
    """Uses that disagree across documents, all listed: those that are no figures too."""
    q = star.quarters(spark, sf)
    vague = star._claim(q.filter("k % 5 = 0"), "qa", 1, "total_revenue", F.lit("about a billion"))
    read = settled(parsed(star.repeated_claims(q).unionByName(vague), star.metrics(spark)), "claims")  # the rule reads it four times
    return rules.consistency_across(read).select("detail", "metric")


def range_inverted(spark, sf):
    return rules.inverted_ranges(parsed(star.range_claims(star.quarters(spark, sf)), star.metrics(spark))).select("document_id", "metric")


def range_midpoint(spark, sf):
    q = star.quarters(spark, sf)
    return rules.midpoints(star.documents(q), parsed(star.range_claims(q), star.metrics(spark))).select("document_id", "metric")


def verdict_counts(spark, sf):
    q = star.quarters(spark, sf)
    return pack.verdict_counts(_verdicts(spark, q, star.tie_out_claims(q))).drop("tenant_id")


def publishable(spark, sf):
    q = star.quarters(spark, sf)
    docs, claims = star.documents(q), star.tie_out_claims(q)
    v, f = pack.verify_documents(docs, claims, star.facts_of(q), star.metrics(spark))
    return pack.publishable(docs, v, f).drop("tenant_id")


def eval_gate(spark, sf):
    q = star.quarters(spark, sf)
    m = F.col("k") % 7
    want = q.select("entity", "period", F.when(m.isin(0, 1), "traced").when(m.isin(2, 3), "conflict").when(m == 5, "untraced").otherwise("needs_review").alias("expected"))
    r = pack.eval_report(_verdicts(spark, q, star.tie_out_claims(q)).join(want, ["entity", "period"]))
    return r.select("total", "exact", "tp", "fp", "fn", "tn")


def guidance_facts(spark, sf):
    q = star.quarters(spark, sf)
    text = F.concat(F.lit("Revenue was fine. For the next period the company expects revenue of "), star.millions(F.col("v2")), F.lit(" to "), star.millions(F.col("v2") + 200_000_000), F.lit(". It was a good quarter."))
    rel = q.select(F.lit(star.TENANT).alias("tenant_id"), "entity", F.concat_ws("-", "entity", "period").alias("accession"), F.col("period").alias("base_period"), F.lit("2002-01-01").alias("as_of"), F.lit(None).cast("string").alias("label"), text.alias("text"))
    return guidance.guidance_facts(rel)[0].select("entity", "metric", "period", (F.col("value") * 10000).cast("long").alias("amount"))


def instance_ingest(spark, sf):
    q = star.quarters(spark, sf)
    item = F.struct(F.when(F.col("k") % 4 == 0, "x:Unknown").otherwise("us-gaap:Revenues").alias("tag"), F.lit(None).cast("string").alias("metric"), F.lit(None).cast("string").alias("entity"), "period", F.col("v2").cast("string").alias("value"), F.lit("USD").alias("unit"), F.lit(-3).alias("decimals"), *(F.lit(None).cast("string").alias(c) for c in ("source_type", "source_ref", "label", "excerpt", "source_url", "as_of", "confidence")))
    inst = q.groupBy("entity").agg(F.array_sort(F.collect_list(item)).alias("facts")).withColumn("accession", F.concat(F.lit("a-"), F.col("entity")))
    return filings.instance_facts(inst, metrics_table(spark), star.TENANT)[0].select("entity", "metric", "period", F.col("value").cast("long").alias("amount"), F.col("quantum").cast("long").alias("quantum"))


def companyfacts_ingest(spark, sf):
    """Companies whose last quarters differ."""
    q = star.quarters(spark, sf).filter("y * 4 + q <= 8007 - c_nationkey % 4")
    occ = lambda v, filed: F.struct(F.lit(None).cast("string").alias("start"), F.concat_ws("-", F.col("y").cast("string"), F.lpad((F.col("q") * 3).cast("string"), 2, "0"), F.lit("28")).alias("end"), F.col(v).cast("string").alias("val"), F.lit(filed).alias("accn"), F.lit("10-Q").alias("form"), F.lit(filed).alias("filed"), F.lit(None).cast("string").alias("frame"))
    each = q.select("entity", F.explode(F.array(occ("v1", "2002-01-01"), occ("v2", "2002-06-01"), occ("v2", "2002-09-01"))).alias("o")).groupBy("entity").agg(F.collect_list("o").alias("o"))
    feed = each.select(F.lit(1).cast("long").alias("cik"), F.col("entity").alias("entityName"), F.struct(F.create_map(F.lit("Revenues"), F.struct(F.lit("Revenue").alias("label"), F.create_map(F.lit("USD"), F.col("o")).alias("units"))).alias("us-gaap")).alias("facts"))
    return filings.feed_facts(feed, metrics_table(spark), star.TENANT, 8)[0].select("entity", "metric", "period", F.col("value").cast("long").alias("amount"), "as_of")


def _chain(spark, sf) -> DataFrame:
    ev = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("ord"), F.lit("2002-01-01T00:00:00").alias("timestamp"), F.lit("engine").alias("actor"), F.lit("ingest").alias("type"), F.col("n_name").alias("tenant_id"), F.concat(F.lit('{"n":'), F.col("n_regionkey").cast("string"), F.lit("}")).alias("payload"))
    return audit.append(ev)


def audit_chain(spark, sf):
    return _chain(spark, sf).select("seq", "tenant_id", "prev_hash", "hash")


def audit_tamper(spark, sf):
    bad = _chain(spark, sf).withColumn("payload", F.when(F.col("seq") == 7, '{"n":99}').otherwise(F.col("payload")))
    return audit.verify(bad)


def best_release(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Reports "), F.element_at(F.array(*map(F.lit, ("First", "Second", "Third", "Fourth"))), F.quarter("o_orderdate")), F.lit(" Quarter "), F.year("o_orderdate").cast("string"), F.lit(" Results."))).otherwise("Update."), F.repeat(F.lit(" $5 million;"), (F.col("o_orderkey") % 5).cast("int")))
    f = o.select(F.col("o_custkey").cast("string").alias("issuer"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("accession"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_date"), text.alias("text"))
    return releases.select_quarters(f, 4).select("issuer", "key", "accession", "stated", "n_figures")


def candidate_choice(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    url = F.concat(F.lit("https://www."), F.element_at(F.array(*map(F.lit, ("sec.gov", "q4cdn.com", "prnewswire.com", "other.org"))), (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit("/"), F.col("o_orderkey").cast("string"))
    title = F.when(F.col("o_orderkey") % 7 == 0, "X to announce quarter results").when(F.col("o_orderkey") % 5 == 0, "Newsletter").otherwise("X reports third quarter results")
    r = o.select(F.col("o_custkey").cast("string").alias("slot"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("pos"), title.alias("title"), url.alias("url"), F.repeat(F.lit("up 5% "), (F.col("o_orderkey") % 17).cast("int")).alias("text"))
    return releases.choose_candidates(r).select("slot", "pos", F.col("rank").cast("int").alias("rank"), "n_figures")


def detect_figure_spans(spark, sf):
    docs = star.documents(star.quarters(spark, sf))
    return detect_figures(docs).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.min("figure").alias("figure"))


def extracted_claims(spark, sf):
    q = star.quarters(spark, sf)
    return extract_claims(star.documents(q), star.facts_of(q)).select("document_id", "metric", "displayed_text", "detect_confidence")


def html_text(spark, sf):
    return D.html_texts(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", F.length("text").cast("long").alias("n_chars"), (F.instr("text", "<script") > 0).alias("has_script"))


def table_render(spark, sf):
    q = star.quarters(spark, sf)
    page = F.concat(F.lit("<p>in millions</p><table><tr><th>Line</th><th>First Quarter 2026</th><th>First Quarter 2025</th></tr><tr><td>Revenue</td><td>$</td><td>"), F.col("k").cast("string"), F.lit(".5</td><td>$</td><td>9</td></tr><tr><td>Loss</td><td>(</td><td>7.25</td><td>)</td><td>8</td></tr></table>"))
    return D.html_texts(q.select("entity", "period", page.alias("html"))).select("entity", "period", F.trim("text").alias("text"))


def alias_vocabulary(spark, sf):
    m = metrics_table(spark, default_metrics())
    return vocabulary(m, aliases_table(spark)).select("metric", F.size("phrases").cast("long").alias("n"), F.get("phrases", F.lit(0)).alias("longest"))


def segment_resolution(spark, sf):
    q = star.quarters(spark, sf, segments=True)
    f = q.select(F.lit(star.TENANT).alias("tenant_id"), F.concat_ws(":", "entity", "c_mktsegment").alias("entity"), (F.col("c_nationkey") * 10000 + F.col("y") * 4 + F.col("q")).cast("long").alias("ingest_seq"))
    return FA.segment_keywords(f).select("keyword", "entity", "first_seq")


def figure_counts(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", releases.figure_count(F.coalesce("text", F.lit(""))).alias("n_figures"))


def tidy_pages(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.length(D.tidy_column(F.coalesce("text", F.lit("")))).cast("long").alias("n_chars"))


def _growth_sql(back: int) -> str:
    # Shown to a tenth: the claim's tenths against those of the filed amounts.
    tenths = "(CASE WHEN ({n}) < 0 THEN -1 ELSE 1 END) * ((abs({n})::HUGEINT * 2000 + {d}) // (2 * {d}))"
    said, true = tenths.format(n="v2 - was + CASE WHEN k % 3 = 0 THEN was // 1000 ELSE 0 END", d="was"), tenths.format(n="v2 - was", d="was")
    return f"WITH {BASE}, {_PAIRS.format(back=back)} SELECT entity, period, CASE WHEN {said} = {true} THEN 'traced' ELSE 'conflict' END AS verdict FROM p"


_CASE = f"""CASE WHEN k % 7 = 5 THEN 'untraced' WHEN k % 7 IN (4, 6) THEN 'needs_review' WHEN k % 7 IN (0, 1) THEN 'traced'
  WHEN k % 7 = 2 AND {_m('v1')} = {_m('v2')} THEN 'traced' ELSE 'conflict' END"""
_SHOWN = """CASE k % 7 WHEN 1 THEN (v2 + 5000000) // 10000000 * 10000000 WHEN 2 THEN {v1} WHEN 3 THEN {v3} WHEN 4 THEN NULL ELSE {v2} END""".format(v1=_m("v1"), v2=_m("v2"), v3=_m("v2 + 100000000"))
_REL = "'release-' || entity || '-' || period AS document_id"
_SCR = "'script-' || entity || '-' || period AS document_id"


def _aliases_sql() -> str:
    known = {m.id: m.label.lower() for m in default_metrics()}
    pairs = {(m, p) for m, ps in default_aliases().items() for p in ps} | set(known.items())
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(m)}, {quoted(p)})" for m, p in sorted(pairs))
    return f"SELECT metric, count(*)::BIGINT AS n, arg_min(phrase, (-length(phrase), phrase)) AS longest FROM (VALUES {values}) v(metric, phrase) GROUP BY metric"


def _uses_sql() -> str:
    n = lambda x: f"((({x}) + 50000000) // 100000000)"
    shown = lambda x: f"('$' || ({n(x)} // 100) || '.' || lpad(({n(x)} % 100)::VARCHAR, 2, '0') || ' million')"
    off = lambda m: f"v2 + CASE WHEN k % {m} = 0 THEN 100000000 ELSE 0 END"
    said = lambda kind, x: f"'{kind}-' || d || ': ' || chr(39) || {x} || chr(39)"
    about = "'about a billion'"
    uses = f"[CASE WHEN k % 5 = 0 THEN {said('qa', about)} END, {said('release', shown('v2'))}, {said('release', shown(off(3)))}, {said('script', shown(off(4)))}]"
    return f"WITH {BASE}, m AS (SELECT *, entity || '-' || period AS d FROM b) SELECT entity || ' ' || period || ': ' || array_to_string(list_filter({uses}, lambda x: x IS NOT NULL), '; ') AS detail, 'total_revenue' AS metric FROM m WHERE k % 3 = 0 OR k % 4 = 0"


def oracle_sql() -> dict[str, str]:
    w = f"WITH {BASE}"
    return {
        "facts_latest": f"{w}, {_facts_sql()} SELECT entity, metric, period, amount::BIGINT AS amount, as_of FROM f WHERE seq <> 0",
        "facts_restatements": f"{w}, {_facts_sql()}, r AS (SELECT *, lag(amount) OVER (PARTITION BY entity, metric, period ORDER BY seq) AS was FROM f) SELECT entity, metric, period, count(*)::BIGINT AS versions FROM r WHERE was IS NULL OR was <> amount GROUP BY ALL",
        "facts_lookback": f"{w}, {_facts_sql('y * 4 + q <= 8007 - nk % 4')}, n AS (SELECT *, max(t) OVER (PARTITION BY entity) AS newest FROM f) SELECT entity, metric, period, count(*)::BIGINT AS facts FROM n WHERE t > newest - 8 GROUP BY ALL",
        "facts_coverage": f"{w}, {_facts_sql()}, l AS (SELECT entity, metric, list_sort(list(DISTINCT period)) AS p FROM f GROUP BY entity, metric) SELECT entity, metric, len(p)::BIGINT AS n_periods, CASE WHEN len(p) > 6 THEN array_to_string(p[-6:], ', ') || ' (+' || (len(p) - 6) || ' earlier)' ELSE array_to_string(p, ', ') END AS shown FROM l",
        "parse_quantity": f"{w} SELECT entity, period, ({_SHOWN})::BIGINT AS amount, CASE k % 7 WHEN 4 THEN NULL WHEN 1 THEN 10000000 ELSE 100000000 END::BIGINT AS quantum, CASE WHEN k % 7 <> 4 THEN 'currency' END AS unit FROM b",
        "parse_range": f"{w} SELECT entity, period, CASE WHEN k % 4 = 0 THEN {_m('v2 + 200000000')} ELSE {_m('v2')} END::BIGINT AS low, CASE WHEN k % 4 = 0 THEN {_m('v2')} ELSE {_m('v2 + 200000000')} END::BIGINT AS high FROM b",
        "display_quantity": f"{w}, {_facts_sql()}, c AS (SELECT *, (amount + 50) // 100 AS c FROM f WHERE seq <> 0) SELECT entity, metric, period, CASE WHEN metric = 'return_level' THEN '' ELSE '$' END || (c // 100) || CASE WHEN c % 100 = 0 THEN '' ELSE rtrim('.' || lpad((c % 100)::VARCHAR, 2, '0'), '0') END || CASE WHEN metric = 'return_level' THEN '%' ELSE '' END AS shown FROM c",
        "period_arith": f"{w} SELECT entity, period, {_KEY.format(t='t - 4')} AS prior_year, {_KEY.format(t='t - 1')} AS prior_quarter, {_KEY.format(t='t + 1')} AS next_quarter, (t + 1)::BIGINT AS rank FROM b",
        "tie_out_verdicts": f"{w}, v AS (SELECT *, {_CASE} AS verdict FROM b) SELECT entity, period, CASE WHEN k % 7 = 5 THEN 'unknown_metric' ELSE 'total_revenue' END AS metric, verdict, verdict IN ('conflict', 'untraced') AS is_blocking FROM v",
        "superseded_conflicts": f"{w} SELECT entity, period FROM b WHERE k % 7 = 2 AND {_m('v1')} <> {_m('v2')} OR k % 7 = 3 AND {_m('v2 + 100000000')} = {_m('v1')}",
        "derived_yoy": _growth_sql(4),
        "derived_qoq": _growth_sql(1),
        "derived_sum": f"{w} SELECT entity, period, CASE WHEN k % 3 = 0 THEN 'conflict' ELSE 'traced' END AS verdict FROM b",
        "derived_ratio_pct": f"{w}, s AS (SELECT *, ((v2 - v1 + CASE WHEN k % 3 = 0 THEN v2 // 1000 ELSE 0 END)::HUGEINT * 2000 + v2) // (2 * v2) AS said, ((v2 - v1)::HUGEINT * 2000 + v2) // (2 * v2) AS got FROM b) SELECT entity, period, CASE WHEN said = got THEN 'traced' ELSE 'conflict' END AS verdict FROM s",
        "derived_bps": f"{w} SELECT b.entity, b.period, CASE WHEN b.k % 3 = 0 THEN 'conflict' ELSE 'traced' END AS verdict FROM b JOIN b w ON w.entity = b.entity AND w.t = b.t - 4",
        "derived_ttm": f"{w} SELECT 'release-' || b.entity || '-' || b.period AS document_id, 'derived.recomputation_mismatch' AS rule FROM b WHERE k % 3 = 0 AND (SELECT count(*) FROM b w WHERE w.entity = b.entity AND w.t BETWEEN b.t - 3 AND b.t) = 4",
        "reg_g_prominence": f"{w} SELECT {_REL}, 'adjusted_revenue' AS metric, 'reg_g.equal_prominence' AS rule FROM b WHERE k % 2 = 0",
        "reg_g_bridge": f"{w} SELECT {_REL}, 'adjusted_revenue' AS metric, 'reg_g.reconciliation_arithmetic' AS rule FROM b WHERE k % 2 = 1 AND (v2 + 50) // 100 * 100 <> v2 + CASE WHEN k % 5 = 0 THEN 10000 ELSE 0 END",
        "reg_g_ordering": f"{w} SELECT {_REL}, 'adjusted_revenue' AS metric, 'warn' AS severity FROM b WHERE k % 2 = 1 AND k % 3 <> 1",
        "forward_looking": f"{w}, soft AS (SELECT entity, {_KEY.format(t='t + 1')} AS period FROM b WHERE nk % 5 = 0) SELECT {_REL}, '' AS detail FROM b WHERE k % 3 = 0 AND k % 4 <> 0 UNION ALL SELECT 'script-' || b.entity || '-' || b.period, 'revenue_guidance' FROM b JOIN soft USING (entity, period)",
        "directional": f"{w}, {_PAIRS.format(back=4)} SELECT {_REL}, CASE WHEN k % 2 = 0 THEN 'up but down' ELSE 'down but up' END AS detail FROM p WHERE k % 7 <> 5 AND CASE WHEN k % 2 = 0 THEN v2 < was ELSE v2 > was END",
        "unit_mismatch": f"{w} SELECT {_REL}, CASE WHEN k % 3 = 0 THEN 'percent is not currency' ELSE 'basis_points is not currency' END AS detail FROM b WHERE k % 3 <> 2",
        "intra_doc": f"{w} SELECT {_REL}, 'total_revenue' AS metric FROM b WHERE k % 3 = 0",
        "cross_doc": _uses_sql(),
        "range_inverted": f"{w} SELECT {_SCR}, 'revenue_guidance' AS metric FROM b WHERE k % 4 = 0",
        "range_midpoint": f"{w} SELECT {_SCR}, 'revenue_guidance' AS metric FROM b WHERE k % 3 = 1",
        "verdict_counts": f"{w}, v AS (SELECT *, {_CASE} AS verdict FROM b) SELECT {_REL}, (verdict = 'traced')::BIGINT AS traced, (verdict = 'needs_review')::BIGINT AS needs_review, (verdict = 'conflict')::BIGINT AS conflict, (verdict = 'untraced')::BIGINT AS untraced FROM v",
        "publishable": f"{w}, v AS (SELECT b.*, {_CASE.replace('k %', 'b.k %').replace('v1', 'b.v1').replace('v2', 'b.v2')} AS verdict, w.v2 AS was FROM b LEFT JOIN b w ON w.entity = b.entity AND w.t = b.t - 4) SELECT {_REL}, verdict NOT IN ('conflict', 'untraced') AND NOT (k % 3 = 0 AND k % 4 <> 0) AND NOT coalesce(k % 7 <> 5 AND CASE WHEN k % 2 = 0 THEN v2 < was ELSE v2 > was END, false) AS publishable FROM v UNION ALL SELECT unnest(['script-', 'qa-']) || entity || '-' || period, true FROM b",
        "eval_gate": f"{w}, v AS (SELECT {_CASE} AS verdict, CASE WHEN k % 7 IN (0, 1) THEN 'traced' WHEN k % 7 IN (2, 3) THEN 'conflict' WHEN k % 7 = 5 THEN 'untraced' ELSE 'needs_review' END AS expected FROM b) SELECT count(*) AS total, count(*) FILTER (WHERE verdict = expected) AS exact, count(*) FILTER (WHERE verdict <> 'traced' AND expected <> 'traced') AS tp, count(*) FILTER (WHERE verdict <> 'traced' AND expected = 'traced') AS fp, count(*) FILTER (WHERE verdict = 'traced' AND expected <> 'traced') AS fn, count(*) FILTER (WHERE verdict = 'traced' AND expected = 'traced') AS tn FROM v",
        "guidance_facts": f"{w} SELECT entity, 'revenue_guidance' AS metric, {_KEY.format(t='t + 1')} AS period, (({_m('v2')} + {_m('v2 + 200000000')}) // 2)::BIGINT AS amount FROM b",
        "instance_ingest": f"{w} SELECT entity, 'total_revenue' AS metric, period, v2 AS amount, 1000::BIGINT AS quantum FROM b WHERE k % 4 <> 0",
        "companyfacts_ingest": f"{w}, n AS (SELECT *, max(t) OVER (PARTITION BY entity) AS newest FROM b WHERE y * 4 + q <= 8007 - nk % 4), f AS (SELECT * FROM n WHERE t > newest - 8) SELECT entity, 'total_revenue' AS metric, period, v1 AS amount, '2002-01-01' AS as_of FROM f UNION ALL SELECT entity, 'total_revenue', period, v2, '2002-06-01' FROM f WHERE v1 <> v2",
        "audit_chain": """WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS seq, n_name, '{"actor":"engine","payload":{"n":' || n_regionkey || '},"prev_hash":"' AS head, '","seq":' || (row_number() OVER (ORDER BY n_nationkey) - 1) || ',"tenant_id":"' || n_name || '","timestamp":"2002-01-01T00:00:00","type":"ingest"}' AS tail FROM nation),
c AS (SELECT seq, n_name, repeat('0', 64) AS prev_hash, sha256(head || repeat('0', 64) || tail) AS hash FROM e WHERE seq = 0 UNION ALL SELECT e.seq, e.n_name, c.hash, sha256(e.head || c.hash || e.tail) FROM e JOIN c ON e.seq = c.seq + 1)
SELECT seq, n_name AS tenant_id, prev_hash, hash FROM c""",
        "audit_tamper": "SELECT false AS ok, 7::BIGINT AS first_bad_seq, 'hash' AS reason",
        "best_release": "WITH f AS (SELECT o_custkey::VARCHAR AS issuer, lpad(o_orderkey::VARCHAR, 10, '0') AS accession, o_orderdate AS d, 'FY' || year(o_orderdate) || '-Q' || quarter(o_orderdate) AS key, o_orderkey % 2 = 0 AND year(o_orderdate) >= 2000 AS stated, (o_orderkey % 5)::BIGINT AS n_figures FROM orders), g AS (SELECT issuer, key, row_number() OVER (PARTITION BY issuer ORDER BY max(d) DESC) AS i, bool_or(stated) AS sure, arg_max(stated, (d, accession)) AS first FROM f GROUP BY issuer, key), s AS (SELECT issuer, greatest(0, least(count(*) FILTER (WHERE i <= 4 AND NOT sure), least(coalesce(min(i) FILTER (WHERE i > 4 AND NOT first) - 1, 1000000), max(i)) - 4)) AS late FROM g GROUP BY issuer), w AS (SELECT *, count(*) FILTER (WHERE i <= 4 AND NOT sure) OVER (PARTITION BY issuer ORDER BY i) AS soft FROM g JOIN s USING (issuer)), h AS (SELECT issuer, key FROM w WHERE i <= 4 AND (sure OR soft > late) OR i BETWEEN 5 AND 4 + late) SELECT issuer, key, accession, stated, n_figures FROM (SELECT f.*, row_number() OVER (PARTITION BY issuer, key ORDER BY stated DESC, n_figures DESC, d::DATE DESC, accession DESC) AS k FROM f JOIN h USING (issuer, key)) WHERE k = 1",
        "candidate_choice": "WITH r AS (SELECT o_custkey::VARCHAR AS slot, o_orderkey AS pos, (CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 9 END)::INT AS rank, (o_orderkey % 17)::BIGINT AS n_figures FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 17 >= 8) SELECT slot, pos, rank, n_figures FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY rank, n_figures DESC, pos) AS k FROM r) WHERE k = 1",
        "detect_figure_spans": f"{w} SELECT {_REL}, 1::BIGINT AS n, '$' || (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') || ' million' AS figure FROM (SELECT *, (v2 + 50000000) // 100000000 AS c FROM b) UNION ALL SELECT {_SCR}, 1, '$' || (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') || ' million' FROM (SELECT *, (v2 + CASE WHEN k % 3 = 1 THEN 300000000 ELSE 100000000 END + 50000000) // 100000000 AS c FROM b)",
        "extracted_claims": f"{w} SELECT {_REL}, 'total_revenue' AS metric, '$' || (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') || ' million' AS displayed_text, 'high' AS detect_confidence FROM (SELECT *, (v2 + 50000000) // 100000000 AS c FROM b) UNION ALL SELECT {_SCR}, 'unidentified', '$' || (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') || ' million', 'low' FROM (SELECT *, (v2 + CASE WHEN k % 3 = 1 THEN 300000000 ELSE 100000000 END + 50000000) // 100000000 AS c FROM b)",
        "table_render": f"{w} SELECT entity, period, 'in millions' || repeat(chr(10), 2) || 'Line First Quarter 2026 First Quarter 2025' || chr(10) || 'Revenue: $' || k || '.5 million (FY2026-Q1); $9 million (FY2025-Q1)' || chr(10) || 'Loss: -$7.25 million (FY2026-Q1); $8 million (FY2025-Q1)' AS text FROM b",
        "segment_resolution": "WITH s AS (SELECT n_name || ':' || c_mktsegment AS entity, lower(c_mktsegment) AS keyword, c_nationkey * 10000 + year(l_shipdate) * 4 + quarter(l_shipdate) AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) SELECT keyword, arg_max(entity, i) AS entity, min(i)::BIGINT AS first_seq FROM s GROUP BY keyword",
        "tidy_pages": r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t\f\x0B]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, length(regexp_replace(regexp_replace(t, '\n[\s\x0B\x85\p{Z}]*\n[\s\x0B\x85\p{Z}]*\n+', chr(10) || chr(10), 'g'), '^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$', '', 'g'))::BIGINT AS n_chars FROM a""",
        "alias_vocabulary": _aliases_sql(),
        "default_entity": "SELECT 'star' AS tenant_id, n_name AS entity FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation)",
        **wider.SQL,
        **more.SQL,
    }


ALL = (
    facts_latest, facts_restatements, facts_lookback, facts_coverage, default_entity, parse_quantity, parse_range, display_quantity, period_arith, tie_out_verdicts, superseded_conflicts,
    derived_yoy, derived_qoq, derived_sum, derived_ratio_pct, derived_bps, derived_ttm, reg_g_prominence, reg_g_bridge, reg_g_ordering, forward_looking, directional, unit_mismatch, intra_doc,
    cross_doc, range_inverted, range_midpoint, verdict_counts, publishable, eval_gate, guidance_facts, instance_ingest, companyfacts_ingest, audit_chain, audit_tamper, best_release,
    candidate_choice, detect_figure_spans, extracted_claims, html_text, table_render, alias_vocabulary, segment_resolution, figure_counts, tidy_pages,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL} | wider.QUERIES | more.QUERIES
