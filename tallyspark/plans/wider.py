"""More queries over the star schema, each beside the SQL that reckons the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import periods as P
from ..operators import audit, facts as FA, pack, rules
from ..operators.claims import extract_claims
from ..operators.verify import parsed, verify_claims
from ..sources import filings, releases
from . import star
from .base import BASE, KEY, PAIRS, million

QUERIES: dict = {}
SQL: dict[str, str] = {}
_W = f"WITH {BASE}"
_REL = "'release-' || entity || '-' || period AS document_id"
_PERCENT = "CASE WHEN {n} < 0 THEN '-' ELSE '' END || regexp_replace(printf('%d.%04d', ({t} // 10000)::BIGINT, ({t} % 10000)::BIGINT), '\\.?0+$', '') || '%'"


def _dollars(x: str) -> str:
    n = f"((({x}) + 50000000) // 100000000)"
    return f"('$' || ({n} // 100) || '.' || lpad(({n} % 100)::VARCHAR, 2, '0') || ' million')"


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _large(q: DataFrame) -> DataFrame:
    return star.in_trillions(star.facts_of(q))


def _findings(spark, q: DataFrame, claims: DataFrame) -> DataFrame:
    return rules.derived(parsed(claims, star.metrics(spark)), _large(q)).select("document_id", "rule", "detail")


_TENTHS = "((abs({n})::HUGEINT * 2000 + {d}) // (2 * {d}))"
_GROWN = f"g AS (SELECT *, v2 - was AS d, v2 - was + CASE WHEN k % 3 = 0 THEN was // 1000 ELSE 0 END AS said, (abs(v2 - was)::HUGEINT * 2000000 + was) // (2 * was) AS f FROM p)"
_OFF = f"(CASE WHEN said < 0 THEN -1 ELSE 1 END) * {_TENTHS.format(n='said', d='was')} <> (CASE WHEN d < 0 THEN -1 ELSE 1 END) * {_TENTHS.format(n='d', d='was')}"


@query(f"{_W}, {PAIRS.format(back=4)}, {_GROWN} SELECT entity, period, CASE WHEN {_OFF} THEN 'conflict' ELSE 'traced' END AS verdict, {_PERCENT.format(n='d', t='f')} AS source_value FROM g")
def derived_large(spark, sf):
    """Growth of amounts of up to 10 to the 13th: verdict, and the recomputed figure as shown."""
    q = star.quarters(spark, sf)
    claims = star.growth_claims(q, "revenue_growth_yoy", 4)
    return verify_claims(claims, _large(q), star.metrics(spark)).select("entity", "period", "verdict", "source_value")


@query(f"{_W}, {PAIRS.format(back=4)}, {_GROWN} SELECT {_REL}, 'derived.recomputation_mismatch' AS rule, {_PERCENT.format(n='d', t='f')} AS detail FROM g WHERE {_OFF}")
def growth_rule(spark, sf):
    q = star.quarters(spark, sf)
    return _findings(spark, q, star.growth_claims(q, "revenue_growth_yoy", 4))


@query(f"{_W}, s AS (SELECT *, v2 - v1 AS d, ((v2 - v1)::HUGEINT * 2000000 + v2) // (2 * v2) AS f FROM b) SELECT {_REL}, 'derived.ratio_mismatch' AS rule, {_PERCENT.format(n='d', t='f')} AS detail FROM s")
def ratio_rule(spark, sf):
    """A share claimed as an amount of money: the unit is taken as meant, and it is far off."""
    q = star.quarters(spark, sf)
    return _findings(spark, q, star._claim(q, "release", 4, "return_share", F.lit("$120 billion")))


@query(f"{_W} SELECT {_REL}, 'derived.sum_mismatch' AS rule, '$' || (v2 * 100)::HUGEINT::VARCHAR AS detail FROM b WHERE k % 3 = 0")
def sum_rule(spark, sf):
    q = star.quarters(spark, sf)
    text = F.concat(F.lit("$"), (F.col("v2") * 100 + F.when(F.col("k") % 3 == 0, 1).otherwise(0)).cast("string"))
    return _findings(spark, q, star._claim(q, "release", 4, "revenue_parts", text))


@query(f"{_W} SELECT {_REL}, 'adjusted_revenue' AS metric, 'reg_g.reconciliation_required' AS rule FROM b WHERE k % 2 = 1 AND q = 1")
def reg_g_required(spark, sf):
    """Without the counterpart's facts of first quarters."""
    q = star.quarters(spark, sf)
    facts = star.facts_of(q).filter("NOT (metric = 'kept_revenue' AND period LIKE '%-Q1')")
    found = rules.non_gaap(parsed(star.gaap_claims(q), star.metrics(spark)), facts, star.metrics(spark))
    return found.filter("rule = 'reg_g.reconciliation_required'").select("document_id", "metric", "rule")


@query("SELECT n_name AS ticker, (n_nationkey * 7 + 1)::BIGINT AS cik FROM nation")
def cik_lookup(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    known = n.select(F.lower("n_name").alias("ticker"), (F.col("n_nationkey") * 7 + 1).cast("long").alias("cik_str"))
    return filings.cik_of(known, n.select(F.col("n_name").alias("ticker")))


@query("SELECT o_custkey::VARCHAR AS issuer, 'a' || o_orderkey AS accession, o_orderdate::DATE::VARCHAR AS filed, '' AS reported FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 1")
def earnings_index(spark, sf):
    """Filing indexes with their arrays one level down, and one array missing; releases are of one form with one of the items."""
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    form, items = F.when(F.col("o_orderkey") % 3 == 0, "8-K").otherwise("10-Q"), F.when(F.col("o_orderkey") % 4 == 1, "5.02,12.02").otherwise("9.01, 2.02")
    each = o.select(F.col("o_custkey").cast("string").alias("issuer"), F.struct(F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("a"), "day", items.alias("items"), form.alias("form")).alias("f"))
    listed = each.groupBy("issuer").agg(F.collect_list("f").alias("f"))
    nested = listed.select("issuer", F.struct(F.struct(F.col("f.a").alias("accessionNumber"), F.col("f.day").alias("filingDate"), F.col("f.items").alias("items"), F.col("f.form").alias("form")).alias("recent")).alias("filings"))
    rows = filings.earnings_filings(filings.filing_rows(nested))
    return rows.select("issuer", F.col("accessionNumber").alias("accession"), F.col("filingDate").alias("filed"), F.col("reportDate").alias("reported"))


@query("SELECT o_orderkey::VARCHAR AS accession, 'https://www.sec.gov/' || CASE WHEN o_orderkey % 2 = 0 THEN 'exact' ELSE 'family' END || '.htm' AS url FROM orders WHERE o_orderkey % 5 <> 0")
def exhibit_choice(spark, sf):
    """The exact exhibit's link where the index has one, else the first of its family; other rows are never taken."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    row = lambda kind, href: f"<tr><td><a href='{href}'>x</a></td><td>{kind}</td></tr>"
    page = F.concat(F.lit(row("8-K", "/main.htm")), F.when(F.col("o_orderkey") % 5 != 0, F.lit(row("EX-99.2", "/ix?doc=/family.htm"))).otherwise(""), F.when((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderkey") % 5 != 0), F.lit(row("EX-99.1", "/exact.htm"))).otherwise(""))
    return releases.exhibit_links(o.select(F.col("o_orderkey").cast("string").alias("accession"), F.lit("https://b").alias("base"), page.alias("html")))


@query("SELECT o_orderkey::VARCHAR AS accession, CASE o_orderkey % 3 WHEN 0 THEN 'a-ex991.htm' WHEN 1 THEN 'ex99.pdf' ELSE 'press.htm' END AS name FROM orders")
def exhibit_names(spark, sf):
    """Names with the exhibit's number first, pages before PDF."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    names = F.when(F.col("o_orderkey") % 3 == 0, F.array(*map(F.lit, ("press.htm", "ex99.pdf", "a-ex991.htm")))).when(F.col("o_orderkey") % 3 == 1, F.array(*map(F.lit, ("release.htm", "ex99.pdf", "logo.gif")))).otherwise(F.array(*map(F.lit, ("logo99.gif", "press.htm", "earnings.pdf"))))
    return releases.listed_exhibits(o.select(F.col("o_orderkey").cast("string").alias("accession"), names.alias("names")))


@query("""WITH s AS (SELECT n_name AS issuer, n_nationkey AS n, unnest([1, 2, 3, 4]) AS q FROM nation)
SELECT issuer, 'FY2001-Q' || q AS slot, 'FY2001-Q' || CASE WHEN (n + q) % 3 = 0 AND q > 1 THEN q - 1 ELSE q END AS period, NOT ((n + q) % 3 = 0 AND q > 1) AS assumed
FROM s WHERE NOT (q < 4 AND (n + q + 1) % 3 = 0)""")
def slot_labels(spark, sf):
    """Some slots hold a release of the quarter before; then that quarter's own slot is left out, newest first."""
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_name", "n_nationkey", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("q"))
    before = ((F.col("n_nationkey") + F.col("q")) % 3 == 0) & (F.col("q") > 1)
    word = F.element_at(F.array(*map(F.lit, ("First", "Second", "Third", "Fourth"))), F.col("q") - 1)
    chosen = n.select(F.col("n_name").alias("issuer"), F.concat(F.lit("FY2001-Q"), F.col("q").cast("string")).alias("slot"), F.when(before, F.concat(word, F.lit(" Quarter 2001 Results"))).otherwise("Results").alias("title"), F.concat_ws("/", "n_name", F.col("q").cast("string")).alias("url"), F.lit("x").alias("text"))
    return releases.distinct_slots(releases.label_periods(chosen)).select("issuer", "slot", "period", "assumed")


@query("""SELECT o_orderkey::BIGINT AS id, CASE o_orderkey % 6 WHEN 0 THEN 'FY' || year(o_orderdate) || '-Q2' WHEN 1 THEN 'FY2031-Q4' WHEN 2 THEN 'FY2021-Q3' WHEN 3 THEN 'FY2025-Q1' WHEN 4 THEN NULL ELSE 'FY2024-Q2' END AS period FROM orders""")
def document_periods(spark, sf):
    """A key in the title, a key in the body, words with a year, a fiscal year before any other, neither, an ordinal."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    m, year = F.col("o_orderkey") % 6, F.year("o_orderdate").cast("string")
    title = F.when(m == 0, F.concat(F.lit("Notes fy"), year, F.lit("-q2 on FY2031-Q4"))).when(m == 2, F.lit("Third quarter")).when(m == 3, "Fiscal 2025").when(m == 4, F.concat(F.lit("Year "), year)).when(m == 5, "Results 2024")
    body = F.when(m == 1, "about FY2031-Q4 and the first quarter of 2020").when(m == 2, "of FY 2021 after 2040").when(m == 3, "written in 2030 on the first and the second quarter").when(m == 5, "of the 2nd")
    return o.select(F.col("o_orderkey").cast("long").alias("id"), P.infer_document_period(title, body).alias("period"))


@query(f"""WITH {BASE} SELECT entity, period, CASE k % 6 WHEN 0 THEN 'FY' || y || '-Q' || q WHEN 1 THEN 'FY' || y WHEN 2 THEN 'FY' || y || CASE WHEN q <= 2 THEN '-H1' ELSE '-H2' END
WHEN 3 THEN 'FY' || y || '-9M' WHEN 4 THEN 'FY' || y ELSE NULL END AS got, {KEY.format(t='t - 1')} AS before, (make_date(y, q * 3, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY + INTERVAL 5 DAY)::DATE::VARCHAR AS first, (make_date(y, q * 3, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY + INTERVAL 95 DAY)::DATE::VARCHAR AS last,
{KEY.format(t='t')} || ' ' || {KEY.format(t='t - 1')} || ' ' || {KEY.format(t='t - 2')} AS back FROM b""")
def period_shapes(spark, sf):
    """Reported spans of a quarter's end: framed, a framed year, half a year, nine months, a year, and two months (no key); the quarter's window, and the quarters back from it."""
    q = star.quarters(spark, sf)
    m, end = F.col("k") % 6, F.last_day(F.make_date(F.col("y"), F.col("q") * 3, F.lit(1)))
    frame = F.when(m == 0, F.concat(F.lit("CY"), F.col("y").cast("string"), F.lit("Q"), F.col("q").cast("string"), F.lit("I"))).when(m == 1, F.concat(F.lit("CY"), F.col("y").cast("string")))
    months = F.element_at(F.array(*map(F.lit, (3, 12, 6, 9, 12, 2))), (m + 1).cast("int"))
    start = F.date_add(F.add_months(end, -months), 1)
    window = P.reporting_window(F.col("y"), F.col("q"))
    return q.select("entity", "period", P.occurrence_period(frame, start.cast("string"), end.cast("string")).alias("got"), P.previous_calendar_quarter(end).alias("before"), window["first"].cast("string").alias("first"), window["last"].cast("string").alias("last"), F.array_join(P.quarters_back(F.col("y"), F.col("q"), 3), " ").alias("back"))


@query(f"{_W}, r AS (SELECT count(*) AS n, count(*) FILTER (WHERE nk % 5 = 0) AS g FROM b) SELECT unnest(['adjusted_revenue', 'kept_revenue', 'return_level', 'returned_revenue', 'revenue_guidance', 'total_revenue']) AS metric, unnest([n, n, n, n, g, 2 * n])::BIGINT AS facts FROM r")
def facts_added(spark, sf):
    """One metric's facts added to a store of the others, ids held apart."""
    f = star.facts(spark, sf)
    return FA.add_facts(f.filter("metric <> 'kept_revenue'"), f.filter("metric = 'kept_revenue'")).groupBy("metric").agg(F.count(F.lit(1)).alias("facts"))


@query(f"{_W} SELECT DISTINCT entity, CASE WHEN nk % 5 = 0 THEN 'adjusted_revenue kept_revenue return_level returned_revenue revenue_guidance total_revenue' ELSE 'adjusted_revenue kept_revenue return_level returned_revenue total_revenue' END AS metrics FROM b")
def metrics_reported(spark, sf):
    return FA.reported_metrics(star.facts(spark, sf)).select("entity", F.array_join("metrics", " ").alias("metrics"))


@query(f"{_W} SELECT {_REL}, 'release-' || entity || '-' || period || '-c1' AS claim_id, 40::INT AS start, 52::INT AS \"end\", CASE WHEN k % 2 = 0 THEN 'traced' ELSE 'untraced' END AS verdict FROM b")
def highlight_spans(spark, sf):
    """Claims of which the second begins inside of the first; odd ones have no verdict."""
    q = star.quarters(spark, sf)
    claims = star._claim(q, "release", 1, "total_revenue", F.lit("$5"))
    second = claims.withColumn("claim_id", F.concat("claim_id", F.lit("b"))).withColumn("span", F.struct((F.col("span.start") + 5).alias("start"), (F.col("span.end") + 5).alias("end")))
    verdicts = star._claim(q.filter("k % 2 = 0"), "release", 1, "total_revenue", F.lit("$5")).select("tenant_id", "document_id", "claim_id", F.lit("traced").alias("verdict"))
    return pack.highlights(claims.unionByName(second), verdicts).drop("tenant_id")


@query(f"""{_W}, m AS (SELECT *, 'release-' || entity || '-' || period AS d, k % 7 AS m FROM b),
t AS (SELECT *, CASE m WHEN 1 THEN '$' || (v2 + 5000000) // 10000000 || ' thousand' WHEN 2 THEN {_dollars('v1')} WHEN 3 THEN {_dollars('v2 + 100000000')} WHEN 4 THEN {_dollars('v2')} || ' to ' || {_dollars('v2 + 200000000')} ELSE {_dollars('v2')} END AS text,
  CASE WHEN m = 5 THEN 'untraced' WHEN m IN (4, 6) THEN 'needs_review' WHEN m IN (0, 1) THEN 'traced' WHEN m = 2 AND {million('v1')} = {million('v2')} THEN 'traced' ELSE 'conflict' END AS verdict FROM m)
SELECT (row_number() OVER (ORDER BY d))::BIGINT - 1 AS seq, '{{"claim_id":"' || d || '-c1","displayed_text":"' || text || '","document_id":"' || d || '","metric":"' || CASE WHEN m = 5 THEN 'unknown_metric' ELSE 'total_revenue' END || '","period":"' || period || '","source_ref":"' || CASE WHEN m = 5 THEN 'none' ELSE 'f#total_revenue' END || '","verdict":"' || verdict || '"}}' AS payload FROM t""")
def audit_verdicts(spark, sf):
    """A chain of all verdicts' events."""
    q = star.quarters(spark, sf)
    v = verify_claims(star.tie_out_claims(q), star.facts_of(q), star.metrics(spark))
    return audit.append(audit.verdict_events(v, "2002-01-01T00:00:00")).select("seq", "payload")


@query(f"{_W} SELECT false AS publishable, (SELECT count(*) FROM b WHERE k % 4 = 0 OR k % 3 = 0)::BIGINT AS across")
def close_pack(spark, sf):
    """All documents of the tenant as one pack: findings across documents stand apart."""
    q = star.quarters(spark, sf)
    _, _, across, packs = pack.verify_close_pack(star.documents(q), star.repeated_claims(q), star.facts_of(q), star.metrics(spark))
    return packs.select("publishable").crossJoin(across.agg(F.count(F.lit(1)).alias("across")))  # one row each


_SHOWN = "'$' || (m // 100) || '.' || lpad((m % 100)::VARCHAR, 2, '0') || ' million'"


@query(f"""{_W}, s AS (SELECT *, (v2 + 50000000) // 100000000 AS m FROM b)
SELECT {_REL}, CASE k % 4 WHEN 0 THEN 'revenue_guidance' WHEN 1 THEN 'eps_guidance' WHEN 2 THEN 'adjusted_eps_guidance' ELSE 'operating_margin_guidance' END AS metric,
CASE k % 4 WHEN 0 THEN 'FY' || CASE WHEN q >= 3 THEN y + 1 ELSE y END || '-Q3' WHEN 1 THEN 'FY2030' WHEN 2 THEN 'FY' || y ELSE {KEY.format(t='t + 1')} END AS period,
CASE k % 4 WHEN 0 THEN '$' || k || ' to $9.5 billion' WHEN 3 THEN '22% to 24%' ELSE '$1.15 to $1.20' END AS displayed_text, 'high' AS detect_confidence FROM s""")
def outlook_claims(spark, sf):
    """Ranges of an outlook: revenue for a named quarter, EPS for a stated year, adjusted EPS for the full year, a margin for the next quarter."""
    q = star.quarters(spark, sf)
    m = F.col("k") % 4
    text = (
        F.when(m == 0, F.concat(F.lit("For the third quarter we look for revenue in the range of $"), F.col("k").cast("string"), F.lit(" to $9.5 billion.")))
        .when(m == 1, "In fiscal year 2030 the outlook is for EPS of $1.15 to $1.20, we think.")
        .when(m == 2, "Full-year guidance: adjusted EPS of $1.15 to $1.20.")
        .otherwise("Management anticipates an operating margin of 22% to 24%.")
    )
    docs = q.select(F.lit(star.TENANT).alias("tenant_id"), F.concat_ws("-", F.lit("release"), "entity", "period").alias("document_id"), "entity", "period", text.alias("text"))
    return extract_claims(docs, star.facts_of(q)).select("document_id", "metric", "period", "displayed_text", "detect_confidence")


@query(f"""{_W}, s AS (SELECT *, (v2 + 50000000) // 100000000 AS m FROM b), d AS (SELECT {_REL}, s.* FROM s)
SELECT document_id, 'total_revenue' AS metric, {_SHOWN} AS displayed_text, 'high' AS detect_confidence FROM d
UNION ALL SELECT document_id, CASE WHEN k % 4 IN (0, 1) THEN 'revenue_growth_yoy' ELSE 'unidentified' END, CASE WHEN k % 4 = 1 THEN '-4.5%' ELSE '4.5%' END, CASE WHEN k % 4 IN (0, 1) THEN 'high' ELSE 'low' END FROM d
UNION ALL SELECT document_id, 'operating_cash_flow', '$7 million', 'high' FROM d""")
def growth_attached(spark, sf):
    """A rate without a label goes to the amount of its sentence, with its sign; not on another basis, and not from another sentence."""
    q = star.quarters(spark, sf)
    m = F.col("k") % 4
    tail = F.when(m == 0, ", up 4.5% year over year.").when(m == 1, ", a decline of 4.5%.").when(m == 2, ", up 4.5% sequentially.").otherwise(". Things went up 4.5%.")
    text = F.concat(F.lit("Total revenue was "), star.millions(F.col("v2")), tail, F.lit(" Operating cash flow: $7 million."))
    docs = q.select(F.lit(star.TENANT).alias("tenant_id"), F.concat_ws("-", F.lit("release"), "entity", "period").alias("document_id"), "entity", "period", text.alias("text"))
    return extract_claims(docs, star.facts_of(q)).select("document_id", "metric", "displayed_text", "detect_confidence")


@query("SELECT o_orderkey::BIGINT AS id, CASE o_orderkey % 3 WHEN 0 THEN 'X' || o_orderkey || ' Reports Results' WHEN 1 THEN 'Line ' || o_orderkey ELSE '(empty document)' END AS title FROM orders")
def release_titles(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    m, key = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    text = F.when(m == 0, F.concat(F.lit("Contact\n X"), key, F.lit(" Reports Results \nend"))).when(m == 1, F.concat(F.lit("\n \n  Line "), key, F.lit("\nmore"))).otherwise(" \n")
    return o.select(F.col("o_orderkey").cast("long").alias("id"), releases.release_title(text).alias("title"))


@query("SELECT o_orderkey::BIGINT AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(o_orderkey::VARCHAR, 10, '0') || '01000007/' || lpad(o_orderkey::VARCHAR, 10, '0') || '-01-000007-index.htm' END AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'T' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'Name' ELSE 'unknown' END AS issuer FROM orders")
def filing_links(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    accession = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.when(F.col("o_orderkey") % 2 == 0, "-01-000007").otherwise("-1-7"))
    m = F.col("o_orderkey") % 3
    tickers = F.when(m == 0, F.array(F.concat(F.lit("T"), F.col("o_custkey").cast("string")), F.lit("U"))).otherwise(F.array().cast("array<string>"))
    return o.select(F.col("o_orderkey").cast("long").alias("id"), filings.filing_url(F.col("o_custkey"), accession).alias("url"), filings.issuer_label(tickers, F.when(m == 1, "Name")).alias("issuer"))
