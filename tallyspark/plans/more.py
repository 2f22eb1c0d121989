"""Queries of releases, search slots, labels, segments, stores and payloads, each beside the SQL that reckons the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical
from ..operators import facts as FA, ingest, labels, pack
from ..operators.staging import new_folder, settled
from ..operators.store import FactStore, Verdicts
from ..operators.verify import verify_claims
from ..sources import filings, guidance, payloads as P, releases, search, sink, vocabulary as V
from . import star
from .base import BASE, KEY, million

QUERIES: dict = {}
SQL: dict[str, str] = {}
_W = f"WITH {BASE}"


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _read(spark, sf, table) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@query(f"{_W} SELECT entity, period, CASE WHEN k % 2 = 0 THEN 'needs_review' ELSE 'conflict' END AS verdict FROM b")
def figures_too_large(spark, sf):
    """A figure beyond what a decimal holds is no figure; one just within it is compared."""
    q = star.quarters(spark, sf)
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit("$9"), F.lpad(F.col("k").cast("string"), 12, "0"), F.lit(" trillion"))).otherwise("$9,999,999,999 trillion")
    return verify_claims(star._claim(q, "release", 1, "total_revenue", text), star.facts(spark, sf), star.metrics(spark)).select("entity", "period", "verdict")


_HELD = "STRUCT(key VARCHAR, acc VARCHAR, d VARCHAR, stated BOOLEAN, n BIGINT, notes VARCHAR[])[]"
_NOTE = "key || ' also claimed by ' || {0}.acc || ' (filed ' || {0}.d || ', ' || {0}.n || ' figures) — kept this release'"


@query(f"""WITH RECURSIVE o AS (SELECT o_custkey::VARCHAR AS issuer, 'a' || o_orderkey AS acc, (o_orderdate + INTERVAL 120 MONTH)::DATE AS day, o_orderkey AS id FROM orders),
f AS (SELECT *, day::VARCHAR AS d, 'FY' || year(day) || '-Q' || quarter(day) AS key, id % 2 = 0 AS stated, (id % 5)::BIGINT AS n, id % 7 <> 0 AS located, CASE WHEN id % 5 = 0 THEN ['no figures detected in text'] ELSE [] END AS own,
        row_number() OVER (PARTITION BY issuer ORDER BY day DESC, id DESC) AS i FROM o),
w AS (SELECT issuer, 0::BIGINT AS i, []::{_HELD} AS held, []::VARCHAR[] AS missing, false AS done FROM (SELECT DISTINCT issuer FROM f)
UNION ALL SELECT w.issuer, f.i,
  CASE WHEN NOT located THEN held
    WHEN list_contains(list_transform(held, lambda h: h.key), f.key) THEN list_transform(held, lambda h: CASE WHEN h.key <> f.key THEN h
      WHEN (f.stated AND NOT h.stated) OR (f.stated = h.stated AND f.n > h.n) THEN {{'key': f.key, 'acc': f.acc, 'd': f.d, 'stated': f.stated, 'n': f.n, 'notes': list_append(f.own, f.{_NOTE.format('h')})}}
      ELSE {{'key': h.key, 'acc': h.acc, 'd': h.d, 'stated': h.stated, 'n': h.n, 'notes': list_append(h.notes, h.{_NOTE.format('f')})}} END)
    WHEN len(held) < 4 THEN list_append(held, {{'key': f.key, 'acc': f.acc, 'd': f.d, 'stated': f.stated, 'n': f.n, 'notes': f.own}})
    WHEN f.stated AND list_contains(list_transform(held, lambda h: h.stated), false)
      THEN list_append(list_filter(held, lambda h, j: j <> list_position(list_transform(held, lambda x: x.stated), false)), {{'key': f.key, 'acc': f.acc, 'd': f.d, 'stated': f.stated, 'n': f.n, 'notes': f.own}})
    ELSE held END,
  CASE WHEN located THEN missing ELSE list_append(missing, f.acc || ': no EX-99.1 located in the filing index') END,
  located AND len(held) >= 4 AND NOT list_contains(list_transform(held, lambda h: h.key), f.key) AND NOT (f.stated AND list_contains(list_transform(held, lambda h: h.stated), false))
FROM w JOIN f ON f.issuer = w.issuer AND f.i = w.i + 1 WHERE NOT done),
e AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY i DESC) = 1),
r AS (SELECT issuer, string_agg(h.key || '=' || h.acc, ' ' ORDER BY h.d DESC, h.acc DESC) AS kept, string_agg(array_to_string(h.notes, '; '), ' | ' ORDER BY h.d DESC, h.acc DESC) AS notes FROM (SELECT issuer, unnest(held) AS h FROM e) GROUP BY issuer)
SELECT e.issuer, len(held)::INT AS fetched, coalesce(kept, '') AS kept, coalesce(notes, '') AS notes,
  array_to_string(CASE WHEN len(held) < 4 THEN list_append(missing, 'index satisfied only ' || len(held) || ' of 4 requested quarters') ELSE missing END, '; ') AS missing FROM e LEFT JOIN r ON r.issuer = e.issuer""")
def release_report(spark, sf):
    """Four quarters of every issuer from a recent block and two archive pages: with exhibits not found, releases without figures, and shortfalls."""
    o = _read(spark, sf, "orders").withColumn("d", F.add_months(F.to_date("o_orderdate"), 120))
    key = F.col("o_orderkey")
    word = F.element_at(F.array(*map(F.lit, ("First", "Second", "Third", "Fourth"))), F.quarter("d"))
    text = F.concat(F.when(key % 2 == 0, F.concat(F.lit("Reports "), word, F.lit(" Quarter "), F.year("d").cast("string"), F.lit(" Results."))).otherwise("Update."), F.repeat(F.lit(" $5 million;"), (key % 5).cast("int")))
    day = F.date_format("d", "yyyy-MM-dd")
    f = o.select(F.col("o_custkey").cast("string").alias("issuer"), (-(F.unix_date("d").cast("long") * 100_000_000_000 + key)).alias("pos"), F.concat(F.lit("a"), key.cast("string")).alias("accession"), day.alias("filing_date"), day.alias("report_date"), (key % 7 != 0).alias("located"), text.alias("text"))
    pages = f.filter("filing_date < '2009-01-01'").withColumn("filing_to", F.when(F.col("filing_date") < "2007-01-01", "2006-12-31").otherwise("2008-12-31"))
    out = releases.walk_quarters(f.filter("filing_date >= '2009-01-01'"), pages, 4)
    each = lambda body, sep: F.array_join(F.transform("releases", body), sep)
    return out.select("issuer", "fetched", each(lambda r: F.concat(r["key"], F.lit("="), r["accession"]), " ").alias("kept"), each(lambda r: F.array_join(r["warnings"], "; "), " | ").alias("notes"), F.array_join("missing", "; ").alias("missing"))


@query("""WITH RECURSIVE s AS (SELECT 'C' || c AS issuer, i AS nth, (8003 - i) // 4 AS y, (8003 - i) % 4 + 1 AS q FROM range(50) r(c), range(6) t(i)),
w AS (SELECT *, 'FY' || y || '-Q' || q AS slot, last_day(make_date(y::INT, (q * 3)::INT, 1)) + 5 AS first, last_day(make_date(y::INT, (q * 3)::INT, 1)) + 95 AS last FROM s),
r AS (SELECT 'C' || (o_custkey % 50) AS issuer, o_orderkey AS pos, o_orderdate::DATE AS day, o_orderkey % 8 AS t, CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank,
  'https://' || CASE o_orderkey % 6 WHEN 0 THEN 'www.sec.gov' WHEN 1 THEN 's1.q4cdn.com' WHEN 2 THEN 'www.prnewswire.com' ELSE 'businesswire.com' END || '/' || o_orderkey AS url,
  CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_orderkey % 17 END AS n FROM orders WHERE o_orderkey % 6 < 4),
m AS (SELECT r.*, w.nth, w.slot, w.y FROM r JOIN w ON r.issuer = w.issuer AND day BETWEEN first AND last QUALIFY row_number() OVER (PARTITION BY r.issuer, nth ORDER BY pos) <= 5),
c AS (SELECT issuer, nth, count(*) AS n, count(*) FILTER (WHERE t = 0) AS adv, count(*) FILTER (WHERE t > 2) AS titled, arg_min(pos, (rank, -n, pos)) FILTER (WHERE t > 2 AND n >= 8) AS pos FROM m GROUP BY ALL),
f AS (SELECT w.issuer, w.nth, w.slot, c.n, adv, titled, c.pos, r.url, CASE WHEN c.pos % 8 = 3 THEN 'FY2000-Q3' ELSE w.slot END AS period FROM w LEFT JOIN c ON c.issuer = w.issuer AND c.nth = w.nth LEFT JOIN r ON r.pos = c.pos),
g AS (SELECT issuer, -1::BIGINT AS nth, []::VARCHAR[] AS taken, NULL::VARCHAR AS slot, NULL::VARCHAR AS got, NULL::VARCHAR AS reason FROM (SELECT DISTINCT issuer FROM w)
UNION ALL SELECT g.issuer, f.nth, CASE WHEN f.pos IS NULL OR list_contains(taken, f.period) OR list_contains(taken, url) THEN taken ELSE list_concat(taken, [f.period, url]) END, f.slot,
  CASE WHEN f.pos IS NOT NULL AND NOT list_contains(taken, f.period) AND NOT list_contains(taken, url) THEN f.period || ' ' || url END,
  CASE WHEN f.n IS NULL THEN 'no results' WHEN titled = 0 THEN 'no result titled as a quarterly results release (' || f.n || ' results, ' || adv || ' advisories rejected)'
    WHEN f.pos IS NULL THEN titled || ' title-matched result(s) but none contained figures — likely shell pages or truncated text'
    WHEN list_contains(taken, f.period) OR list_contains(taken, url) THEN 'best result resolves to ' || f.period || ' (' || url || '), already fetched' END
FROM g JOIN f ON f.issuer = g.issuer AND f.nth = g.nth + 1)
SELECT issuer, slot, got, reason FROM g WHERE nth >= 0""")
def slot_search(spark, sf):
    """The releases of six quarters of fifty companies from a table of search results: windows, domains, five results, long texts, advisories, quarters already taken."""
    o = _read(spark, sf, "orders")
    key = F.col("o_orderkey")
    host = F.element_at(F.array(*map(F.lit, ("www.sec.gov", "s1.q4cdn.com", "www.prnewswire.com", "businesswire.com", "notsec.gov.example.com", "ir.example.com/sec.gov"))), (key % 6 + 1).cast("int"))
    m = key % 8
    title = F.when(m == 0, "X to announce third quarter results").when(m == 1, "Newsletter").when(m == 2, "X reports first quarter 2010 results").when(m == 3, "X Third Quarter 2000 Results").otherwise("X reports its quarter: earnings")
    text = F.concat(F.when(key % 97 == 0, F.repeat(F.lit("x "), 100_000)).otherwise(""), F.repeat(F.lit("up 5% "), (key % 17).cast("int")))
    r = o.select(F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string")).alias("issuer"), key.alias("pos"), title.alias("title"), F.concat(F.lit("https://"), host, F.lit("/"), key.cast("string")).alias("url"), text.alias("text"), F.col("o_orderdate").cast("timestamp").alias("published"))
    slots = search.slot_windows(spark.range(50).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("issuer"), F.lit(2000).alias("year"), F.lit(4).alias("quarter")), 6)
    return search.choose_slots(slots, search.slot_results(slots, r)).select("issuer", "slot", F.when(F.col("period").isNotNull(), F.concat_ws(" ", "period", "url")).alias("got"), "reason")


_REL = "'release-' || entity || '-' || period AS document_id"


@query(f"""{_W}, t AS (SELECT {_REL}, k, unnest(CASE k % 5 WHEN 0 THEN [['$' || k || ' million', 'total_revenue'], ['$2 million', 'operating_cash_flow']]
  WHEN 1 THEN [['$' || k || ' million', 'operating_cash_flow'], ['$8 million', 'net_income']]
  WHEN 2 THEN [['$' || k, 'cash_and_equivalents'], ['7.5%', 'operating_margin']]
  WHEN 3 THEN [['$' || k, NULL], ['4%', NULL]]
  ELSE [['$' || k || ' billion', 'capex'], ['$9 billion', 'cost_of_revenue']] END) AS p FROM b)
SELECT document_id, p[1] AS figure, p[2] AS metric FROM t""")
def label_join(spark, sf):
    """Labels before and behind, one that belongs to the figure before it, one beyond a clause, lines with colons, and figures with none in reach."""
    q = star.quarters(spark, sf)
    m, k = F.col("k") % 5, F.col("k").cast("string")
    text = (
        F.when(m == 0, F.concat(F.lit("Total revenue was $"), k, F.lit(" million, and operating cash flow came to $2 million.")))
        .when(m == 1, F.concat(F.lit("There was $"), k, F.lit(" million of operating cash flow and then net income of $8 million")))
        .when(m == 2, F.concat(F.lit("Total revenue\nCash and cash equivalents: $"), k, F.lit("\nIn the year 7.5% of operating margin")))
        .when(m == 3, F.concat(F.lit("Something at $"), k, F.lit("; total revenue was good. "), F.lit("Nothing else is said here for a long while, so that what was said is out of reach: 4% of it")))
        .otherwise(F.concat(F.lit("Capital expenditures of $"), k, F.lit(" billion, while cost of revenue was $9 billion")))
    )
    docs = q.select(F.lit(star.TENANT).alias("tenant_id"), F.concat_ws("-", F.lit("release"), "entity", "period").alias("document_id"), text.alias("text"))
    return labels.nearest_labels(docs, labels.phrases_of(star.metrics(spark), V.aliases_table(spark))).select("document_id", "figure", "metric")


@query("""WITH s AS (SELECT DISTINCT n_name AS entity, lower(c_mktsegment) AS keyword FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT o_orderkey AS id, n_name AS tenant, lower('About ' || c_mktsegment || ' and ' || CASE o_orderkey % 4 WHEN 0 THEN 'automobiles, ' WHEN 1 THEN 'a machine ' WHEN 2 THEN 'refurniture' ELSE 'the house' END || o_orderkey) AS low
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT id, tenant, string_agg(keyword, ' ' ORDER BY keyword) AS named FROM d JOIN s ON s.entity = d.tenant AND contains(low, keyword) GROUP BY ALL""")
def segments_named(spark, sf):
    """Every nation a tenant, its market segments the keywords: those that lie in the text of each order, also inside of longer words."""
    q = star.quarters(spark, sf, segments=True)
    f = q.select(F.col("entity").alias("tenant_id"), F.concat_ws(":", "entity", "c_mktsegment").alias("entity"), F.col("k").alias("ingest_seq"))
    known = FA.segment_keywords(f)
    o = _read(spark, sf, "orders").join(_read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    tail = F.element_at(F.array(*map(F.lit, ("automobiles, ", "a machine ", "refurniture", "the house"))), (key % 4 + 1).cast("int"))
    text = F.concat(F.lit("About "), F.col("c_mktsegment"), F.lit(" and "), tail, key.cast("string"))
    texts = o.select(F.col("n_name").alias("tenant_id"), key.cast("string").alias("document_id"), F.lower(text).alias("low"))
    named = labels.named_keywords(texts, known)
    return named.groupBy(F.col("document_id").cast("long").alias("id"), F.col("tenant_id").alias("tenant")).agg(F.array_join(F.array_sort(F.collect_list("keyword")), " ").alias("named"))  # a tenant has few


def _overlays(spark, sf) -> DataFrame:
    """Phrases of a tenant for each customer: of three known metrics and one that there isn't; some with spaces and capitals, some that are there already, some empty."""
    c = _read(spark, sf, "customer").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("tenant_id"), (F.col("c_custkey") % 6).alias("m"), F.col("c_custkey").cast("string").alias("key"))
    metric = F.element_at(F.array(*map(F.lit, ("net_income", "gross_profit", "total_revenue", "no_such_metric"))), (F.col("m") % 4 + 1).cast("int"))
    phrases = F.array(F.concat(F.lit("  Own"), F.col("key"), F.lit(" Words ")), F.lit("Ink Turnover"), F.lit("own"), F.when(F.col("m") % 2 == 0, " ").otherwise("Total Revenue"))
    return c.select("tenant_id", metric.alias("metric"), F.posexplode(phrases).alias("pos", "phrase"))


def _default(spark) -> DataFrame:
    rows = [(m, i, p) for m, ps in V.default_aliases().items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "metric string, pos int, phrase string")


def _lists_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(m)}, [{', '.join(map(quoted, ps))}])" for m, ps in V.default_aliases().items())


@query(f"""WITH d(metric, p) AS (VALUES {_lists_sql()}), c AS (SELECT 'T' || c_custkey AS tenant_id, c_custkey, c_custkey % 6 AS m FROM customer),
o AS (SELECT tenant_id, ['net_income', 'gross_profit', 'total_revenue', 'no_such_metric'][m % 4 + 1] AS metric, ['own' || c_custkey || ' words', 'ink turnover', 'own'] || CASE WHEN m % 2 = 0 THEN [] ELSE ['total revenue'] END AS p FROM c)
SELECT tenant_id, o.metric, array_to_string(coalesce(d.p, []) || list_filter(o.p, lambda x: NOT list_contains(coalesce(d.p, []), x)), '|') AS phrases FROM o LEFT JOIN d ON d.metric = o.metric WHERE o.metric <> 'no_such_metric'
UNION ALL SELECT NULL, metric, array_to_string(p, '|') FROM d UNION ALL SELECT tenant_id, metric, NULL FROM o WHERE metric = 'no_such_metric'""")
def overlay_lists(spark, sf):
    """Phrase lists of a tenant for each customer beside the default ones, and the ids that no metric has."""
    over, known = _overlays(spark, sf), V.metrics_table(spark)
    lists = V.overlaid_phrases(_default(spark), over, known).select("tenant_id", "metric", F.array_join("phrases", "|").alias("phrases"))
    return lists.unionByName(V.unknown_metrics(over, known).withColumn("phrases", F.lit(None).cast("string")))


@query("""WITH c AS (SELECT 'T' || c_custkey AS tenant_id, c_custkey % 6 AS m FROM customer), s AS (SELECT *, unnest(['$5', '$6', '$7']) AS figure FROM c)
SELECT tenant_id, figure, CASE figure WHEN '$5' THEN CASE m % 4 WHEN 0 THEN 'net_income' WHEN 1 THEN 'gross_profit' WHEN 2 THEN 'total_revenue' END WHEN '$6' THEN 'total_revenue' END AS metric FROM s""")
def tenant_labels(spark, sf):
    """A tenant for each customer: its own phrases name figures of its own documents alone, all in one plan."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("Ink turnover$5. Then, in total revenue, $6. What follows is told at some length, so that no label of what came before is still in reach. And for Own0"), key, F.lit(" words $7."))
    docs = _read(spark, sf, "customer").select(F.concat(F.lit("T"), key).alias("tenant_id"), key.alias("document_id"), text.alias("text"))
    m = V.metrics_table(spark)
    own = _overlays(spark, sf).filter("pos < 2").withColumn("phrase", F.lower(F.trim("phrase"))).join(m.select(F.col("id").alias("metric"), "unit", F.col("position").cast("int").alias("place")), "metric")
    found = labels.nearest_labels(docs, labels.phrases_of(m, V.aliases_table(spark)), own.select("tenant_id", "phrase", "metric", "unit", "place"))
    return found.select("tenant_id", "figure", "metric")


@query(f"""{_W}, c AS (SELECT *, k % 3 AS m FROM b), v AS (SELECT entity, period, CASE m WHEN 0 THEN 'traced' WHEN 1 THEN CASE WHEN ({million('v1')}) = ({million('v2')}) THEN 'traced' ELSE 'conflict' END ELSE 'conflict' END AS verdict, v1, v2, m, k FROM c)
SELECT entity, period, verdict, CASE WHEN verdict = 'traced' THEN 'matches the filed source' WHEN m = 1 THEN 'superseded: the source was restated' WHEN ({million('v2 + 100000000')}) = ({million('v1')}) THEN 'superseded: the source was restated' ELSE 'differs from the filed source' END AS reason FROM v""")
def store_verdicts(spark, sf):
    """Verdicts against a kept store that was filled by three batches, of which one comes twice and one is late."""
    q = star.quarters(spark, sf)
    facts = settled(star.facts_of(q), "facts")
    store = FactStore(spark)
    for batch in ("metric = 'total_revenue' AND ingest_seq = 0", "metric <> 'total_revenue'", "metric <> 'total_revenue'", "metric = 'total_revenue' AND ingest_seq = 1"):
        store.add(facts.filter(batch))
    m = F.col("k") % 3
    claims = star._claim(q, "release", 1, "total_revenue", star.millions(F.when(m == 0, F.col("v2")).when(m == 1, F.col("v1")).otherwise(F.col("v2") + 100_000_000)))
    out = settled(store.verify(claims, star.metrics(spark)).select("entity", "period", "verdict", "reason"), "verdicts")
    store.drop()
    return out


@query(f"""{_W}, v AS (SELECT entity, period, ({million('v1')}) = ({million('v2')}) AS same, nk FROM b),
g AS (SELECT b.entity, b.period, b.nk, (b.v1 - w.v1) AS d1, w.v1 AS w1, (b.v2 - w.v2) AS d2, w.v2 AS w2 FROM b JOIN b w ON w.entity = b.entity AND w.t = b.t - 4),
a AS (SELECT entity, period, 'amount' AS kind, nk % 2 = 0 AS late, CASE WHEN nk % 2 = 1 OR same THEN 'traced' ELSE 'conflict' END AS verdict FROM v),
r AS (SELECT entity, period, 'growth' AS kind, nk % 2 = 0 AS late, CASE WHEN nk % 2 = 1 THEN 'traced'
  WHEN (CASE WHEN d1 < 0 THEN -1 ELSE 1 END) * ((abs(d1)::HUGEINT * 2000 + w1) // (2 * w1)) = (CASE WHEN d2 < 0 THEN -1 ELSE 1 END) * ((abs(d2)::HUGEINT * 2000 + w2) // (2 * w2)) THEN 'traced' ELSE 'conflict' END AS verdict FROM g)
SELECT * FROM a UNION ALL SELECT * FROM r""")
def late_verdicts(spark, sf):
    """Amounts and growth verified against first versions; restatements of every other nation come late and turn what reads them: its own scope, or an operand's."""
    q = star.quarters(spark, sf)
    facts = settled(star.facts_of(q).filter("metric = 'total_revenue'"), "facts")
    first = q.withColumn("v2", F.col("v1"))  # claims of what was filed first
    pair = star.pairs(first, 4)
    grown = star._claim(pair, "release", 2, "revenue_growth_yoy", F.concat(star.tenth(F.col("v2") - F.col("was"), F.col("was")), F.lit("%")))
    claims = star._claim(q, "release", 1, "total_revenue", star.millions(F.col("v1"))).unionByName(grown)
    store = FactStore(spark)
    kept = Verdicts(store, star.metrics(spark))
    kept.add_claims(claims)
    kept.add_facts(facts.filter("ingest_seq = 0"))
    even = _read(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("entity"))
    again = kept.add_facts(facts.filter("ingest_seq = 1").join(even, "entity", "left_semi").select(*facts.columns)).select("claim_id", F.lit(True).alias("again"))
    kind = F.when(F.col("metric") == "total_revenue", "amount").otherwise("growth")
    out = settled(kept.verdicts.join(again, "claim_id", "left").select("entity", "period", kind.alias("kind"), F.coalesce("again", F.lit(False)).alias("late"), "verdict"), "late")
    store.drop()
    return out


@query(f"""{_W}, n AS (SELECT *, max(t) OVER (PARTITION BY entity) AS newest FROM b WHERE y * 4 + q <= 8007 - nk % 4), f AS (SELECT * FROM n WHERE t > newest - 8)
SELECT entity, 'total_revenue' AS what, period, v1 AS amount, '2002-01-01' AS as_of FROM f UNION ALL SELECT entity, 'total_revenue', period, v2, '2002-06-01' FROM f WHERE v1 <> v2
UNION ALL SELECT DISTINCT entity, 'skipped: Concept' || nk || ' Revenues[EUR]', NULL, NULL, NULL FROM b UNION ALL SELECT DISTINCT '', 'shape: Odd', NULL, NULL, NULL FROM b WHERE nk % 3 = 0 UNION ALL SELECT '', 'corrupt: ' || count(DISTINCT nk), NULL, NULL, NULL FROM b""")
def feed_payloads(spark, sf):
    """Feeds read from text: a payload a line, with a concept of a name of its own in each, a unit that isn't read, a concept of another shape, and as many lines that are no JSON."""
    q = star.quarters(spark, sf).filter("y * 4 + q <= 8007 - c_nationkey % 4")
    day = F.concat_ws("-", F.col("y").cast("string"), F.lpad((F.col("q") * 3).cast("string"), 2, "0"), F.lit("28"))
    occ = lambda v, filed: F.format_string('{"end":"%s","val":%d,"accn":"%s","form":"10-Q","filed":"%s"}', day, F.col(v), F.lit(filed), F.lit(filed))
    each = q.select("entity", "c_nationkey", F.explode(F.array(occ("v1", "2002-01-01"), occ("v2", "2002-06-01"))).alias("o")).groupBy("entity", "c_nationkey").agg(F.array_join(F.collect_list("o"), ",").alias("o"))
    odd = F.when(F.col("c_nationkey") % 3 == 0, ',"Odd":{"units":{"USD":7}}').otherwise("")
    text = F.concat(F.lit('{"cik":1,"entityName":"'), F.col("entity"), F.lit('","facts":{"us-gaap":{"Revenues":{"label":"Revenue","units":{"EUR":[],"USD":['), F.col("o"), F.lit(']}},"Concept'), F.col("c_nationkey").cast("string"), F.lit('":{"units":{"USD":[]}}'), odd, F.lit("}}}"))
    folder = new_folder(spark, "feeds")
    each.select(F.explode(F.array(text, F.lit('{"cik": 1, "facts'))).alias("value")).write.text(folder)
    payloads = P.read_payloads(spark, folder, whole=False)
    units, shape = P.feed_units(payloads)
    facts, report = filings.unit_facts(units, V.metrics_table(spark), star.TENANT, 8)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("period", "string"), ("amount", "long"), ("as_of", "string"))]
    out = facts.select("entity", F.col("metric").alias("what"), "period", F.col("value").cast("long").alias("amount"), "as_of")
    out = out.unionByName(report.select("entity", F.concat(F.lit("skipped: "), F.array_join("skipped_tags", " ")).alias("what"), *none))
    out = out.unionByName(shape.select(F.lit("").alias("entity"), F.concat(F.lit("shape: "), F.col("concept")).alias("what"), *none).distinct())
    return out.unionByName(P.corrupt(payloads).agg(F.concat(F.lit("corrupt: "), F.count(F.lit(1)).cast("string")).alias("what")).select(F.lit("").alias("entity"), "what", *none))


@query(f"""{_W} SELECT 'set' || nk AS name, count(*) AS total, count(*) FILTER (WHERE k % 4 <> 3) AS exact, count(*) FILTER (WHERE k % 4 IN (1, 3)) AS flagged, count(*) FILTER (WHERE k % 4 = 3) AS missed FROM b GROUP BY nk""")
def golden_sets(spark, sf):
    """A golden set for each nation, read from text and run: figures that are right, wrong, or labelled wrong."""
    q = star.quarters(spark, sf)
    m = F.col("k") % 4
    shown = star.millions(F.col("v2") + F.when(m.isin(1, 3), 100_000_000).otherwise(0))
    case = F.format_string('{"id":"%s-%s","entity":"%s","metric":"kept_total","period":"%s","text":"%s","expected":"%s"}', "entity", "period", "entity", "period", shown, F.when(m == 1, "conflict").otherwise("traced"))
    sets = q.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(F.replace(case, F.lit("kept_total"), F.lit("total_revenue")))), ", ").alias("cases"))
    text = F.concat(F.lit('{"name": "set'), F.col("c_nationkey").cast("string"), F.lit('", "tenant": "star", "filing_fixture": "f", "cases": ['), F.col("cases"), F.lit("]}"))
    folder = new_folder(spark, "golden")
    sets.select(text.alias("value")).write.text(folder)
    cases = P.case_claims(P.golden_cases(P.read_payloads(spark, folder, whole=False)))
    v = verify_claims(cases, star.facts(spark, sf), star.metrics(spark))
    flag = F.col("verdict") != "traced"
    return v.groupBy(F.substring("document_id", 6, 20).alias("name")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == F.col("expected")).alias("exact"), F.count_if(flag).alias("flagged"), F.count_if(flag & (F.col("expected") == "traced")).alias("missed"))


@query("SELECT 'E' || (o_custkey % 40) || '-' || CASE WHEN o_orderkey % 3 = 0 THEN 'a' || (o_orderkey % 11) ELSE 'FY2001-Q' || (o_orderkey % 4 + 1) END || '.txt' AS name, max_by('text ' || o_orderkey, ('a' || (o_orderkey % 11), 'text ' || o_orderkey)) AS text FROM orders GROUP BY ALL")
def release_files(spark, sf):
    """Releases written to files of their names, and read back."""
    o = _read(spark, sf, "orders")
    key = F.col("o_orderkey")
    r = o.select(F.concat(F.lit("E"), (F.col("o_custkey") % 40).cast("string")).alias("entity"), F.when(key % 3 != 0, F.concat(F.lit("FY2001-Q"), (key % 4 + 1).cast("string"))).alias("period"), F.concat(F.lit("a"), (key % 11).cast("string")).alias("accession"), F.concat(F.lit("text "), key.cast("string")).alias("text"))
    folder = new_folder(spark, "releases")
    sink.write_release_files(r, folder)
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


@query(f"""{_W}, n AS (SELECT entity, count(*) AS n, count(*) FILTER (WHERE k % 4 = 0) AS odd FROM b GROUP BY entity)
SELECT 'star' AS tenant_id, '{{"ingested":' || (n - odd) || ',"skipped":' || odd || ',"skipped_tags":[' || array_to_string(list_transform(range(odd), lambda i: '"x:Unknown"'), ',') || '],"source":"edgar_xbrl:a-' || entity || '"}}' AS payload FROM n""")
def ingest_log(spark, sf):
    """Events of ingested filing instances: what was taken and, tag by tag, what wasn't."""
    q = star.quarters(spark, sf)
    none = [F.lit(None).cast("string").alias(c) for c in ("source_type", "source_ref", "label", "excerpt", "source_url", "as_of", "confidence")]
    item = F.struct(F.when(F.col("k") % 4 == 0, "x:Unknown").otherwise("us-gaap:Revenues").alias("tag"), F.lit(None).cast("string").alias("metric"), F.lit(None).cast("string").alias("entity"), "period", F.col("v2").cast("string").alias("value"), F.lit("USD").alias("unit"), F.lit(-3).alias("decimals"), *none)
    inst = q.groupBy("entity").agg(F.array_sort(F.collect_list(item)).alias("facts")).withColumn("accession", F.concat(F.lit("a-"), F.col("entity")))
    return ingest.ingest_events(filings.instance_facts(inst, V.metrics_table(spark), star.TENANT)[1], "2002-01-01T00:00:00").select("tenant_id", "payload")


@query(f"""{_W}, v AS (SELECT entity, period, 'g-' || entity AS accn, 1 AS i, '2002-01-01' AS filed FROM b UNION ALL SELECT entity, period, 'h-' || entity, 2, '2002-06-01' FROM b WHERE v1 <> v2)
SELECT entity, period, accn || ':' || entity || ':total_revenue:' || period || ':v' || row_number() OVER (PARTITION BY entity ORDER BY period, filed, accn) AS id FROM v""")
def feed_versions(spark, sf):
    """Ids of a feed's facts: the versions that are kept, numbered within a company by metric, period and filing; a value filed again is no version."""
    q = star.quarters(spark, sf)
    day = F.concat_ws("-", F.col("y").cast("string"), F.lpad((F.col("q") * 3).cast("string"), 2, "0"), F.lit("28"))
    occ = lambda v, filed, accn: F.struct(F.lit(None).cast("string").alias("start"), day.alias("end"), F.col(v).cast("string").alias("val"), F.concat(F.lit(accn), F.col("entity")).alias("accn"), F.lit("10-Q").alias("form"), F.lit(filed).alias("filed"), F.lit(None).cast("string").alias("frame"))
    each = q.select("entity", F.explode(F.array(occ("v1", "2002-01-01", "g-"), occ("v2", "2002-06-01", "h-"), occ("v2", "2002-09-01", "i-"))).alias("o")).groupBy("entity").agg(F.collect_list("o").alias("occ"))
    units = each.select(F.lit(1).cast("long").alias("cik"), "entity", F.lit("Revenues").alias("concept"), F.lit("Revenue").alias("label"), F.lit("USD").alias("u"), "occ")
    return filings.unit_facts(units, V.metrics_table(spark), star.TENANT, 1000)[0].select("entity", "period", "id")


@query(f"""{_W} SELECT entity, period, 'guidance_8k:' || entity || '-' || period AS source, 1::BIGINT AS ingested, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS skipped,
CASE WHEN k % 2 = 0 THEN 'We expect to do well.|' ELSE '' END || 'The company also expects revenue of $1 million.|Management anticipates much of what was said before to hold ' AS sentences, {million('v2')}::BIGINT AS amount FROM b""")
def guidance_reports(spark, sf):
    """Of two statements of one scope the first counts; sentences that look ahead but give no fact are reported, cut to sixty characters."""
    q = star.quarters(spark, sf)
    text = F.concat(F.when(F.col("k") % 2 == 0, "We expect to do well. ").otherwise(""), F.lit("For the next period the company expects revenue of "), star.millions(F.col("v2")), F.lit(". The company also expects revenue of $1 million. Management anticipates much of what was said before to hold for all of the year."))
    rel = q.select(F.lit(star.TENANT).alias("tenant_id"), "entity", F.concat_ws("-", "entity", "period").alias("accession"), F.col("period").alias("base_period"), F.lit("2002-01-01").alias("as_of"), F.lit(None).cast("string").alias("label"), text.alias("text"))
    facts, skipped = guidance.guidance_facts(rel)
    facts = settled(facts, "guidance")
    report = ingest.guidance_report(facts, skipped).select("source", "ingested", "skipped", F.array_join("skipped_tags", "|").alias("sentences"))
    amounts = facts.select(F.concat(F.lit("guidance_8k:"), F.split("source_ref", "#")[0]).alias("source"), (F.col("value") * 10000).cast("long").alias("amount"))
    names = q.select(F.concat(F.lit("guidance_8k:"), F.concat_ws("-", "entity", "period")).alias("source"), "entity", "period")
    return report.join(amounts, "source").join(names, "source").select("entity", "period", "source", "ingested", "skipped", "sentences", "amount")


@query(f"""{_W}, i AS (SELECT entity, period, CASE WHEN k % 3 = 0 THEN 'no-such-' || entity || period ELSE '2002-06-01:' || entity || ':total_revenue:' || period END AS id, k, v2 FROM b)
SELECT id, CASE WHEN k % 3 <> 0 THEN v2::BIGINT END AS amount FROM i""")
def fact_lookup(spark, sf):
    """Facts by id among those of one tenant: each id's fact, or none."""
    q = star.quarters(spark, sf)
    ids = q.select(F.when(F.col("k") % 3 == 0, F.concat(F.lit("no-such-"), "entity", "period")).otherwise(F.concat(F.lit("2002-06-01:"), "entity", F.lit(":total_revenue:"), "period")).alias("id"))
    facts = star.facts_of(q)
    every = facts.unionByName(facts.withColumn("tenant_id", F.lit("other")).withColumn("id", F.concat(F.lit("other-"), "id")))
    return FA.facts_by_ids(FA.of_tenant(every, star.TENANT), ids).select("id", (F.col("fact.value") * 10000).cast("long").alias("amount"))


@query(f"""{_W}, c AS (SELECT entity, period, unnest([1, 2, 3]) AS n, k FROM b), s AS (SELECT *, 'release-' || entity || '-' || period AS d, CASE WHEN n = 3 AND k % 2 = 0 THEN NULL WHEN n = 2 THEN 5 ELSE 50 END AS begins FROM c)
SELECT d || '-c' || n AS claim_id, (row_number() OVER (PARTITION BY d ORDER BY coalesce(begins, 0), n))::INT AS place FROM s""")
def claim_order(spark, sf):
    """Claims of a document by place; one without a span counts as at the start, ties go by id."""
    q = star.quarters(spark, sf)
    one = lambda n, at: star._claim(q, "release", n, "total_revenue", F.lit("$1")).join(q.select("entity", "period", "k"), ["entity", "period"]).withColumn("span", F.when(at.isNotNull(), F.struct(at.alias("start"), (at + 1).alias("end")))).drop("k")
    claims = one(1, F.lit(50)).unionByName(one(2, F.lit(5))).unionByName(one(3, F.when(F.col("k") % 2 != 0, 50)))
    return pack.claims_in_order(claims).select("claim_id", "place")


@query(f"""{_W}, p AS (SELECT b.*, w.v2 AS was FROM b LEFT JOIN b w ON w.entity = b.entity AND w.t = b.t - 4)
SELECT {_REL}, unnest(['revenue_parts', 'return_share']) AS metric, unnest(['derived:kept_revenue + returned_revenue', 'derived:returned_revenue / total_revenue']) AS ref FROM p
UNION ALL SELECT {_REL}, 'revenue_growth_yoy', CASE WHEN was IS NOT NULL THEN 'derived:yoy_growth(total_revenue)' END FROM p""")
def derived_sources(spark, sf):
    """What a recomputed figure names as its source: the identity it was recomputed by."""
    q = star.quarters(spark, sf)
    claims = star._claim(q, "release", 1, "revenue_parts", F.lit("$1")).unionByName(star._claim(q, "release", 2, "return_share", F.lit("1%"))).unionByName(star._claim(q, "release", 3, "revenue_growth_yoy", F.lit("1%")))
    return verify_claims(claims, star.facts_of(q), star.metrics(spark)).select("document_id", "metric", F.col("provenance.ref").alias("ref"))


@query(f"""{_W}, g AS (SELECT entity, {KEY.format(t="t + 1")} AS period FROM b WHERE nk % 5 = 0)
SELECT b.entity, b.period, CASE WHEN g.period IS NOT NULL THEN 'source is not filed' ELSE 'no source in the fact store' END AS reason, CASE WHEN g.period IS NOT NULL THEN 'needs_review' ELSE 'untraced' END AS verdict FROM b LEFT JOIN g ON g.entity = b.entity AND g.period = b.period""")
def soft_sources(spark, sf):
    """Claims whose latest source was not filed go to a reader, whatever they say."""
    q = star.quarters(spark, sf)
    return verify_claims(star._claim(q, "release", 1, "revenue_guidance", star.millions(F.col("v2"))), star.facts_of(q), star.metrics(spark)).select("entity", "period", "reason", "verdict")


@query("SELECT o_orderkey::BIGINT AS id, CASE o_orderkey % 3 WHEN 0 THEN '{\"a\":[1,{\"x\":' || o_orderkey || ',\"y\":null}],\"b\":\"\\u00e9' || o_custkey || '\"}' WHEN 1 THEN '[true,' || o_orderkey || '.5,\"\\ud83d\\ude00\"]' END AS canonical FROM orders")
def canonical_payloads(spark, sf):
    """Payloads with keys in any order, spaces, and characters outside ASCII; some are no JSON."""
    o = _read(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = F.when(key % 3 == 0, F.concat(F.lit('{ "b": "é'), cust, F.lit('", "a": [1, {"y": null, "x": '), key.cast("string"), F.lit("}] }"))).when(key % 3 == 1, F.concat(F.lit("[ true, "), key.cast("string"), F.lit('.5, "\U0001f600" ]'))).otherwise("{")
    return canonical(o.select(key.cast("long").alias("id"), text.alias("t")), "id", "t", 3)
