"""Binding ladder, derived figures, rules, guidance, tables, claims, audit and releases on small hand-made input."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import audit, claims as C, facts as FA, pack, rules
from tallyspark.operators.verify import parsed, verify_claims
from tallyspark.sources import documents as D
from tallyspark.sources import guidance, releases
from tallyspark.sources.vocabulary import Metric, aliases_table, default_aliases, default_metrics, extend_aliases, metrics_table

CLAIM = C.CLAIMS


def fact(entity, metric, period, value, as_of="2026-04-28", kind="edgar_xbrl", ref="a#b", unit="currency", seq=0):
    return (f"{entity}{metric}{period}{as_of}", "t", entity, metric, period, Decimal(value), unit, Decimal(0), kind, ref, "l", "e", None, as_of, "high", seq)


@pytest.fixture(scope="module")
def store(spark):
    rows = [
        fact("Q", "total_revenue", "FY2031-Q3", "48230000"), fact("Q", "total_revenue", "FY2030-Q3", "42000000"),
        fact("Q:Cloud", "cloud_growth_yoy", "FY2031-Q3", "7", "2031-10-02", unit="percent", seq=1), fact("Q:Cloud", "cloud_growth_yoy", "FY2031-Q3", "9", "2031-11-03", unit="percent", seq=2),
        fact("Q:Cloud", "cloud_revenue", "FY2031-Q3", "5066000"), fact("Q", "gaap_diluted_eps", "FY2031-Q3", "2.05"), fact("Q", "non_gaap_diluted_eps", "FY2031-Q3", "2.40"),
        fact("Q", "revenue_guidance", "FY2031-Q4", "51000000", kind="management_input", ref="none"), fact("Q", "operating_cash_flow", "FY2031-Q3", "9640000"),
    ]
    return spark.createDataFrame(rows, FA.FACTS)


def claim_rows(spark, rows):
    return spark.createDataFrame([(f"c{i}", "t", "d", e, m, p, x, (i * 30, i * 30 + 5), "high") for i, (e, m, p, x) in enumerate(rows)], CLAIM)


GOLDEN = [
    ("Q", "total_revenue", "FY2031-Q3", "$48.2 million", "traced"), ("Q", "total_revenue", "FY2031-Q3", "$48,230 thousand", "traced"), ("Q", "total_revenue", "FY2031-Q3", "$48.3 million", "conflict"),
    ("Q", "total_revenue", "FY2031-Q3", "$48.2 billion", "conflict"), ("Q", "gaap_diluted_eps", "FY2031-Q3", "$2.05", "traced"), ("Q", "gaap_diluted_eps", "FY2031-Q3", "$2.50", "conflict"),
    ("Q:Cloud", "cloud_revenue", "FY2031-Q3", "$5.07 million", "traced"), ("Q:Cloud", "cloud_revenue", "FY2031-Q3", "$5.06 million", "conflict"), ("Q:Cloud", "cloud_growth_yoy", "FY2031-Q3", "7%", "conflict"),
    ("Q:Cloud", "cloud_growth_yoy", "FY2031-Q3", "9%", "traced"), ("Q", "revenue_guidance", "FY2031-Q4", "$50.5 to $51.5 million", "needs_review"), ("Q", "backlog", "FY2031-Q3", "$12 million", "untraced"),
    ("Q", "revenue_growth_yoy", "FY2031-Q3", "15%", "traced"), ("Q", "revenue_growth_yoy", "FY2031-Q3", "14.8%", "traced"), ("Q", "revenue_growth_yoy", "FY2031-Q3", "14.9%", "conflict"),
    ("Q", "revenue_growth_yoy", "FY2030-Q3", "3%", "untraced"), ("Q", "total_revenue", "FY2031-Q3", "a record", "needs_review"), ("Q", "operating_cash_flow", "FY2031-Q3", "$9.64 million", "traced"),
    ("Q", "operating_cash_flow", "FY2031-Q3", "$10 million", "traced"), ("Q", "non_gaap_diluted_eps", "FY2031-Q3", "240 bps", "conflict"),
]


def test_ladder_and_gate(spark, store):
    c = claim_rows(spark, [g[:4] for g in GOLDEN])
    v = verify_claims(c, store, metrics_table(spark))
    want = spark.createDataFrame([(f"c{i}", g[4]) for i, g in enumerate(GOLDEN)], "claim_id string, expected string")
    rows = {r.claim_id: r for r in v.join(want, "claim_id").collect()}
    assert {k: r.verdict for k, r in rows.items()} == {k: r.expected for k, r in rows.items()}
    assert rows["c8"].reason.startswith("superseded") and rows["c12"].provenance.source_type == "derived" and rows["c0"].source_value == "$48230000" and rows["c12"].source_value == "14.8333%"
    assert pack.eval_passes(pack.eval_report(v.join(want, "claim_id"))).first()[0]


def test_tolerance_and_low_confidence(spark, store):
    c = claim_rows(spark, [("Q", "total_revenue", "FY2031-Q3", "$48.26 million")])
    assert verify_claims(c, store, metrics_table(spark)).first().verdict == "conflict"
    assert verify_claims(c, store, metrics_table(spark), "0.001").first().verdict == "traced"
    assert verify_claims(c.withColumn("detect_confidence", F.lit("low")), store, metrics_table(spark)).first().verdict == "needs_review"


def test_rules(spark, store):
    m = metrics_table(spark)
    p = parsed(claim_rows(spark, [("Q", "non_gaap_diluted_eps", "FY2031-Q3", "$2.40"), ("Q", "total_revenue", "FY2031-Q3", "11%"), ("Q", "total_revenue", "FY2031-Q3", "$48.2 million"), ("Q", "total_revenue", "FY2031-Q3", "$47.9 million"), ("Q", "revenue_guidance", "FY2031-Q4", "$52 to $50 million"), ("Q", "revenue_growth_yoy", "FY2031-Q3", "16%")]), m)
    docs = spark.createDataFrame([("t", "d", "Total revenue fell. Our forecast has a midpoint of $70 million.")], "tenant_id string, document_id string, text string")
    got = {r.rule for r in rules.document_findings(docs, p, store, m).collect()}
    assert got == {"reg_g.equal_prominence", "units.unit_mismatch", "consistency.intra_document_mismatch", "ranges.inverted_range", "ranges.midpoint_mismatch", "derived.recomputation_mismatch", "directional.sign_mismatch", "forward_looking.safe_harbor_required"}


def test_bridge(spark):
    own = [Metric("g", "G"), Metric("x", "X"), Metric("n", "N", is_non_gaap=True, gaap_counterpart="g", adjustments=["x"])]
    m = metrics_table(spark, own)
    p = parsed(claim_rows(spark, [("M", "n", "P", "$1.12"), ("M", "g", "P", "$0.87")]), m)
    ok = spark.createDataFrame([fact("M", "n", "P", "1.12"), fact("M", "g", "P", "0.87"), fact("M", "x", "P", "0.25")], FA.FACTS)
    bad = spark.createDataFrame([fact("M", "n", "P", "1.12"), fact("M", "g", "P", "0.87"), fact("M", "x", "P", "0.20")], FA.FACTS)
    gone = spark.createDataFrame([fact("M", "n", "P", "1.12")], FA.FACTS)
    assert [[r.rule for r in rules.non_gaap(p, f, m).collect()] for f in (ok, bad, gone)] == [[], ["reg_g.reconciliation_arithmetic"], ["reg_g.reconciliation_required"]]
    assert rules.ordering(p).first().rule == "reg_g.equal_prominence_ordering"


def test_store(spark, store):
    with pytest.raises(ValueError, match="duplicate"):
        FA.add_facts(store, store.limit(1))
    assert {r.entity for r in FA.default_entity(store).collect()} == {"Q"}
    got = FA.latest_facts(store).filter("metric = 'cloud_growth_yoy'").first()
    assert got.value == 9


def test_guidance(spark):
    text = "Next, for the fourth quarter of fiscal 2031, Quill projects net revenue of $50.5 to $51.5 million. It guides fourth-quarter EPS to $2.10 to $2.20. Operating margin is forecast near 12% in the fourth quarter; it anticipates so.\n\nFor the full year fiscal 2031, Quill now sees revenue of $190 to $194 million. A long outlook follows."
    df = spark.createDataFrame([("t", "Q", "acc", "FY2031-Q3", "2031-11-03", None, text)], "tenant_id string, entity string, accession string, base_period string, as_of string, label string, text string")
    facts, skipped = guidance.guidance_facts(df)
    got = {(r.metric, r.period): r.value for r in facts.collect()}
    assert got == {("revenue_guidance", "FY2031-Q4"): 51000000, ("eps_guidance", "FY2031-Q4"): Decimal("2.15"), ("operating_margin_guidance", "FY2031-Q4"): 12, ("revenue_guidance", "FY2031-FY"): 192000000}
    assert [r.skipped for r in skipped.collect()] == ["A long outlook follows."]


def test_guidance_twice(spark):
    """Of two statements of one scope the first counts."""
    text = "We expect revenue of $5 million next quarter. Again, we expect revenue of $6 million next quarter."
    df = spark.createDataFrame([("t", "Q", "acc", "FY2031-Q3", None, None, text)], "tenant_id string, entity string, accession string, base_period string, as_of string, label string, text string")
    assert [(r.period, r.value) for r in guidance.guidance_facts(df)[0].collect()] == [("FY2031-Q4", 5000000)]


def test_tables():
    page = """<p>(in thousands, except per share data)</p><table><tr><td></td><td colspan=2>Six Months Ended June 30,</td></tr><tr><td></td><td>2031</td><td>2030</td></tr>
    <tr><td>Sales:</td></tr><tr><td>Pens (b)</td><td>$</td><td>3,118</td><td>$</td><td>2,907</td></tr><tr><td>Total sales</td><td>4,250</td><td>(</td><td>63</td><td>)</td></tr>
    <tr><td>Basic earnings per share</td><td>$0.42</td><td>$(0.17)</td></tr><tr><td>Return rate</td><td>6.2</td><td>%</td><td>5.9</td><td>%</td></tr></table>"""
    text = D.extract("a.html", page.encode())[0]
    assert "Sales — Pens: $3,118 thousand (FY2031-H1); $2,907 thousand (FY2030-H1)" in text
    assert "Sales — Total sales: $4,250 thousand (FY2031-H1); -$63 thousand (FY2030-H1)" in text
    assert "Basic earnings per share: $0.42 (FY2031-H1); -$0.17 (FY2030-H1)" in text and "Return rate: 6.2% (FY2031-H1); 5.9% (FY2030-H1)" in text
    assert D.extract("a.html", b"<table><tr><td>Home</td><td>Shop</td></tr><tr><td>x</td><td>y</td></tr></table>z")[0].endswith("z")
    assert D.header_periods("Three months ended March 31, nine months ended September 30, 2031 2030 2031 2030") == ["FY2031-Q1", "FY2030-Q1", "FY2031-9M", "FY2030-9M"]
    assert D.header_periods("Twelve months ended December 31, 2031") == ["FY2031"] and D.header_periods("nothing") == []


def test_rows():
    """Marker cells belong to their number; a column that had a dollar passes it on."""
    money: set[int] = set()
    value = lambda n, money=False, negative=False, percent=False: {"number": n, "money": money, "negative": negative, "percent": percent}
    assert D.read_row(["Sales", "$", "(", "5", ")", "7.5", "%"], money) == ("Sales", [value("5", True, True), value("7.5", percent=True)])
    assert D.read_row(["Cost", "9", "(3", ")%"], money) == ("Cost", [value("9", True), value("3", False, True, True)])
    assert D.read_row(["Days", "9"], money) == ("Days", [value("9")]) and D.read_row(["Head", "—"], money) == ("Head", [])


def test_containers():
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Revenue &amp; more</w:t></w:p><w:p><w:t>$5</w:t></w:p>")
    assert D.extract("a.docx", buf.getvalue())[:2] == ("Revenue & more\n$5", "docx")
    assert D.extract("a.pdf", b"stream\n(Revenue \\(net\\)) Tj [(a) -1 (b)] TJ\nendstream")[0] == "Revenue (net) ab"
    assert D.extract("a.rtf", rb"{\rtf1 Hello\par World}")[0] == "Hello\n World"
    assert D.extract("a.docx", b"no")[2] and D.extract("a.xyz", b"t")[2] and D.extract("a", b"t")[2]


def test_claims(spark, store):
    text = "Net sales came to $48.2 million, a gain of 15% year over year. Adjusted EPS was $2.40. Quill had $9.64 million of operating cash flow and spent $3 million on capital expenditures. Cloud revenue was $5.07 million. For the fourth quarter the outlook is for revenue in the range of $50.5 to $51.5 million."
    docs = spark.createDataFrame([("t", "d", "Q", "FY2031-Q3", text), ("t", "n", "Q", None, None)], "tenant_id string, document_id string, entity string, period string, text string")
    got = [(r.entity, r.metric, r.period, r.displayed_text) for r in C.extract_claims(docs, store).orderBy("span.start").collect()]
    assert got == [
        ("Q", "total_revenue", "FY2031-Q3", "$48.2 million"), ("Q", "revenue_growth_yoy", "FY2031-Q3", "15%"), ("Q", "non_gaap_diluted_eps", "FY2031-Q3", "$2.40"), ("Q", "operating_cash_flow", "FY2031-Q3", "$9.64 million"),
        ("Q", "capex", "FY2031-Q3", "$3 million"), ("Q:Cloud", "cloud_revenue", "FY2031-Q3", "$5.07 million"), ("Q", "revenue_guidance", "FY2031-Q4", "$50.5 to $51.5 million"),
    ]


def test_tenant_phrases(spark, store):
    """A tenant's own phrases hold for that tenant alone."""
    docs = spark.createDataFrame([(t, t, "Q", "FY2031-Q3", "Ink turnover was $4 million.") for t in ("t", "u")], "tenant_id string, document_id string, entity string, period string, text string")
    got = {r.tenant_id: r.metric for r in C.tenant_claims(docs, store, {"u": {"total_revenue": ["Ink Turnover"]}}).collect()}
    assert got == {"t": "unidentified", "u": "total_revenue"}
    with pytest.raises(ValueError):
        C.tenant_claims(docs, store, {"u": {"nothing": ["x"]}})


def test_large_derived(spark):
    """Amounts of a large payer, and a claim far off: exact, and no overflow ends the job."""
    rows = [fact("P", "total_revenue", "FY2031-Q1", "98765000000"), fact("P", "total_revenue", "FY2030-Q1", "91234500000"), fact("P", "medical_costs", "FY2031-Q1", "70315000000"), fact("P", "premium_revenue", "FY2031-Q1", "80461000000")]
    claims = claim_rows(spark, [("P", "revenue_growth_yoy", "FY2031-Q1", "8.3%"), ("P", "medical_care_ratio", "FY2031-Q1", "87.4%"), ("P", "medical_care_ratio", "FY2031-Q1", "$120 billion"), ("P", "revenue_growth_yoy", "FY2031-Q1", "900000000000%")])
    facts = spark.createDataFrame(rows, FA.FACTS)
    got = [(r.verdict, r.source_value) for r in verify_claims(claims, facts, metrics_table(spark)).orderBy("claim_id").collect()]
    assert got == [("traced", "8.254%"), ("traced", "87.3902%"), ("conflict", "87.3902%"), ("conflict", "8.254%")]
    assert {r.claim_id: r.rule for r in rules.derived(parsed(claims, metrics_table(spark)), facts).collect()} == {"c2": "derived.ratio_mismatch", "c3": "derived.recomputation_mismatch"}


def test_lookback_by_company(spark):
    rows = [("A", "FY2019-Q4"), ("A", "FY2019-Q3"), ("A", "FY2018-Q4"), ("B", "FY2026-Q1"), ("B", "FY2025-Q1")]
    got = FA.within_lookback(spark.createDataFrame(rows, "entity string, period string"), 4).collect()
    assert sorted(map(tuple, got)) == [("A", "FY2019-Q3"), ("A", "FY2019-Q4"), ("B", "FY2026-Q1")]


def test_vocabulary(spark):
    assert len(default_metrics()) == 53 and len(default_aliases()) == 49 and sum(map(len, default_aliases().values())) == 150
    assert extend_aliases({"a": ["x"]}, {"a": [" X", "Y "]}, ["a"]) == {"a": ["x", "y"]}
    with pytest.raises(ValueError):
        extend_aliases({}, {"zzz": ["x"]}, ["a"])
    assert aliases_table(spark).count() == 150


def test_audit(spark):
    import hashlib
    import json

    ev = spark.createDataFrame([(i, "2026", "é\U0001f600\"", "ingest", "t", json.dumps({"i": i}, separators=(",", ":"))) for i in range(5)], "ord int, timestamp string, actor string, type string, tenant_id string, payload string")
    chain = audit.append(ev).orderBy("seq").collect()
    last = audit.GENESIS
    for r in chain:
        body = {"seq": r.seq, "timestamp": r.timestamp, "actor": r.actor, "type": r.type, "tenant_id": r.tenant_id, "payload": json.loads(r.payload), "prev_hash": last}
        last = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert r.hash == last
    df = spark.createDataFrame(chain, audit.EVENTS)
    assert audit.verify(df).first().ok
    assert audit.verify(df.withColumn("actor", F.when(F.col("seq") == 2, "x").otherwise(F.col("actor")))).first()[:2] == (False, 2)


def test_releases(spark):
    rows = [("x", f"a{i}", d, d, t) for i, (d, t) in enumerate([("2026-05-01", "First Quarter 2026 results $5 million"), ("2026-04-20", "update"), ("2026-01-20", "Fourth Quarter 2025 results $1"), ("2025-10-20", "Third Quarter 2025 results $1")])]
    df = spark.createDataFrame(rows, "issuer string, accession string, filing_date string, report_date string, text string")
    assert {r.key for r in releases.select_quarters(df, 2).collect()} == {"FY2026-Q1", "FY2025-Q4"}


def test_highlights(spark):
    c = spark.createDataFrame([("c1", "t", "d", (0, 9)), ("c2", "t", "d", (5, 7)), ("c3", "t", "d", (9, 12))], "claim_id string, tenant_id string, document_id string, span struct<start:int,end:int>")
    v = spark.createDataFrame([("c1", "t", "d", "traced")], "claim_id string, tenant_id string, document_id string, verdict string")
    assert [(r.claim_id, r.verdict) for r in pack.highlights(c, v).orderBy("start").collect()] == [("c1", "traced"), ("c3", "untraced")]


def test_stream(spark, store, tmp_path):
    from tallyspark.streaming.feed import append_facts, stream_facts

    store.write.parquet(str(tmp_path / "in"))
    append_facts(stream_facts(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == store.count()
