"""Star queries over whole tables, held against their SQL at the smallest scale."""

import pytest

import __spark_entry__ as E
from tallyspark.plans import queries as star
from tallyspark.plans import more, wider

SF = E.SMOKE
duckdb = pytest.importorskip("duckdb")
NAMES = ["best_release", "table_render", "extracted_claims", "publishable", "facts_lookback", "companyfacts_ingest", "intra_doc", "cross_doc", "audit_chain", "audit_tamper", *wider.QUERIES, *more.QUERIES]


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "nation", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, base, name):
    df = star.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    sql = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(map(repr, base.sql(f"SELECT {sql} FROM ({star.oracle_sql()[name]})").fetchall()))


def test_whole_tables(spark):
    """No issuer, year or kind of document is left out."""
    rows = star.best_release(spark, SF).select("issuer").distinct().count()
    assert rows == spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().count()
    assert star.table_render(spark, SF).selectExpr("substr(period, 1, 6)").distinct().count() > 1
    assert {r[0].split("-")[0] for r in star.publishable(spark, SF).collect()} == {"release", "script", "qa"}


def test_figure_counts(spark):
    from tallyspark.operators.claims import FIGURE

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.n_figures for r in star.figure_counts(spark, SF).collect()} == {k: len(FIGURE.findall(t)) for k, t in texts.items()}


def test_level_of_amounts_whose_product_passes_64_bits(spark):
    from tallyspark.plans.star import facts_of

    q = spark.createDataFrame([("N", 1, 8000, "FY1999-Q4", 10_000_000_000_000, 20_000_000_000_000)], "entity string, c_nationkey long, k long, period string, v1 long, v2 long")
    assert [r[0] for r in facts_of(q).filter("metric = 'return_level'").selectExpr("CAST(value * 10000 AS LONG)").collect()] == [500_000]


@pytest.mark.parametrize("name", ["unit_mismatch", "growth_rule", "publishable", "close_pack", "sum_rule", "tie_out_verdicts"])
def test_lines_are_summed_once(spark, monkeypatch, name):
    """The quarters' sums are written once, and what a query joins is made from them."""
    from tallyspark.plans import star as quarters_of

    calls, real = [], quarters_of.quarters
    monkeypatch.setattr(quarters_of, "quarters", lambda *a, **k: calls.append(a) or real(*a, **k))
    df = star.queries()[name](spark, SF)
    assert len(calls) == 1 and not [f for f in df.inputFiles() if "lineitem" in f]


def test_lines_are_dealt_once(spark, monkeypatch):
    """Orders get their customer's nation before lines join them."""
    from tallyspark.plans import star as quarters_of

    seen = []
    monkeypatch.setattr(quarters_of, "settled", lambda df, name: seen.append(df) or df)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = quarters_of.quarters(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    joins = [line for line in plan.split("\n") if "Join " in line]
    assert len(seen) == 1 and "o_custkey" in joins[-1] and "l_orderkey" in joins[-2]


@pytest.mark.parametrize("segments", [False, True])
def test_no_growing_table_is_broadcast(spark, monkeypatch, segments):
    """Lines, orders and customers are shuffled however small their files are; nations alone are sent to all."""
    from tallyspark.plans import star as quarters_of

    seen = []
    monkeypatch.setattr(quarters_of, "settled", lambda df, name: seen.append(df) or df)
    quarters_of.quarters(spark, SF, segments)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().split("\n")
    sent = [line for line in plan if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert len([line for line in plan if "SortMergeJoin" in line]) == 2 and len(sent) <= 1 and all("c_nationkey" in line for line in sent)


def test_hundredths_round_as_sql_does(spark, base):
    from tallyspark.plans.star import _hundredths

    xs = [0.0, 0.005, 0.015, 1.005, 2.675, 0.125, -0.125, -1.005, 104949.5, 1234.56, 0.07, 0.29, 1e9 + 0.01]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(_hundredths("x")).collect()]
    assert got == [base.execute("SELECT round(?::DOUBLE * 100)::BIGINT", [x]).fetchall()[0][0] for x in xs]
