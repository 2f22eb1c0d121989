"""The kept store and its verdicts against a rebuild from all facts."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import facts as FA
from tallyspark.operators.store import FactStore, Verdicts
from tallyspark.operators.verify import parsed, verify_claims, verify_parsed
from tallyspark.sources.vocabulary import metrics_table

CLAIM = "claim_id string, tenant_id string, document_id string, entity string, metric string, period string, displayed_text string, span struct<start:int,end:int>, detect_confidence string, seen string"
METRICS = ["total_revenue", "net_income", "premium_revenue", "medical_costs"]


def fact(i, rnd):
    kind = rnd.choice(["edgar_xbrl", "edgar_xbrl", "management_input"])
    return (f"id{i}", f"t{i % 5}", f"E{rnd.randrange(3)}", rnd.choice(METRICS), f"FY{rnd.choice([2030, 2031])}-Q{rnd.randrange(1, 3)}", Decimal(rnd.randrange(1, 9) * 10**6), "currency", Decimal(0), kind, rnd.choice(["r", "none"]), "l", "x", None, f"2031-0{rnd.randrange(1, 4)}-01", "high", i)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    facts = [fact(i, rnd) for i in range(200)]
    claims = [(f"c{i}", f"t{i % 5}", f"d{i % 11}", f"E{i % 3}", rnd.choice([*METRICS, "revenue_growth_yoy", "medical_care_ratio"]), f"FY2031-Q{1 + i % 2}", rnd.choice(["$3 million", "$5 million", "25%", "150%", "-50%", "$4"]), (i, i + 1), "high", f"2031-0{1 + i % 3}-01") for i in range(120)]
    return facts, claims


def state(scopes):
    return sorted(map(repr, scopes.select(*FA.SCOPE, "latest", "older").collect()))


def test_store_is_a_rebuild(spark, rows):
    facts, claims = rows
    df = lambda x: spark.createDataFrame(x, FA.FACTS)
    store = FactStore(spark, buckets=4, parts=3)
    store.add(df(facts[:80]))
    store.add(df(facts[60:150] + facts[60:70]))  # some come again
    assert state(store.scopes()) == state(FA.fact_scopes(df(facts[:150])))
    store.add(df(facts[60:150]))  # a batch that comes twice
    store.add(df([]))
    assert state(store.scopes()) == state(FA.fact_scopes(df(facts[:150])))
    store.add(df(facts[150:]))
    assert state(store.scopes()) == state(FA.fact_scopes(df(facts)))
    metrics = metrics_table(spark)
    own = spark.createDataFrame(claims, CLAIM)
    same = lambda v: sorted(map(repr, v.collect()))
    assert same(store.verify(own, metrics)) == same(verify_claims(own, df(facts), metrics))
    store.drop()


def test_untouched_parts_are_not_rewritten(spark, rows, tmp_path):
    facts, _ = rows
    store = FactStore(spark, folder=f"file://{tmp_path}/s", buckets=2, parts=64)
    store.add(spark.createDataFrame(facts, FA.FACTS))
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    before = files()
    store.add(spark.createDataFrame([("new", "t1", *facts[0][2:])], FA.FACTS))
    changed = {p.parts[1] for p in before.keys() ^ files().keys()}
    assert len(changed) == 1 and len({p.parts[1] for p in before}) == 5
    store.drop()


def test_facts_stay_in_place(spark, rows):
    """No exchange lies between the store's files and the join, however large the sides are."""
    facts, claims = rows
    store = FactStore(spark, buckets=8)
    store.add(spark.createDataFrame(facts, FA.FACTS))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = verify_parsed(parsed(spark.createDataFrame(claims, CLAIM), metrics_table(spark)), store.scopes(), ["claim_id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    scan = next(i for i, x in enumerate(lines) if store.name in x and "Scan" in x)
    depth = lambda x: next(i for i, c in enumerate(x) if c.isalpha() or c in "*")
    above, d = [], depth(lines[scan])
    for x in reversed(lines[at + 1 : scan]):
        if depth(x) < d:
            above.append(x)
            d = depth(x)
    assert above and not any("Exchange" in x for x in above), plan
    store.drop()


def test_late_facts_turn_only_what_reads_them(spark, rows):
    facts, claims = rows
    metrics, df = metrics_table(spark), lambda x: spark.createDataFrame(x, FA.FACTS)
    kept = Verdicts(FactStore(spark, buckets=4, parts=3), metrics)
    kept.add_claims(spark.createDataFrame(claims[:50], CLAIM))  # before any fact
    assert {r.verdict for r in kept.verdicts.collect()} == {"untraced"}
    kept.add_facts(df(facts[:120]))
    kept.add_claims(spark.createDataFrame(claims[40:], CLAIM))  # some come again
    same = lambda v: sorted(map(repr, v.collect()))
    assert same(kept.verdicts) == same(verify_claims(spark.createDataFrame(claims, CLAIM), df(facts[:120]), metrics))
    late = [f for f in facts[120:] if f[1] == "t2" and f[2] == "E1"]
    again = kept.add_facts(df(late)).collect()
    reads = lambda c: {(c[1], c[3], m, p) for m in {"revenue_growth_yoy": ["total_revenue"], "medical_care_ratio": ["medical_costs", "premium_revenue"]}.get(c[4], [c[4]]) for p in (c[5], c[5].replace("2031", "2030"))}
    scopes = {f[1:5] for f in late}
    assert late and {r.claim_id for r in again} <= {c[0] for c in claims if reads(c) & scopes} and len(again) < len(claims)
    assert same(kept.verdicts) == same(verify_claims(spark.createDataFrame(claims, CLAIM), df(facts[:120] + late), metrics))
    open_ids = {c[0] for c in claims if c[9] >= "2031-03-01"}
    kept.add_facts(df(facts[120:]), since="2031-03-01")
    full = {r.claim_id: r.verdict for r in verify_claims(spark.createDataFrame(claims, CLAIM), df(facts), metrics).collect()}
    assert all(full[r.claim_id] == r.verdict for r in kept.verdicts.collect() if r.claim_id in open_ids)
    kept.store.drop()


def test_streams_keep_verdicts(spark, rows, tmp_path):
    """Claims come first, facts in two files after: verdicts end as from scratch."""
    from tallyspark.streaming.feed import keep_claims, keep_facts, stream_facts

    facts, claims = rows
    metrics, df = metrics_table(spark), lambda x: spark.createDataFrame(x, FA.FACTS)
    spark.createDataFrame(claims, CLAIM).coalesce(1).write.parquet(str(tmp_path / "claims"))
    kept = Verdicts(FactStore(spark, buckets=2, parts=2), metrics)
    keep_claims(spark.readStream.schema(CLAIM).parquet(str(tmp_path / "claims")), kept, str(tmp_path / "c1")).awaitTermination(240)
    for part in (facts[:120], facts[100:]):
        df(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "facts"))
        keep_facts(stream_facts(spark, str(tmp_path / "facts")), kept, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(240)
    same = lambda v: sorted(map(repr, v.collect()))
    assert same(kept.verdicts) == same(verify_claims(spark.createDataFrame(claims, CLAIM), df(facts), metrics))
    assert len(list((tmp_path / "out").glob("facts-epoch=*"))) == 2
    kept.store.drop()
