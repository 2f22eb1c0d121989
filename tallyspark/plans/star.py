"""Facts, claims and documents from a star schema: an entity is a nation, a segment one of its market segments.

Amounts are integers of a ten-thousandth (cents times hundred less discount percent), exact in any engine.
Version 1 of a quarter leaves returned lines out and is restated by version 2, all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import quantity as Q
from ..operators.facts import FACTS
from ..operators.staging import settled
from ..sources.vocabulary import Metric, default_metrics, metrics_table

TENANT = "star"
EXTRA = [
    Metric("revenue_growth_qoq", "Sequential revenue growth", "percent", kind="qoq_growth", base="total_revenue"),
    Metric("revenue_ttm", "Trailing revenue", "currency", kind="ttm_sum", base="total_revenue"),
    Metric("revenue_parts", "Revenue by parts", "currency", kind="sum", components=["kept_revenue", "returned_revenue"]),
    Metric("kept_revenue", "Kept revenue", "currency"),
    Metric("returned_revenue", "Returned revenue", "currency"),
    Metric("return_share", "Share returned", "percent", kind="ratio_pct", numerator="returned_revenue", denominator="total_revenue"),
    Metric("margin_points", "Margin change", "basis_points", kind="delta_bps", base="return_level"),
    Metric("return_level", "Return level", "percent"),
    Metric("adjusted_revenue", "Adjusted revenue", "currency", is_non_gaap=True, gaap_counterpart="kept_revenue", adjustments=["returned_revenue"]),
]


def metrics(spark: SparkSession) -> DataFrame:
    return metrics_table(spark, [*default_metrics(), *EXTRA])


def _hundredths(c: str) -> Column:
    """Hundredths of a double as a long, half away from zero: as ``round``, which goes through decimals row by row."""
    x = F.abs(F.col(c) * 100)
    n = F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)
    return F.when(F.col(c) < 0, -n).otherwise(n)


def quarters(spark: SparkSession, sf: str, segments: bool = False) -> DataFrame:
    """Amounts of each nation (and market segment) and quarter: ``v1``, ``v2`` and the key ``k``.

    Orders get their customer's nation before lines join them, so lines are dealt once; the sums are few rows, and written once for all that reads them.
    Both joins shuffle at any size: the planner judges a table by its files, and else sends all lines of small files through the driver.
    """
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    price, off = _hundredths("l_extendedprice"), _hundredths("l_discount")
    t = F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1
    li = read("lineitem").select("l_orderkey", t.alias("t"), (price * (100 - off)).alias("a"), (F.col("l_returnflag") != "R").alias("kept"))
    part = ["c_nationkey", *["c_mktsegment"] * segments]
    cust = read("customer").select("c_custkey", *part)
    order = read("orders").select("o_orderkey", "o_custkey")
    whose = order.join(cust.hint("merge"), order["o_custkey"] == cust["c_custkey"]).select("o_orderkey", *part)
    rows = li.join(whose.hint("merge"), li["l_orderkey"] == whose["o_orderkey"])
    sums = rows.groupBy(*part, "t").agg(F.sum("a").alias("v2"), F.sum(F.when(F.col("kept"), F.col("a")).otherwise(0)).alias("v1"))
    names = read("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("entity"))
    sums = sums.select(*part, F.expr("t div 4").cast("int").alias("y"), (F.col("t") % 4 + 1).alias("q"), "v2", "v1")
    out = sums.join(names, "c_nationkey").withColumn("k", (F.col("c_nationkey") * 31 + F.col("y") * 4 + F.col("q")).cast("long"))
    return settled(out.withColumn("period", F.concat(F.lit("FY"), F.col("y").cast("string"), F.lit("-Q"), F.col("q").cast("string"))), "quarters")


def level() -> Column:
    """What was returned in millionths of all, rounded down; the product may pass 64 bits."""
    return F.expr("CAST(v2 - v1 AS DECIMAL(20,0)) * 1000000 div v2")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts_of(quarters(spark, sf))


def facts_of(q: DataFrame) -> DataFrame:
    """Facts of quarters, all metrics from one reading: each quarter's row is laid out as its facts."""

    def item(seq: int, metric: str, amount: Column, as_of: str = "2002-01-01", kind: str = "edgar_xbrl", unit: str = "currency", period: Column | None = None) -> Column:
        value = (amount.cast("decimal(20,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast(Q.DEC)
        return F.struct(F.lit(metric).alias("metric"), (F.col("period") if period is None else period).alias("period"), value.alias("value"), F.lit(unit).alias("unit"), F.lit(kind).alias("source_type"), F.lit(as_of).alias("as_of"), F.lit(seq).cast("long").alias("ingest_seq"))

    v1, v2 = F.col("v1"), F.col("v2")
    items = F.array(
        item(0, "total_revenue", v1),
        item(1, "total_revenue", v2, "2002-06-01"),
        item(2, "kept_revenue", v1),
        item(3, "returned_revenue", v2 - v1),
        item(4, "return_level", level(), unit="percent"),
        item(5, "adjusted_revenue", F.when(F.col("k") % 5 == 0, v2 + 10000).otherwise(v2)),
        F.when(F.col("c_nationkey") % 5 == 0, item(6, "revenue_guidance", v2, kind="management_input", period=P.next_quarter(F.col("period")))),
    )
    rows = q.select("entity", F.explode(F.array_compact(items)).alias("f")).select("entity", "f.*")
    fixed = {"tenant_id": F.lit(TENANT), "id": F.concat_ws(":", "as_of", "entity", "metric", "period"), "quantum": F.lit(0).cast(Q.DEC), "source_ref": F.concat(F.lit("f#"), F.col("metric")), "source_label": F.lit(""), "source_excerpt": F.lit(""), "source_url": F.lit(None).cast("string"), "confidence": F.lit("high")}
    return rows.select(*(fixed.get(c.split()[0], F.col(c.split()[0])).alias(c.split()[0]) for c in FACTS.split(", ")))


def in_trillions(facts: DataFrame) -> DataFrame:
    """The same facts with currency a million times as large."""
    return facts.withColumn("value", F.when(F.col("unit") == "currency", F.col("value") * 1000000).otherwise(F.col("value")).cast(Q.DEC))


def millions(amount: Column) -> Column:
    """``$x.xx million`` of an amount in ten-thousandths, half up."""
    n = F.floor((amount + 50_000_000) / 100_000_000)
    return F.concat(F.lit("$"), F.floor(n / 100).cast("long").cast("string"), F.lit("."), F.lpad((n % 100).cast("long").cast("string"), 2, "0"), F.lit(" million"))


def _claim(rows: DataFrame, doc: str, n: int, metric: str | Column, text: Column, confidence: Column | str = "high", period: str = "period") -> DataFrame:
    document = F.concat_ws("-", F.lit(doc), "entity", "period")
    return rows.select(
        F.concat(document, F.lit(f"-c{n}")).alias("claim_id"), F.lit(TENANT).alias("tenant_id"), document.alias("document_id"), "entity", (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"), F.col(period).alias("period"), text.alias("displayed_text"),
        F.struct(F.lit(40 * n).alias("start"), F.lit(40 * n + 12).alias("end")).alias("span"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("detect_confidence"),
    )


def tenth(num: Column, den: Column) -> Column:
    """``x.x`` of 100 * num / den, half up away from zero, from integers."""
    n = F.abs(num.cast("decimal(30,0)")) * 2000 + F.abs(den.cast("decimal(30,0)"))
    t = F.floor(n / (2 * F.abs(den.cast("decimal(30,0)")))).cast("long")
    return F.concat(F.when((num < 0) != (den < 0), "-").otherwise(""), F.floor(t / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))


def tie_out_claims(q: DataFrame) -> DataFrame:
    """One claim a quarter; what is wrong with it follows from the key modulo 7."""
    m = F.col("k") % 7
    text = (
        F.when(m == 0, millions(F.col("v2")))
        .when(m == 1, F.concat(F.lit("$"), F.floor((F.col("v2") + 5_000_000) / 10_000_000).cast("long").cast("string"), F.lit(" thousand")))
        .when(m == 2, millions(F.col("v1")))
        .when(m == 3, millions(F.col("v2") + 100_000_000))
        .when(m == 4, F.concat(millions(F.col("v2")), F.lit(" to "), millions(F.col("v2") + 200_000_000)))
        .otherwise(millions(F.col("v2")))
    )
    return _claim(q, "release", 1, F.when(m == 5, "unknown_metric").otherwise("total_revenue"), text, F.when(m == 6, "low").otherwise("high"))


def pairs(q: DataFrame, back: int) -> DataFrame:
    """Quarters with the amount ``back`` quarters before."""
    was = q.select(F.col("entity").alias("e"), F.col("period").alias("p"), F.col("v2").alias("was"))
    return q.join(was, (F.col("e") == F.col("entity")) & (F.col("p") == P.prior_quarter(F.col("period"), back))).drop("e", "p")


def growth_claims(q: DataFrame, metric: str, back: int) -> DataFrame:
    """Growth to a tenth of a percent; every third claim is a tenth too high."""
    rows = pairs(q, back)
    up = F.when(F.col("k") % 3 == 0, F.expr("was div 1000")).otherwise(F.lit(0))
    return _claim(rows, "release", 2, metric, F.concat(tenth(F.col("v2") - F.col("was") + up, F.col("was")), F.lit("%")))


def documents(q: DataFrame) -> DataFrame:
    """Release, script and answers of each quarter, with what the text rules look for."""
    low = F.col("k")
    word = F.when(low % 2 == 0, "increased").otherwise("declined")
    release = F.concat(F.lit("Total revenue "), word, F.lit(" to "), millions(F.col("v2")), F.lit(" in the quarter."), F.when(low % 3 == 0, " The company expects more.").otherwise(""), F.when(low % 4 == 0, " See our forward-looking statements.").otherwise(""))
    script = F.concat(F.lit("The midpoint of "), millions(F.col("v2") + F.when(low % 3 == 1, 300_000_000).otherwise(100_000_000)), F.lit(" is where we stand."))
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), text.alias("text")) for kind, text in (("release", release), ("script", script), ("qa", F.lit("No figures here.")))))
    each = q.select("entity", "period", F.explode(kinds).alias("d"))
    return each.select(F.lit(TENANT).alias("tenant_id"), F.concat_ws("-", "d.kind", "entity", "period").alias("document_id"), "entity", "period", "d.text")


def range_claims(q: DataFrame) -> DataFrame:
    """A range in each script, inverted for every fourth key."""
    lo, hi = millions(F.col("v2")), millions(F.col("v2") + 200_000_000)
    return _claim(q, "script", 3, "revenue_guidance", F.when(F.col("k") % 4 == 0, F.concat(hi, F.lit(" to "), lo)).otherwise(F.concat(lo, F.lit(" to "), hi)))


def repeated_claims(q: DataFrame) -> DataFrame:
    """Two uses in one release and one in a script; the second disagrees for k % 3 = 0, the script for k % 4 = 0."""
    off = lambda n: F.when(F.col("k") % n == 0, 100_000_000).otherwise(0)
    return _claim(q, "release", 1, "total_revenue", millions(F.col("v2"))).unionByName(_claim(q, "release", 2, "total_revenue", millions(F.col("v2") + off(3)))).unionByName(_claim(q, "script", 1, "total_revenue", millions(F.col("v2") + off(4))))


def gaap_claims(q: DataFrame) -> DataFrame:
    """A non-GAAP figure in each release; its counterpart only for odd keys, before it for k % 3 = 1."""
    own = _claim(q, "release", 2, "adjusted_revenue", millions(F.col("v2")))
    late = _claim(q.filter("k % 2 = 1 AND k % 3 <> 1"), "release", 3, "kept_revenue", millions(F.col("v1")))
    early = _claim(q.filter("k % 2 = 1 AND k % 3 = 1"), "release", 1, "kept_revenue", millions(F.col("v1")))
    return own.unionByName(late).unionByName(early)
