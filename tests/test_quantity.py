"""Figure parsing and comparison against exact decimals."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import periods as P
from tallyspark.functions import quantity as Q

CASES = {
    "$1.24 billion": (1_240_000_000, "currency", 10_000_000),
    "$1,241.3 million": (1_241_300_000, "currency", 100_000),
    "$0.87": ("0.87", "currency", "0.01"),
    "31%": (31, "percent", 1),
    "-12.4%": ("-12.4", "percent", "0.1"),
    "50 bps": (50, "basis_points", 1),
    "140 basis points": (140, "basis_points", 1),
    "(250.0)": (-250, "currency", "0.1"),
    "$ (1,409 )": (-1409, "currency", 1),
    "($1.2 billion)": (-1_200_000_000, "currency", 100_000_000),
    "(-5%)": (5, "percent", 1),
    "−$3": (-3, "currency", 1),
    "US$5 mm": (5_000_000, "currency", 1_000_000),
    "": None,
    "about five": None,
    "$1.31 to $1.34 billion": None,
}


def test_parse(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", Q.parse_quantity(F.col("t")).alias("q")).collect()
    for r in rows:
        want = CASES[r.t]
        got = None if r.q is None else (r.q.value, r.q.unit, r.q.quantum)
        assert got == (None if want is None else (Decimal(want[0]), want[1], Decimal(want[2]))), r.t


def test_figures_too_large_are_none(spark):
    texts = ["$99999999999 trillion", "$9999999999.99 trillion", "$123456789012345678", f"{'9' * 60}%", "$1." + "1" * 40, "$9,999,999,999 trillion"]
    got = [r.q for r in spark.createDataFrame([(t,) for t in texts], "t string").select(Q.parse_quantity(F.col("t")).alias("q")).collect()]
    assert [g is None for g in got] == [True, False, True, True, False, False]
    assert got[1].value == Decimal("9999999999990000000000") and got[5].value == Decimal(9_999_999_999) * 10**12
    r = spark.createDataFrame([("$9999999999 to $9999999999 trillion",), ("$99999999999 to $99999999999 trillion",)], "t string").select(Q.parse_range(F.col("t")).alias("r")).select(F.when(F.col("r").isNotNull(), Q.midpoint(F.col("r"))["value"])).collect()
    assert r[0][0] == Decimal(9_999_999_999) * 10**12 and r[1][0] is None
    big = spark.createDataFrame([(Decimal("9999999999999999999999"), Decimal("0.000001")), (Decimal("9999999999999999999999"), Decimal(10) ** 21)], "v decimal(28,6), q decimal(28,6)")
    assert [x[0] for x in big.select(Q.round_to(F.col("v"), F.col("q"))).collect()] == [Decimal("9999999999999999999999"), None]


def test_ranges(spark):
    rows = spark.createDataFrame([("$1.31–1.34B",), ("22% to 23%",), ("$5",), ("$5 to 3%",)], "t string").select(Q.parse_range(F.col("t")).alias("r")).collect()
    assert (rows[0].r.low.value, rows[0].r.high.value) == (1_310_000_000, 1_340_000_000)
    assert (rows[1].r.low.value, rows[1].r.high.value) == (22, 23)
    assert rows[2].r is None and rows[3].r is None


def test_matches_is_half_up(spark):
    rnd = random.Random(3)
    data = []
    for _ in range(400):
        q = Decimal(10) ** rnd.randint(-2, 3)
        v = q * rnd.randint(-50, 50)
        data.append((v, q, v + q * Decimal(rnd.choice(["-0.5", "0.5", "0.49", "-0.49", "0", "1.2"]))))
    df = spark.createDataFrame(data, "v decimal(28,6), q decimal(28,6), s decimal(28,6)")
    for (v, q, s), got in zip(data, df.select(Q.matches(F.col("v"), F.col("q"), F.col("s"))).collect(), strict=True):
        assert got[0] == ((s / q).quantize(Decimal(1), rounding=ROUND_HALF_UP) * q == v)


def test_fraction_match(spark):
    rnd = random.Random(4)
    data = [(Decimal(rnd.randint(-300, 300)) / 10, Decimal("0.1"), Decimal(rnd.randint(-9999, 9999)), Decimal(rnd.choice([-7, 13, 250, 999]))) for _ in range(400)]
    data += [(((n * 1) / d).quantize(q, rounding=ROUND_HALF_UP), q, n, d) for _, q, n, d in data]
    df = spark.createDataFrame(data, "v decimal(28,6), q decimal(28,6), n decimal(28,6), d decimal(28,6)")
    for (v, q, n, d), got in zip(data, df.select(Q.matches_fraction(*map(F.col, "vqnd"))).collect(), strict=True):
        assert got[0] == ((n / d).quantize(q, rounding=ROUND_HALF_UP) == v)


@pytest.mark.parametrize("frame,start,end,want", [("CY2026Q1", None, None, "FY2026-Q1"), ("CY2025", None, None, "FY2025"), ("CY2025Q4I", None, None, "FY2025-Q4"), (None, None, "2026-03-31", "FY2026-Q1"), (None, "2026-01-01", "2026-06-30", "FY2026-H1"), (None, "2025-01-01", "2025-09-30", "FY2025-9M"), (None, "2025-01-01", "2025-12-31", "FY2025"), (None, "2025-01-01", "2025-04-30", None)])
def test_periods(spark, frame, start, end, want):
    df = spark.createDataFrame([(frame, start, end)], "f string, s string, e string")
    assert df.select(P.occurrence_period(F.col("f"), F.col("s"), F.col("e"))).first()[0] == want


def test_period_inference(spark):
    df = spark.createDataFrame([("Results", "the first quarter of fiscal 2026"), ("FY2025-Q3 draft", "x"), ("none", "none")], "a string, b string")
    assert [r[0] for r in df.select(P.infer_document_period(F.col("a"), F.col("b"))).collect()] == ["FY2026-Q1", "FY2025-Q3", None]


def test_amounts_of_sixteen_and_seventeen_digits(spark):
    texts = ["$3093006688482000", "$12,345,678,901,234,567.25", "$0.0000004999"]
    got = [r.q for r in spark.createDataFrame([(t,) for t in texts], "t string").select(Q.parse_quantity(F.col("t")).alias("q")).collect()]
    assert [g and g.value for g in got] == [Decimal("3093006688482000"), Decimal("12345678901234567.25"), Decimal(0)]
