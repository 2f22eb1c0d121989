"""Figures as written in prose: parsing, precision, comparison and display, as Columns.

A quantity is a struct of ``value`` (base units), ``unit`` and ``quantum`` (place value of the last
written digit); null where the text is no figure. Comparison rounds the source half-up to the draft's quantum,
written as an interval so that no decimal is ever divided.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(28,6)"
#: Scale words and what they multiply by.
SCALES = {
    "thousand": 10**3, "thousands": 10**3, "k": 10**3,
    "million": 10**6, "millions": 10**6, "m": 10**6, "mm": 10**6,
    "billion": 10**9, "billions": 10**9, "b": 10**9, "bn": 10**9,
    "trillion": 10**12, "t": 10**12,
}
_NUM = r"([-+]?\d[\d,]*(?:\.\d+)?)"
_WORD = "|".join(sorted(SCALES, key=len, reverse=True))
_PERCENT = rf"(?iU)^\(?\s*{_NUM}\s*%\s*\)?$"
_BPS = rf"(?iU)^\(?\s*{_NUM}\s*(?:bps|basis points)\s*\)?$"
_MONEY = rf"(?iU)^\(?\s*(?:US)?\$?\s*{_NUM}\s*({_WORD})?\s*\)?$"
_WRAPPED = r"(?U)^\$\s*\((.+?)\)\s*$"
_TAIL = r"(?iU)(billion|million|thousand|trillion|bn|mm|[bmkt])\s*$"
_BETWEEN = r"(?iU)\s*(?:\bto\b|\bthrough\b|\band\b|[‒–—-])\s*"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _bound(x: Column, body) -> Column:
    """``body`` of x with x worked out once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _plain(text: Column) -> Column:
    """Text without its sign notation, and whether the notation makes it negative."""
    minus = text.rlike("^[-−]")
    bare = F.when(minus, F.regexp_replace(text, r"(?U)^[-−]\s*", "")).otherwise(text)
    wrapped = bare.rlike(_WRAPPED)
    inner = F.when(wrapped, F.concat(F.lit("$"), strip(F.regexp_extract(bare, _WRAPPED, 1)))).otherwise(bare)
    return F.struct(inner.alias("s"), (minus | wrapped | (inner.startswith("(") & inner.endswith(")"))).alias("neg"))


def _scale(word: Column) -> Column:
    out = F.lit(1).cast("decimal(13,0)")
    for w, k in SCALES.items():
        out = F.when(word == w, F.lit(k).cast("decimal(13,0)")).otherwise(out)
    return out


def _power(digits: Column) -> Column:
    """10 to minus ``digits``, exactly."""
    table = F.array(*(F.lit(f"{10**-i:.12f}").cast("decimal(20,12)") for i in range(13)))
    return F.get(table, digits)


def _quantity(number: Column, unit: str, scale: Column, neg: Column) -> Column:
    clean = F.replace(number, F.lit(","), F.lit(""))
    written = clean.try_cast("decimal(27,10)").cast("decimal(32,10)")  # the wider type lets the product be rounded once, to DEC's places
    value = (written * scale).try_cast(DEC)  # null where it is too large: no figure then
    digits = F.when(F.contains(clean, F.lit(".")), F.length(F.substring_index(clean, ".", -1))).otherwise(0)
    return F.when(value.isNotNull(), F.struct(F.when(neg, -value).otherwise(value).cast(DEC).alias("value"), F.lit(unit).alias("unit"), (_power(digits) * scale).try_cast(DEC).alias("quantum")))


def parse_quantity(text: Column) -> Column:
    """Struct of value, unit and quantum of a written figure, or null. Bare numbers are currency."""
    one = F.lit(1).cast("decimal(13,0)")

    def body(p: Column) -> Column:
        s, neg = p["s"], p["neg"]
        money = F.regexp_extract(s, _MONEY, 1)
        return (
            F.when(s.rlike(_PERCENT), _quantity(F.regexp_extract(s, _PERCENT, 1), "percent", one, neg))
            .when(s.rlike(_BPS), _quantity(F.regexp_extract(s, _BPS, 1), "basis_points", one, neg))
            .when(s.rlike(_MONEY), _quantity(money, "currency", _scale(F.lower(F.regexp_extract(s, _MONEY, 2))), neg))
        )

    return _bound(_plain(strip(text)), body)


def parse_range(text: Column) -> Column:
    """Struct of ``low`` and ``high`` quantities, or null; the high end's scale word also holds for a bare low end."""

    def body(parts: Column) -> Column:
        low, high = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
        shared = high.rlike(_TAIL) & ~low.rlike(_TAIL)
        low = F.when(shared, F.concat(low, F.lit(" "), F.regexp_extract(high, _TAIL, 1))).otherwise(low)
        both = F.struct(parse_quantity(low).alias("low"), parse_quantity(high).alias("high"))
        return F.when(F.size(parts) == 2, _bound(both, lambda r: F.when(r["low"]["unit"] == r["high"]["unit"], r)))

    return _bound(F.split(strip(text), _BETWEEN, 2), body)


def midpoint(r: Column) -> Column:
    """Quantity halfway, at the precision of the low end."""
    return F.struct(((r["low"]["value"] + r["high"]["value"]) * F.lit("0.5").cast("decimal(2,1)")).try_cast(DEC).alias("value"), r["low"]["unit"].alias("unit"), r["low"]["quantum"].alias("quantum"))


def round_to(value: Column, quantum: Column) -> Column:
    """Half-up, away from zero; unchanged for a quantum that isn't positive, null where the result is too large."""
    steps = F.round(F.try_divide(value, quantum), 0).try_cast("decimal(28,0)")
    return F.when(quantum > 0, F.try_multiply(steps, quantum).try_cast(DEC)).otherwise(value)


def matches(value: Column, quantum: Column, source: Column) -> Column:
    """Whether the source, rounded to the quantum, is the value."""
    low, high, twice = 2 * value - quantum, 2 * value + quantum, 2 * source
    return F.when(quantum <= 0, source == value).when(source >= 0, (low <= twice) & (twice < high)).otherwise((low < twice) & (twice <= high))


def _magnitude(num: Column, den: Column, body) -> Column:
    """``body`` of the quotient's parts: ``sign``, ``whole`` (its integer part without sign), and ``rest`` of ``by`` that it exceeds that by.

    All are integers, in millionths of the operands, so that nothing is rounded. Null for no or a zero denominator.
    """
    units = lambda x: (F.abs(x).try_cast(DEC) * 1000000).try_cast("decimal(28,0)")
    pair = F.struct(units(num).alias("n"), units(den).alias("d"), F.when((num < 0) == (den < 0), F.lit(1)).otherwise(F.lit(-1)).alias("sign"))

    def split(p: Column) -> Column:
        rest = p["n"] % p["d"]
        parts = F.struct(p["sign"].alias("sign"), ((p["n"] - rest) / p["d"]).cast("decimal(28,0)").alias("whole"), rest.cast("decimal(28,0)").alias("rest"), p["d"].alias("by"))
        return F.when(p["d"] > 0, _bound(parts, body))

    return _bound(pair, split)


def matches_fraction(value: Column, quantum: Column, num: Column, den: Column) -> Column:
    """``matches`` for the source num / den, exactly; null for no or a zero denominator.

    A bound is compared with the quotient's integer part first; what is left of it lies between 0 and 1
    and has at most seven digits, so its product with the denominator fits a decimal.
    """

    def body(p: Column) -> Column:
        v, q = value.cast("decimal(30,7)") * p["sign"], quantum.cast("decimal(30,7)")
        half = (q * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(30,7)")
        over = lambda bound: (bound - p["whole"]).cast("decimal(31,7)")
        share = lambda gap: gap.try_cast("decimal(8,7)") * p["by"]
        at_least = lambda gap: F.when(gap <= 0, True).when(gap > 1, False).otherwise(F.coalesce(p["rest"] >= share(gap), F.lit(False)))
        equal = lambda gap: F.when((gap < 0) | (gap >= 1), False).otherwise(p["rest"] == share(gap))
        return F.when(q <= 0, equal(over(v))).otherwise(at_least(over(v - half)) & ~at_least(over(v + half)))

    return _magnitude(num, den, body)


def quotient(num: Column, den: Column, digits: int = 4) -> Column:
    """num / den to so many digits after the point, half up; null for no or a zero denominator."""

    def body(p: Column) -> Column:
        twice = (p["rest"] * (2 * 10**digits) + p["by"]).cast("decimal(38,0)")
        by = (p["by"] * 2).cast("decimal(30,0)")
        part = ((twice - twice % by) / by).cast("decimal(8,0)") * F.lit(f"{10**-digits:.{digits}f}").cast("decimal(8,6)")
        return ((p["whole"].try_cast("decimal(22,0)") + part) * p["sign"]).try_cast(DEC)

    return _magnitude(num, den, body)


def number_text(value: Column) -> Column:
    """Decimal without trailing zeros or exponent."""
    s = value.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def display(value: Column, unit: Column) -> Column:
    n = number_text(value)
    return F.when(unit == "percent", F.concat(n, F.lit("%"))).when(unit == "basis_points", F.concat(n, F.lit(" bps"))).when(unit == "currency", F.concat(F.lit("$"), n)).otherwise(n)


def quantum_of_decimals(decimals: Column) -> Column:
    """10 to minus ``decimals`` (of a tagged fact); 0, exact, where there are none."""
    table = F.create_map(*(F.lit(x) for d in range(-13, 7) for x in (d, f"{10**-d:.6f}" if d > 0 else str(10 ** (-d)))))
    return F.coalesce(F.element_at(table, decimals.cast("int")).try_cast(DEC), F.lit(0).cast(DEC))
