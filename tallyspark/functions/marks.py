"""Places of a pattern in texts, as rows: the text is marked, split at the marks, and lengths are summed up by a window.

No place is searched for a second time, so a figure's place is that of its match and not of an equal string before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARK, _INSTEAD = "\ue000", "\ue001"  # private use: no pattern means them, and they have no case


def _pieces(text: Column, pattern: Column, found: str) -> Column:
    clean = F.translate(F.coalesce(text, F.lit("")), _MARK, _INSTEAD)
    return F.split(F.regexp_replace(clean, pattern, F.lit(f"{_MARK}{found}{_MARK}")), _MARK, -1)


def _rows(texts: DataFrame, keys: list[str], pieces: Column, counts: bool) -> DataFrame:
    """``found``, ``start`` and ``end`` of each match; whether a match's own characters count, or are an addition to the text."""
    item = lambda p, i: F.struct(F.when(i % 2 == 1, p).alias("found"), F.when((i % 2 == 0) | F.lit(counts), F.length(p)).otherwise(0).alias("n"))
    each = texts.select(*keys, F.posexplode(F.transform(pieces, item)).alias("i", "p")).select(*keys, "i", "p.*")
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = each.withColumn("upto", upto).filter("i % 2 = 1")
    start = F.col("upto") - F.col("n") if counts else F.col("upto")
    return rows.select(*keys, "found", start.alias("start"), (start + F.length("found")).alias("end"))


def matches(texts: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """Matches of a Java pattern in the column ``text``, from left to right: ``keys`` (which name a row), ``found``, ``start`` and ``end`` (code points)."""
    return _rows(texts, keys, _pieces(F.col(text), F.lit(pattern), "$0"), True)


def starts(texts: DataFrame, keys: list[str], text: str, pattern: str | Column) -> DataFrame:
    """As ``matches`` for what begins at each place, inside of other matches too: the pattern's first group is looked for ahead of every character."""
    ahead = F.lit(f"(?=({pattern}))") if isinstance(pattern, str) else F.concat(F.lit("(?=("), pattern, F.lit("))"))
    return _rows(texts, keys, _pieces(F.col(text), ahead, "$1"), False)


def literal(phrase: Column) -> Column:
    r"""A pattern that means the phrase itself."""
    return F.concat(F.lit(r"\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
