"""Fill-in-the-middle: each text cut in three at unit boundaries, as joins over a table of units.

A unit is a line with its line feed (or the last line without one). The table of units has a row for each unit of each text with
the running sum of lengths up to it, by posexplode and a window. A text asks for two cuts, drawn from a hash of its id; a request joins
the unit of its ordinal, and the offsets that it finds are brought together per text, which is then cut by substring. All of it is DataFrame functions.

The unit table is keyed by 128 bits of SHA-256 over id and text, so rows of one id with unequal texts stay apart and
equal rows share their cuts. Its rows hold lengths, never text; a text moves once, to meet its offsets, and isn't sorted for that.

A plain text is one that is empty, holds a mark, or isn't drawn at ``rate`` percent. Of the others ``spm_rate`` percent put the suffix first.

Cases: null text is empty and so plain; a null id draws as an empty one; a text of one line has two cuts of 0 or all of it;
extra columns are left out, so they can't clash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = "<[PSM]>"


def _draw(seed: int, i: int) -> Column:
    """The i-th group of eight hex digits of the id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def unit_offsets(docs: DataFrame, unit: str = UNIT) -> DataFrame:
    """``key``, ``doc_id``, ``n`` (units of the text), ``at`` (units before the place, from 0) and ``upto`` (their code points).

    ``docs`` has ``key``, ``doc_id`` and ``text``.
    """
    lengths = F.transform(F.regexp_extract_all("text", F.lit(unit), F.lit(0)), lambda u: F.length(u))
    texts = docs.select("key", "doc_id", lengths.alias("lengths")).groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("lengths").alias("lengths"))
    units = texts.select("key", "doc_id", F.size("lengths").cast("long").alias("n"), F.posexplode(F.concat(F.array(F.lit(0)), "lengths")).alias("at", "len"))
    return units.selectExpr("key", "doc_id", "n", "at", "sum(len) OVER (PARTITION BY key ORDER BY at ROWS UNBOUNDED PRECEDING) AS upto")


def cut_offsets(docs: DataFrame, seed: int = 7, unit: str = UNIT) -> DataFrame:
    """``key``, ``n``, ``first`` and ``second`` cut (code points before it) of each text of ``docs`` (``key``, ``doc_id``, ``text``)."""
    units = unit_offsets(docs, unit)
    one, two = (F.pmod(_draw(seed, i), F.col("n") + 1) for i in (1, 2))
    requests = units.filter("at = 0").select("key", F.least(one, two).alias("lo"), F.greatest(one, two).alias("hi"))
    met = units.join(requests, "key").filter("at = lo OR at = hi")  # one request a text, so the side that is held is a row
    return met.groupBy("key").agg(F.first("n").alias("n"), F.min("upto").alias("first"), F.max("upto").alias("second"))


def fill_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = UNIT) -> DataFrame:
    """``doc_id``, ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    ``docs`` needs ``doc_id`` and ``text``.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    said = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))
    keyed = own.withColumn("key", F.unhex(F.left(F.sha2(said, 256), F.lit(32))))
    offsets = cut_offsets(keyed, seed, unit)
    plain = (F.col("text") == "") | F.col("text").rlike(_MARKS) | (F.pmod(_draw(seed, 3), F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(_draw(seed, 4), F.lit(100)) < spm_rate, "spm").otherwise("psm")
    rows = keyed.join(offsets.hint("shuffle_hash"), "key").withColumn("form", form)
    part = lambda begin, end: F.substring(F.col("text"), (begin + 1).cast("int"), (end - begin).cast("int"))
    first, second = F.col("first"), F.col("second")
    prefix, middle, suffix = part(F.lit(0), first), part(first, second), part(second, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = F.col("form") != "plain"
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", F.when(cut, first).alias("prefix_chars"), F.when(cut, second - first).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A cut text holds no mark, and none can arise at a seam, so the marks part it."""
    parts = F.split(output, _MARKS, -1)
    get = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(get(1), get(3), get(2))).when(form == "spm", F.concat(get(2), get(3), get(1))).otherwise(output)
