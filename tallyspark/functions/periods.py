"""Fiscal period keys ``FYyyyy[-Qn|-Hn|-9M|-FY]``: reading, arithmetic and inference, as Columns.

The patterns that the functions below read texts with are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for quarters, in the order in which they are looked for.
QUARTER_WORDS = {"first": 1, "second": 2, "third": 3, "fourth": 4}
ORDINALS = ("1st", "2nd", "3rd", "4th")
_FY = r"(?i)^FY(\d{4})(-.*)?$"
_FYQ = r"(?i)^FY(\d{4})-Q([1-4])"


def _int(x: Column) -> Column:
    return x.try_cast("int")


def _key(year: Column, quarter: Column) -> Column:
    return F.concat(F.lit("FY"), year.cast("string"), F.lit("-Q"), quarter.cast("string"))


def quarter_of(month: Column) -> Column:
    return F.floor((month - 1) / 3).cast("int") + 1


def prior_year(period: Column) -> Column:
    """Same span a year before; null if not a period."""
    return F.when(period.rlike(_FY), F.concat(F.lit("FY"), (_int(F.regexp_extract(period, _FY, 1)) - 1).cast("string"), F.regexp_extract(period, _FY, 2)))


def prior_quarter(period: Column, back: int = 1) -> Column:
    """The quarter ``back`` before; null if not a quarter."""
    n = _int(F.regexp_extract(period, _FYQ, 1)) * 4 + _int(F.regexp_extract(period, _FYQ, 2)) - 1 - back
    return F.when(period.rlike(r"(?i)^FY\d{4}-Q[1-4]$"), _key(F.floor(n / 4), F.pmod(n, F.lit(4)) + 1))


def next_quarter(period: Column) -> Column:
    n = _int(F.regexp_extract(period, _FYQ, 1)) * 4 + _int(F.regexp_extract(period, _FYQ, 2))
    return F.when(period.rlike(_FYQ), _key(F.floor(n / 4), F.pmod(n, F.lit(4)) + 1))


def period_rank(period: Column) -> Column:
    """Place on a quarter axis: a year ranks at its fourth quarter, a half at its last, nine months at the third."""
    whole = r"^FY(\d{4})(?:-(?:Q([1-4])|H([12])|9M))?$"
    q, h = F.regexp_extract(period, whole, 2), F.regexp_extract(period, whole, 3)
    n = F.when(q != "", _int(q)).when(h != "", _int(h) * 2).when(period.endswith("9M"), 3).otherwise(4)
    return F.when(period.rlike(whole), _int(F.regexp_extract(period, whole, 1)) * 4 + n).otherwise(0)


def _date(x: Column) -> Column:
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(x, 1, 10).try_cast("date"))


def occurrence_period(frame: Column, start: Column, end: Column) -> Column:
    """Key of a reported value: its calendar frame, else its dates; null for spans of other lengths."""
    f = r"^CY(\d{4})(?:Q([1-4]))?I?$"
    year, quarter = F.regexp_extract(frame, f, 1), F.regexp_extract(frame, f, 2)
    s, e = _date(start), _date(end)
    months = F.bround(F.datediff(e, s) / F.lit(30.44), 0).cast("int")
    closes = _key(F.year(e), F.quarter(e))
    fy = F.concat(F.lit("FY"), F.year(e).cast("string"))
    dated = (
        F.when(s.isNull() | (months == 3), closes)
        .when(months == 6, F.concat(fy, F.when(F.month(e) <= 6, "-H1").otherwise("-H2")))
        .when(months == 9, F.concat(fy, F.lit("-9M")))
        .when(months == 12, fy)
    )
    return F.when(F.coalesce(frame, F.lit("")).rlike(f), F.when(quarter != "", F.concat(F.lit("FY"), year, F.lit("-Q"), quarter)).otherwise(F.concat(F.lit("FY"), year))).when(e.isNotNull(), dated)


def _word_quarter(word: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in QUARTER_WORDS.items() for x in kv)), word)


def infer_document_period(title: Column, body: Column) -> Column:
    """Explicit key in the title, then the body; else a year (fiscal first) with the first quarter word in word order."""
    token = r"(?i)FY\d{4}-Q[1-4]"
    a, b = F.regexp_extract(F.coalesce(title, F.lit("")), token, 0), F.regexp_extract(F.coalesce(body, F.lit("")), token, 0)
    blob = F.lower(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(body, F.lit(""))))
    fiscal, any_year = F.regexp_extract(blob, r"(?U)(?:fiscal|fy)\s*(20\d\d)", 1), F.regexp_extract(blob, r"(?U)\b(20\d\d)\b", 1)
    year = F.when(fiscal != "", fiscal).when(any_year != "", any_year)
    words = [(form, n) for w, n in QUARTER_WORDS.items() for form in (w, ORDINALS[n - 1], f"q{n}")]
    quarter = F.coalesce(*(F.when(blob.rlike(rf"\b{w}\b"), F.lit(n)) for w, n in words))
    return F.when(a != "", F.upper(a)).when(b != "", F.upper(b)).when(year.isNotNull() & quarter.isNotNull(), _key(year, quarter))


def infer_release_period(head: Column, report_date: Column) -> Column:
    """The quarter that a release states, else the calendar quarter of its report date."""
    stated = stated_quarter(head)
    d = r"^(\d{4})-(\d{2})-\d{2}"
    by_date = F.when(F.coalesce(report_date, F.lit("")).rlike(d), _key(F.regexp_extract(report_date, d, 1), quarter_of(_int(F.regexp_extract(report_date, d, 2)))))
    return F.coalesce(stated, by_date)


def stated_quarter(head: Column) -> Column:
    """``Third Quarter 2025``: the quarter with a year within sixty characters after it that hold no full stop or line feed."""
    t = r"(?is)\b(first|second|third|fourth)\s+quarter\b[^.\n]{0,60}?\b(20\d\d)\b"
    return F.when(head.rlike(t), _key(F.regexp_extract(head, t, 2), _word_quarter(F.lower(F.regexp_extract(head, t, 1)))))


def guidance_period(sentence: Column, base: Column) -> Column:
    """Target period of a guidance sentence: full year, named quarter, or the quarter after ``base``."""
    stated = F.regexp_extract(sentence, r"(?i)(?:fiscal(?:\s+year)?|fy)\s*(20\d\d)", 1)
    year = F.when(stated != "", stated).otherwise(F.nullif(F.regexp_extract(base, r"(?i)^FY(\d{4})", 1), F.lit("")))
    word = F.lower(F.regexp_extract(sentence, r"(?i)\b(first|second|third|fourth)[\s-]+quarter\b", 1))
    full = sentence.rlike(r"(?i)\b(full[- ]year|full fiscal year|fiscal year|for the year)\b")
    return F.when(full, F.concat(F.lit("FY"), year, F.lit("-FY"))).when((word != "") & year.isNotNull(), _key(year, _word_quarter(word))).otherwise(next_quarter(base))


def reporting_window(year: Column, quarter: Column) -> Column:
    """First and last day on which a quarter's results appear: 5 to 95 days after it ends."""
    end = F.last_day(F.make_date(year, quarter * 3, F.lit(1)))
    return F.struct(F.date_add(end, 5).alias("first"), F.date_add(end, 95).alias("last"))


def quarters_back(year: Column, quarter: Column, count: int) -> Column:
    """``count`` quarters ending at the given one, newest first, as keys."""
    n = year * 4 + quarter - 1
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: _key(F.floor((n - i) / 4), F.pmod(n - i, F.lit(4)) + 1))


def previous_calendar_quarter(day: Column) -> Column:
    d = F.add_months(day, -3)
    return _key(F.year(d), F.quarter(d))
