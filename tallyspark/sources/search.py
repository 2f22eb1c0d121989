"""Releases from search results: one slot a quarter, results by publication window, the best of each slot, and what is missing.

``results`` have issuer, pos (rank in the search), title, url, text and published (timestamp); ``slots`` come from ``slot_windows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from .releases import ADVISORY, DOMAINS, QUARTERISH, RESULTISH, distinct_slots, domain_rank, figure_count, label_periods

#: Results taken for a slot, characters of a text, figures that a release has at least.
RESULTS, CHARACTERS, FIGURES = 5, 200_000, 8
DAYS = 91  # of a bucket; a window touches two or three


def slot_windows(latest: DataFrame, quarters: int = 4) -> DataFrame:
    """Slots of the last ``quarters`` up to the latest (issuer, year, quarter), newest first, with the days on which their results appear."""
    keys = P.quarters_back(F.col("year"), F.col("quarter"), quarters)
    each = latest.select("issuer", F.posexplode(keys).alias("nth", "slot"))
    year, quarter = F.substring("slot", 3, 4).cast("int"), F.substring("slot", 9, 1).cast("int")
    return each.select("issuer", "nth", "slot", year.alias("year"), P.reporting_window(year, quarter).alias("w")).select("issuer", "nth", "slot", "year", "w.*")


def allowed(url: Column, domains: tuple[str, ...] = tuple(DOMAINS)) -> Column:
    """Whether an address is of one of the domains or below one."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    one = F.lit(False)
    for d in domains:
        one = one | (host == d) | host.endswith(f".{d}")
    return one


def slot_results(slots: DataFrame, results: DataFrame, most: int = RESULTS, characters: int = CHARACTERS, domains: tuple[str, ...] = tuple(DOMAINS)) -> DataFrame:
    """The first ``most`` results of each slot: of an allowed domain, published in its window, text cut to ``characters``.

    Windows and days meet in buckets of days, an equi-join whose rows grow with the matches; the limit is taken in each task before rows of a slot move.
    """
    day = F.to_date("published")
    bucket = lambda d: F.floor(F.unix_date(d) / F.lit(DAYS))
    open_days = slots.withColumn("bucket", F.explode(F.sequence(bucket(F.col("first")), bucket(F.col("last")))))
    found = results.filter(allowed(F.col("url"), domains)).select("issuer", "pos", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.left(F.coalesce("text", F.lit("")), F.lit(characters)).alias("text"), "published", bucket(day).alias("bucket"))
    met = found.join(open_days, ["issuer", "bucket"]).filter(F.to_date("published").between(F.col("first"), F.col("last")))
    nth = F.row_number().over(Window.partitionBy("issuer", "slot").orderBy("pos", "url"))
    return met.withColumn("k", nth).filter(F.col("k") <= most).select("issuer", "slot", "year", "pos", "title", "url", "text", "published")


def choose_slots(slots: DataFrame, results: DataFrame, min_figures: int = FIGURES) -> DataFrame:
    """A row for each slot: its release (pos, title, url, text, published, n_figures, period, assumed), or the ``reason`` why there is none.

    A release is titled as quarterly results, not as an advisory, nor with years that are all far off; has ``min_figures``; and is of the best source, then has
    the most figures, then comes first. Slots are settled newest first: a release whose quarter or address is taken is left out.
    """
    title = F.col("title")
    years = F.transform(F.regexp_extract_all(title, F.lit(r"(?U)\b(20\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    near = (F.size(years) == 0) | F.exists(years, lambda y: F.abs(y - F.col("year")) <= 1)
    advisory = title.rlike(ADVISORY)
    rows = results.withColumn("advisory", advisory).withColumn("titled", ~advisory & title.rlike(QUARTERISH) & title.rlike(RESULTISH) & near)
    rows = rows.withColumn("n_figures", F.when(F.col("titled"), figure_count(F.col("text"))))
    fits = F.col("titled") & (F.col("n_figures") >= min_figures)
    order = F.struct(domain_rank(F.col("url")), -F.col("n_figures"), F.col("pos"))
    release = F.struct("pos", "title", "url", "text", "published", "n_figures")
    count = lambda c: F.sum(c.cast("int"))
    best = rows.groupBy("issuer", "slot").agg(F.count(F.lit(1)).alias("n"), count(F.col("advisory")).alias("advisories"), count(F.col("titled")).alias("n_titled"), F.min_by(F.when(fits, release), F.when(fits, order)).alias("r"))
    all_slots = slots.select("issuer", "nth", "slot").join(best, ["issuer", "slot"], "left").select("issuer", "nth", "slot", "n", "advisories", "n_titled", "r.*")
    labelled = label_periods(all_slots)
    kept = distinct_slots(labelled.filter("pos IS NOT NULL").select("issuer", "slot", "period", "url")).select("issuer", "slot", F.lit(True).alias("kept"))
    out = labelled.join(kept, ["issuer", "slot"], "left")
    reason = (
        F.when(F.col("n").isNull(), "no results")
        .when(F.col("n_titled") == 0, F.concat(F.lit("no result titled as a quarterly results release ("), F.col("n").cast("string"), F.lit(" results, "), F.col("advisories").cast("string"), F.lit(" advisories rejected)")))
        .when(F.col("pos").isNull(), F.concat(F.col("n_titled").cast("string"), F.lit(" title-matched result(s) but none contained figures — likely shell pages or truncated text")))
        .when(F.col("kept").isNull(), F.concat(F.lit("best result resolves to "), F.col("period"), F.lit(" ("), F.col("url"), F.lit("), already fetched")))
    )
    cut = {c: F.when(F.col("kept"), F.col(c)).alias(c) for c in ("pos", "title", "url", "text", "published", "n_figures", "period", "assumed")}
    return out.withColumn("reason", reason).select("issuer", "nth", "slot", *cut.values(), "reason")


def search_report(chosen: DataFrame) -> DataFrame:
    """Of each issuer: slots requested and fetched, and the notes of those that are missing, newest first."""
    note = F.when(F.col("reason").isNotNull(), F.struct("nth", F.concat_ws(": ", "slot", "reason").alias("note")))
    notes = F.transform(F.array_sort(F.collect_list(note)), lambda n: n["note"])  # as many as slots were asked for
    return chosen.groupBy("issuer").agg(F.count(F.lit(1)).alias("requested"), F.count("period").alias("fetched"), notes.alias("missing"))
