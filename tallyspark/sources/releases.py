"""Choosing earnings releases from filing and search tables: exhibits, duplicates, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P

#: Source authority (smaller is better) and title patterns.
DOMAINS = {"sec.gov": 0, "q4cdn.com": 1, "prnewswire.com": 2, "businesswire.com": 2}
ADVISORY = r"(?iU)\bto\s+(announce|report|release|host|webcast|discuss)\b"
QUARTERISH = r"(?iU)\bquarter|\bq[1-4]\b"
RESULTISH = r"(?iU)\bresults?\b|\bearnings\b"
_W = r"(?:billion|million|thousand|trillion|bn|mm|[bmkt])"
_F = r"(?:billion|million|thousand|trillion)"
FIGURE = (
    rf"(?iU)(?:(?<![\d.])-?\$\s?\(\s?\d[\d,]*(?:\.\d+)?\s*{_W}?\s?\)|(?<![\d.])-?\$\s?-?\d[\d,]*(?:\.\d+)?\s*{_W}?\b|(?<![\d.$])-?\b\d[\d,]*(?:\.\d+)?\s{_F}\b)"
    r"|(?<![\d.])-?\b\d{1,3}(?:\.\d+)?\s?%|\b\d{1,4}(?:\.\d+)?\s?(?:bps|basis points)\b"
)


def figures(text: Column) -> Column:
    """All figures of a text, as written."""
    return F.regexp_extract_all(text, F.lit(FIGURE), F.lit(0))


def figure_count(text: Column) -> Column:
    return F.size(figures(text)).cast("long")


def domain_rank(url: Column) -> Column:
    out = F.lit(9)
    for d, r in reversed(DOMAINS.items()):
        out = F.when(F.contains(url, F.lit(d)), r).otherwise(out)
    return out


def choose_candidates(results: DataFrame, min_figures: int = 8) -> DataFrame:
    """The best search result of each slot (slot, year, pos, title, url, text): authority, then figures, then order."""
    title = F.coalesce("title", F.lit(""))
    years = F.transform(F.regexp_extract_all(title, F.lit(r"(?U)\b(20\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    near = (F.size(years) == 0) | F.exists(years, lambda y: F.abs(y - F.col("year")) <= 1)
    rows = results.filter(~title.rlike(ADVISORY) & title.rlike(QUARTERISH) & title.rlike(RESULTISH) & near).withColumn("n_figures", figure_count(F.coalesce("text", F.lit("")))).withColumn("rank", domain_rank(F.coalesce("url", F.lit(""))))
    best = F.row_number().over(Window.partitionBy("slot").orderBy("rank", F.desc("n_figures"), "pos"))
    return rows.filter(F.col("n_figures") >= min_figures).withColumn("k", best).filter("k = 1").drop("k")


def label_periods(chosen: DataFrame) -> DataFrame:
    """The quarter that a release states, else its slot, and whether it was assumed."""
    stated = P.stated_quarter(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.substring("text", 1, 400)))
    return chosen.withColumn("period", F.coalesce(stated, F.col("slot"))).withColumn("assumed", stated.isNull())


_SLOT = "struct<slot:string,period:string,url:string>"


def distinct_slots(chosen: DataFrame) -> DataFrame:
    """Newest slot first, a release whose period or address an earlier slot has taken is left out.

    Which slots stay is a fold over the slots of an issuer, a few structs without texts.
    """
    slots = F.array_sort(F.collect_list(F.struct("slot", "period", F.coalesce("url", F.lit("")).alias("url")).cast(_SLOT)), lambda a, b: F.when(a["slot"] > b["slot"], -1).when(a["slot"] < b["slot"], 1).otherwise(0))
    taken = lambda kept, x: F.exists(kept, lambda k: (k["period"] == x["period"]) | ((k["url"] != "") & (k["url"] == x["url"])))
    kept = F.aggregate(slots, F.array().cast(f"array<{_SLOT}>"), lambda kept, x: F.when(taken(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    open_slots = chosen.groupBy("issuer").agg(kept.alias("kept")).select("issuer", F.explode(F.transform("kept", lambda k: k["slot"])).alias("slot"))
    return chosen.join(open_slots, ["issuer", "slot"], "left_semi")


def claimed_quarter(releases: DataFrame) -> DataFrame:
    """The quarter each filing claims (``key``), and whether its own text states it (``stated``)."""
    own = P.stated_quarter(F.substring("text", 1, 400))
    fallback = F.coalesce(P.infer_release_period(F.lit(""), F.col("report_date")), F.concat(F.lit("unstated:"), F.col("accession")))
    return releases.withColumn("stated", own.isNotNull()).withColumn("key", F.coalesce(own, fallback)).withColumn("n_figures", figure_count(F.col("text")))


_HELD = "struct<key:string,accession:string,filing_date:string,stated:boolean,n_figures:bigint,warnings:array<string>>"
_STATE = f"struct<held:array<{_HELD}>,missing:array<string>,done:boolean>"
NO_FIGURES = "no figures detected in text"


def _start() -> Column:
    return F.struct(F.array().alias("held"), F.array().alias("missing"), F.lit(False).alias("done")).cast(_STATE)


def _state(held: Column, missing: Column, done: Column | bool) -> Column:
    return F.struct(held.alias("held"), missing.alias("missing"), (F.lit(done) if isinstance(done, bool) else done).alias("done")).cast(_STATE)


def _better(now: Column, x: Column) -> Column:
    """The better of two filings for one quarter, with a note of the other: a stated quarter, then more figures, then the newer."""
    wins = (x["stated"] & ~now["stated"]) | ((x["stated"] == now["stated"]) & (x["n_figures"] > now["n_figures"]))

    def kept(one: Column, other: Column) -> Column:
        note = F.concat(one["key"], F.lit(" also claimed by "), other["accession"], F.lit(" (filed "), other["filing_date"], F.lit(", "), other["n_figures"].cast("string"), F.lit(" figures) — kept this release"))
        return F.struct(*(one[c].alias(c) for c in ("key", "accession", "filing_date", "stated", "n_figures")), F.concat(one["warnings"], F.array(note)).alias("warnings")).cast(_HELD)

    return F.when(wins, kept(x, now)).otherwise(kept(now, x))


def _walked(state: Column, filings: Column, quarters: int) -> Column:
    """The state after filings (newest first): a fold, which takes no more once it is done."""

    def step(s: Column, x: Column) -> Column:
        held, missing = s["held"], s["missing"]
        same = F.exists(held, lambda h: h["key"] == x["key"])
        soft = F.array_position(F.transform(held, lambda h: h["stated"]), False)  # the first that isn't stated gives way
        others = F.filter(held, lambda h, i: i + 1 != soft)
        return (
            F.when(s["done"], s)
            .when(~x["located"], _state(held, F.concat(missing, F.array(F.concat(x["filing"]["accession"], F.lit(": no EX-99.1 located in the filing index")))), False))
            .when(same, _state(F.transform(held, lambda h: F.when(h["key"] == x["key"], _better(h, x["filing"])).otherwise(h)), missing, False))
            .when(F.size(held) < quarters, _state(F.concat(held, F.array(x["filing"])), missing, False))
            .when(x["filing"]["stated"] & (soft > 0), _state(F.concat(others, F.array(x["filing"])), missing, False))
            .otherwise(_state(held, missing, True))
        )

    return F.aggregate(filings, state, step)


def _listed(filings: DataFrame, order: list[str]) -> DataFrame:
    """The filings of each issuer as one array in the order of the index: digests of the texts, no texts."""
    rows = claimed_quarter(filings.withColumn("text", F.coalesce("text", F.lit(""))))
    warn = F.when(F.col("n_figures") == 0, F.array(F.lit(NO_FIGURES))).otherwise(F.array().cast("array<string>"))
    filing = F.struct("key", "accession", "filing_date", "stated", "n_figures", warn.alias("warnings")).cast(_HELD)
    item = F.struct(*order, F.struct(F.col("located").alias("located"), F.col("key").alias("key"), filing.alias("filing")).alias("x"))
    return rows.groupBy("issuer").agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]).alias("filings"))  # as many as a company files


def walk_quarters(recent: DataFrame, archives: DataFrame | None = None, quarters: int = 4) -> DataFrame:
    """The newest ``quarters`` distinct quarters of each issuer, and what could not be had: one row an issuer.

    ``recent`` are the filings of an index's recent block: issuer, pos (place in the index, newest first), accession, filing_date, report_date,
    located (whether an exhibit was found) and text. ``archives`` have ``filing_to`` (last day of their page) besides.
    Filings are taken in the index's order, archive pages from the newest on. Of two for one quarter the one that states it wins, then the one with more figures, then the
    newer, and the other is noted. Once the window is full, an older stated quarter takes the place of the first one that isn't stated; the first that can't ends the walk.
    Only archives of issuers whose recent block has not ended the walk are read.

    Columns: issuer, requested, fetched, releases (newest filing first), missing.
    """
    state = _listed(recent, ["pos"]).select("issuer", _walked(_start(), F.col("filings"), quarters).alias("state"))
    if archives is not None:
        ended = state.filter("state.done").select("issuer")
        page = -F.unix_date(F.coalesce(F.try_to_date("filing_to"), F.lit("0001-01-01").cast("date")))
        older = _listed(archives.join(ended, "issuer", "left_anti").withColumn("page", page), ["page", "pos"])
        walked = _walked(F.coalesce("state", _start()), F.col("filings"), quarters)
        state = state.join(older, "issuer", "full").select("issuer", F.when(F.col("filings").isNull(), F.col("state")).otherwise(walked).alias("state"))
    dated = lambda h: F.struct(F.coalesce(h["filing_date"], F.lit("")), F.coalesce(h["accession"], F.lit("")))
    newest = lambda a, b: F.when(dated(a) > dated(b), -1).when(dated(a) < dated(b), 1).otherwise(0)
    releases, n = F.array_sort("state.held", newest), F.size("state.held")
    short_by = F.when(n < quarters, F.array(F.concat(F.lit("index satisfied only "), n.cast("string"), F.lit(f" of {quarters} requested quarters")))).otherwise(F.array().cast("array<string>"))
    return state.select("issuer", F.lit(quarters).alias("requested"), n.alias("fetched"), releases.alias("releases"), F.concat("state.missing", short_by).alias("missing"))


def select_quarters(releases: DataFrame, quarters: int = 4) -> DataFrame:
    """One row for each release that ``walk_quarters`` keeps, of filings in order of date."""
    order = Window.partitionBy("issuer").orderBy(F.desc("filing_date"), F.desc("accession"))
    rows = releases.withColumn("pos", F.row_number().over(order)).withColumn("located", F.lit(True))
    return walk_quarters(rows, None, quarters).select("issuer", F.explode("releases").alias("r")).select("issuer", "r.*")


def exhibit_links(index_pages: DataFrame) -> DataFrame:
    """Link of the release in a filing's index page: the exact exhibit row, else the first of its family."""
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    each = index_pages.select("accession", "base", F.posexplode(rows).alias("i", "row")).withColumn("href", F.regexp_extract("row", r"""(?i)href=["']([^"']+)["']""", 1)).filter("href <> ''")
    kind = F.when(F.col("row").rlike(r"(?iU)>\s*EX-99\.1\s*<"), 0).when(F.col("row").rlike(r"(?iU)>\s*EX-99(\.\d+)?\s*<"), 1)
    best = each.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("accession", "base").agg(F.min_by("href", F.struct("kind", "i")).alias("href"))
    return best.select("accession", absolute_url(F.col("href"), F.col("base")).alias("url"))


def absolute_url(href: Column, base: Column) -> Column:
    bare = F.regexp_replace(href, r"^/ix\?doc=", "")
    return F.when(bare.startswith("http"), bare).when(bare.startswith("/"), F.concat(F.lit("https://www.sec.gov"), bare)).otherwise(F.concat_ws("/", base, bare))


def listed_exhibits(listings: DataFrame) -> DataFrame:
    """Fallback by file name: names with the exhibit's number first, web pages before PDF."""
    names = listings.select("accession", F.posexplode("names").alias("i", "name"))
    ok = F.lower("name").rlike(r"\.(htm|html|pdf)$") & F.lower("name").rlike(r"ex[-_]?99|99[-_.]?1|press|earnings|release")
    order = F.struct(~F.contains("name", F.lit("99")), F.lower("name").endswith(".pdf"), F.col("i"))
    return names.filter(ok).groupBy("accession").agg(F.min_by("name", order).alias("name"))


def release_title(text: Column) -> Column:
    reports = F.trim(F.regexp_extract(text, r"(?im)^.{0,100}\breports\b.{0,100}$", 0))
    first = F.substring(F.trim(F.regexp_extract(text, r"(?m)^.*\S.*$", 0)), 1, 120)
    return F.coalesce(F.nullif(reports, F.lit("")), F.nullif(first, F.lit("")), F.lit("(empty document)"))
