"""The walk over filings and the search of slots, each against a plain loop."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyspark.functions import periods as P
from tallyspark.sources import releases, search

FILING = "issuer string, pos int, accession string, filing_date string, report_date string, located boolean, text string"
WORDS = ("First", "Second", "Third", "Fourth")


def walk(filings, quarters):
    """Plain loop over (accession, date, key, stated, figures, located)."""
    held, missing = {}, []
    for acc, day, key, stated, n, located in filings:
        if not located:
            missing.append(acc)
            continue
        notes = ["none"] if n == 0 else []
        if key in held:
            now = held[key]
            win, lose = ((acc, day, stated, n, notes), now) if (stated, n) > (now[2], now[3]) else (now, (acc, day, stated, n, notes))
            held[key] = (*win[:4], [*win[4], lose[0]])
        elif len(held) < quarters:
            held[key] = (acc, day, stated, n, notes)
        else:
            soft = next((k for k, x in held.items() if not x[2]), None)
            if soft is None or not stated:
                break
            del held[soft]
            held[key] = (acc, day, stated, n, notes)
    return sorted(((x[1], x[0], k, x[2], x[3], x[4]) for k, x in held.items()), reverse=True), missing + ([f"short {len(held)}"] if len(held) < quarters else [])


def test_walk_is_the_loop(spark):
    rnd = random.Random(5)
    recent, pages, loops = [], [], {}
    for i in range(60):
        day, own = dt.date(2026, 6, 30), []
        for j in range(rnd.randrange(0, 22)):
            day -= dt.timedelta(days=rnd.randrange(0, 60))
            y, q = day.year, (day.month - 1) // 3 + 1
            stated, n, located = rnd.random() < 0.5, rnd.randrange(0, 3), rnd.random() < 0.85
            text = (f"Q {WORDS[q - 1]} quarter of {y} results. " if stated else "Update. ") + "$5 million; " * n if rnd.random() < 0.98 or stated or n else None
            row = (f"i{i}", j, f"{i:03}-{j:03}", str(day), str(day), located, text)
            own.append((row[2], row[3], f"FY{y}-Q{q}", stated, n, located))
            if j < 8 + i % 5:
                recent.append(row)
            else:
                pages.append((*row, "2024-01-01" if j < 16 else "2020-01-01"))
        if own:
            loops[f"i{i}"] = walk(own, 4)
    out = releases.walk_quarters(spark.createDataFrame(recent, FILING).repartition(3), spark.createDataFrame(pages, FILING + ", filing_to string").repartition(3), 4)
    got = {}
    for r in out.collect():
        notes = [[("none" if w == releases.NO_FIGURES else w.split(" also claimed by ")[1].split(" ")[0]) for w in x.warnings] for x in r.releases]
        missing = [m.split(":")[0] if "located" in m else f"short {m.split(' ')[3]}" for m in r.missing]
        got[r.issuer] = ([(x.filing_date, x.accession, x.key, x.stated, x.n_figures, n) for x, n in zip(r.releases, notes, strict=True)], missing)
        assert (r.requested, r.fetched) == (4, len(r.releases))
    assert got == loops


def test_noise_gives_way(spark):
    """Monthly figures of the quarter in progress are evicted by the oldest quarter asked for; guidance stays noted on the release it shares a quarter with."""
    rows = [("L", 0, "m", "2026-06-05", "2026-05-31", True, "losses of 4.5%"), *(("L", i, f"q{i}", d, d, True, f"L reports {w} quarter {y} results $1 $2") for i, (d, w, y) in enumerate([("2026-04-28", "first", 2026), ("2026-01-27", "fourth", 2025), ("2025-10-28", "third", 2025), ("2025-07-29", "second", 2025), ("2025-04-29", "first", 2025)], 1)), ("N", 0, "no-date", None, None, True, None)]
    got = {r.issuer: r for r in releases.walk_quarters(spark.createDataFrame(rows, FILING)).collect()}
    assert [(x.accession, x.key) for x in got["L"].releases] == [("q1", "FY2026-Q1"), ("q2", "FY2025-Q4"), ("q3", "FY2025-Q3"), ("q4", "FY2025-Q2")] and got["L"].missing == []
    assert [(x.accession, x.key, list(x.warnings)) for x in got["N"].releases] == [("no-date", "unstated:no-date", [releases.NO_FIGURES])]
    assert got["N"].missing == ["index satisfied only 1 of 4 requested quarters"]
    assert releases.walk_quarters(spark.createDataFrame([], FILING)).count() == 0


def test_archives_are_read_for_open_walks_alone(spark):
    """A full block that has ended the walk leaves its archives out, whatever they hold."""
    days = ["2026-04-01", "2026-01-01", "2025-10-01", "2025-07-01", "2025-04-01"]
    recent = [("A", i, f"a{i}", d, d, True, f"{WORDS[(int(d[5:7]) - 1) // 3]} quarter {d[:4]} $1") for i, d in enumerate(days)]
    older = [("A", 0, "old", "2026-04-01", "2026-04-01", True, "First quarter 2026 " + "$5 " * 9, "2026-04-01"), ("B", 0, "b", "2020-04-01", "2020-04-01", False, "x", None)]
    got = {r.issuer: r for r in releases.walk_quarters(spark.createDataFrame(recent, FILING), spark.createDataFrame(older, FILING + ", filing_to string")).collect()}
    assert [x.accession for x in got["A"].releases] == ["a0", "a1", "a2", "a3"] and not any(x.warnings for x in got["A"].releases)
    assert list(got["B"].missing) == ["b: no EX-99.1 located in the filing index", "index satisfied only 0 of 4 requested quarters"]


def test_slots(spark):
    latest = spark.createDataFrame([("A", 2026, 1), ("B", 2026, 1)], "issuer string, year int, quarter int")
    slots = search.slot_windows(latest, 4)
    assert [(r.slot, str(r.first), str(r.last)) for r in slots.filter("issuer = 'A'").orderBy("nth").collect()] == [("FY2026-Q1", "2026-04-05", "2026-07-04"), ("FY2025-Q4", "2026-01-05", "2026-04-05"), ("FY2025-Q3", "2025-10-05", "2026-01-03"), ("FY2025-Q2", "2025-07-05", "2025-10-03")]
    good, title = "up 5% " * 9, "A Reports Quarter Results"
    at = lambda s: dt.datetime.fromisoformat(s)
    rows = [
        ("A", 0, title, "https://sec.gov/edge", good, at("2026-04-05T23:59:59")),  # on both windows' edges
        ("A", 1, title, "https://www.prnewswire.com/late", good, at("2026-07-05T00:00:00")),  # a day late
        ("A", 2, title, "https://prnewswire.com/q3", good, at("2025-10-05T00:00:00")),
        ("A", 3, title, "https://x.q4cdn.com/q3", good + good, at("2026-01-03T12:00:00")),
        ("A", 4, title, "https://evil-sec.gov/q3", good, at("2025-12-01T00:00:00")),
        ("A", 5, "A to report quarter results", "https://sec.gov/adv", good, at("2025-08-01T00:00:00")),
        ("A", 6, None, None, None, at("2025-08-01T00:00:00")),
        ("B", 0, "B First Quarter 2031 Results", "https://sec.gov/b", good, at("2026-05-01T00:00:00")),
        ("B", 1, title, "https://sec.gov/b2", "x" * 200_000 + good, at("2026-02-01T00:00:00")),
    ]
    found = search.slot_results(slots, spark.createDataFrame(rows, "issuer string, pos int, title string, url string, text string, published timestamp"))
    assert sorted((r.issuer, r.slot, r.pos) for r in found.collect()) == [("A", "FY2025-Q2", 5), ("A", "FY2025-Q3", 2), ("A", "FY2025-Q3", 3), ("A", "FY2025-Q4", 0), ("A", "FY2026-Q1", 0), ("B", "FY2025-Q4", 1), ("B", "FY2026-Q1", 0)]
    chosen = search.choose_slots(slots, found)
    got = {(r.issuer, r.slot): (r.pos, r.period, r.assumed, r.reason) for r in chosen.collect()}
    assert got["A", "FY2026-Q1"] == (0, "FY2026-Q1", True, None)
    assert got["A", "FY2025-Q4"] == (None, None, None, "best result resolves to FY2025-Q4 (https://sec.gov/edge), already fetched")
    assert got["A", "FY2025-Q3"] == (3, "FY2025-Q3", True, None)  # the better source
    assert got["A", "FY2025-Q2"][3] == "no result titled as a quarterly results release (1 results, 1 advisories rejected)"
    assert got["B", "FY2026-Q1"][3].startswith("no result titled") and got["B", "FY2025-Q4"][3].startswith("1 title-matched")
    report = {r.issuer: r for r in search.search_report(chosen).collect()}
    assert (report["A"].requested, report["A"].fetched, len(report["A"].missing)) == (4, 2, 2) and report["A"].missing[0].startswith("FY2025-Q4: best result")
    assert (report["B"].fetched, [m.split(":")[0] for m in report["B"].missing]) == (0, ["FY2026-Q1", "FY2025-Q4", "FY2025-Q3", "FY2025-Q2"])
    many = [("A", i, title, f"https://sec.gov/{i}", good, at("2026-05-01T00:00:00")) for i in range(9, 0, -1)]
    assert sorted(r.pos for r in search.slot_results(slots, spark.createDataFrame(many, found.select("issuer", "pos", "title", "url", "text", "published").schema)).collect()) == [1, 2, 3, 4, 5]


def test_windows_of_quarters(spark):
    row = spark.range(1).select(P.quarters_back(F.lit(2026), F.lit(1), 4).alias("b")).first()
    assert list(row.b) == ["FY2026-Q1", "FY2025-Q4", "FY2025-Q3", "FY2025-Q2"]
