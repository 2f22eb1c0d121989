"""Collocations, fill-in-the-middle and archives against brute force, with nulls, empty and long texts, ties, copies and clashing columns."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import collocations, fill_middle, warc

SCHEMA = "doc_id long, text string, lang string, phrase string, key string, n long, at int, form string"


def corpus():
    rnd = random.Random(11)
    voc = ["Big", "apple", "pie", "new", "york", "City", "é", "漢字", "a", "b"]
    texts = [None, "", " \t", ".,;", "one", "New York City. new york\tcity, NEW YORK CITY", "a a a a a a", "line\n\n\nline", "x\r\ny\x0bz\n", "<P> in here\nmore", "< P>a\n<\n>b\nP>\n", "\n", "end\n"]
    texts += ["".join(rnd.choice(voc) + rnd.choice([" ", "  ", "\t", ". ", "\n", " , ", " "]) for _ in range(rnd.randrange(1, 80))) for _ in range(40)]
    texts += ["new york " * 9000 + "\n" + "big apple pie\n" * 3000]
    rows = [(i, t, [None, "en", "fr"][i % 3], "x", "y", 1, 2, "z") for i, t in enumerate(texts)]
    return rows + rows[5:7] + [(None, "no id\nat all\n", "en", "x", "y", 1, 2, "z"), (5, "other text\nof id 5", "en", "x", "y", 1, 2, "z")]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", low)]


def brute_phrases(rows, least, longest, covers, most):
    f = Counter((r[2] or "und", tuple(p[i : i + k])) for r in rows for p in pieces(r[1]) for k in range(1, longest + 1) for i in range(len(p) - k + 1))
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c * (len(p) == 1)
    found = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    out = []
    for (lang, p), a in found.items():
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if not any(la == lang and len(q) > len(p) and inside(q) and 100 * c >= covers * a for (la, q), c in found.items()):
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:most]
        ranked += [(x[0], i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(ranked)


@pytest.mark.parametrize(("least", "longest", "covers", "most", "shard"), [(10, 3, 50, 2000, 8 << 20), (2, 4, 70, 5, 200), (1, 2, 50, 3, 1), (3, 3, 101, 2000, 1000)])
def test_collocations(docs, least, longest, covers, most, shard):
    got = collocations.collocations(docs, least, longest, covers, most, shard)
    assert sorted(map(tuple, got.collect())) == brute_phrases(ROWS, least, longest, covers, most)


def test_collocations_empty(docs):
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.filter("text IS NULL")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    n = 3_100_000  # n * n * 1000000 needs 64 bits and more
    text = "a b." * n + "a." * 100_001 + "c b." * 1_000
    got = {r.phrase: r for r in collocations.collocations(spark.createDataFrame([(1, text, "en")], "doc_id int, text string, lang string")).collect()}
    assert got["a b"].score == 10**6 * n**2 // ((n + 100_001) * (n + 1_000))
    assert got["c b"].score == 10**6 * 1_000**2 // (1_000 * (n + 1_000))


def test_automaton_states():
    rnd = random.Random(2)
    for depth in (1, 2, 3, 4):
        symbol = np.array([rnd.randrange(4) for _ in range(60)])
        piece = np.sort(np.array([rnd.randrange(4) for _ in range(60)]))
        auto = collocations.BoundedAutomaton(symbol, piece, depth)
        ends = {}
        for i in range(60):
            for k in range(1, depth + 1):
                if i - k + 1 >= 0 and piece[i - k + 1] == piece[i]:
                    ends.setdefault(tuple(symbol[i - k + 1 : i + 1]), set()).add(i)
        by_end = {}
        for p, e in ends.items():
            by_end.setdefault(frozenset(e), []).append(p)
        want = {}
        for e, ps in by_end.items():
            top = max(ps, key=len)
            low = min(map(len, ps))
            want[top] = (low, len(e), top[-(low - 1) :] if low > 1 else None)
        top = lambda s: tuple(symbol[auto.end[s] - auto.longest[s] + 1 : auto.end[s] + 1])  # noqa: B023, E731
        got = {top(s): (auto.shortest[s], auto.places[s], top(auto.link[s]) if auto.link[s] >= 0 else None) for s in range(len(auto.end))}
        assert got == want
        assert sorted(c for k in range(1, depth + 1) for c in auto.phrases(k)[1]) == sorted(map(len, ends.values()))


def brute_fill(doc_id, text, seed, rate, spm):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or c % 100 >= rate:
        return doc_id, n, "plain", None, None, t
    if d % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (8, 60, 10)])
def test_fill_middle(docs, seed, rate, spm):
    out = fill_middle.fill_middle(docs, seed, rate, spm)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(brute_fill(r[0], r[1], seed, rate, spm)) for r in ROWS)
    back = out.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t"))
    assert Counter(map(tuple, back.collect())) == Counter((r[0], r[1] or "") for r in ROWS)
    assert fill_middle.fill_middle(docs.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, digest string, offset long, key string, archive string"


def pages_of():
    rnd = random.Random(3)
    same = "<p>same</p>" * 50
    rows = [(i, f"http://h{i % 3}/a b?é={i}\r\n", same if i % 3 == 0 else f"page {i} \r\n\r\n WARC/1.1\r\n\r\n é漢" * rnd.randrange(1, 30)) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (-5, "http://n/", ""), (None, "http://none/", "alone"), (None, "http://none/", same), (7, "http://again/", "page 7"), (7, "http://again/", "page 7"), (2**62, "http://big/", "x" * 3_000_000), (-(2**63), "u", "low")]
    return [(*r, "d", 1, "k", "a") for r in rows]


def test_archives(spark, tmp_path):
    rows = pages_of()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    folder = f"file://{tmp_path}/out"
    for least in (0, 100):
        index = warc.write_archives(pages, f"{folder}-{least}", least)
        held = {}
        for r in rows:
            held[r[2] or ""] = max(held.get(r[2] or "", -(2**63)), r[0] if r[0] is not None else -(2**63))
        counts = Counter(r[2] or "" for r in rows)
        want = []
        for r in rows:
            body = (r[2] or "").encode()
            again = len(body) >= least and counts[r[2] or ""] > 1 and r[0] != held[r[2] or ""]
            url = None if r[1] is None else warc._header_url(r[1])
            want.append((r[0], url, "revisit" if again else "response", held[r[2] or ""] if again else None, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), None if again else body))
        got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in warc.read_records(index).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        # Some records alone, and by small reads.
        some = warc.read_records(index.filter("page_id % 7 = 0"), payloads=False, most=500, gap=0)
        assert sorted(repr(tuple(r)) for r in some.collect()) == sorted(repr(w[:6]) for w in want if w[0] is not None and w[0] % 7 == 0)
        # An index made from the archives alone is the one that was written.
        again = warc.index_archives(index.select("archive"))
        own = lambda df: sorted(repr((r.archive, r.offset, r.length, r.record_id, r.page_id, r.record_type, r.digest)) for r in df.collect())
        assert own(again) == own(index)
        first = index.filter("offset = 0").first()
        raw = gzip.open(first.archive.removeprefix("file://")).read()
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.count(b"WARC-Record-ID") == index.filter(F.col("archive") == first.archive).count()
        warc.removed(index)
        assert not list((tmp_path / f"out-{least}").glob("*")) if (tmp_path / f"out-{least}").exists() else True


def test_archives_empty_and_damaged(spark, tmp_path):
    none = warc.write_archives(spark.createDataFrame([], PAGES), f"file://{tmp_path}/none")
    assert none.count() == 0 and warc.read_records(none).count() == 0
    warc.removed(none)
    raw, *_ = warc.write_record(4, "u", b"payload", "response", None)
    assert warc.read_record(raw)[-1] == b"payload"
    with pytest.raises(ValueError, match="differs"):
        warc.read_record(raw.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"))


def test_coalesced_reads():
    ranges = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 200, 900), ("b", 0, 1)]
    assert list(warc.coalesced(iter(ranges), most=100, gap=5)) == [("a", 0, 30, [(0, 10), (10, 10), (25, 5)]), ("a", 200, 1100, [(0, 900)]), ("b", 0, 1, [(0, 1)])]
    for p in (0, 1, -1, 2**63 - 1, -(2**63), None):
        assert warc.page_of(warc.record_id(p, b"x")) == p


def test_language_of_int_ids_and_clashing_columns(spark):
    """Ids of another type, repeated rows and columns named like the operator's own."""
    from tallyspark.llm import language_id

    rows = [(i, ("the cat sat on the mat and the dog " if i % 2 else "le chat est sur la table et le chien ") * (1 + i % 5), "en" if i % 2 else "fr") for i in range(60)]
    known = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = language_id.fit(known)
    asked = known.unionByName(known.limit(4)).unionByName(spark.createDataFrame([(900, None, None), (901, " 12 ", "en")], known.schema)).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)).withColumn("languages", F.lit(2))
    got = language_id.predict(asked, model).collect()
    want = {i: lang for i, _, lang in rows} | {900: "und", 901: "und"}
    assert len(got) == 66 and all(r.lang_pred == want[r.doc_id] for r in got)
