"""Payloads as text: canonical JSON against Python's, feeds and cases from files, files of releases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.canonical import canonical, float_text
from tallyspark.sources import payloads as P
from tallyspark.sources import sink


def value(rnd, depth):
    kind = rnd.randrange(9 if depth else 7)
    if kind == 7:
        return {rnd.choice(["b", "a", "é", "Z", "zz", "a b", 'q"', "\U0001f600", "", "10", "9"]): value(rnd, depth - 1) for _ in range(rnd.randrange(0, 5))}
    if kind == 8:
        return [value(rnd, depth - 1) for _ in range(rnd.randrange(0, 12))]
    return [None, True, False, rnd.choice(["", "x", "é漢\U0001f600\n\t\"\\/\x01", "a,b:{}[]", "null"]), rnd.randrange(-(10**12), 10**12), rnd.choice([0.5, -1.25, 1e-7, 3.0, 1e22, 123456789.125, 1.5e300, 0.0001]), rnd.choice([0, -1, 2**62, 12345678901234567890])][kind]


def test_canonical_is_python_s(spark):
    rnd = random.Random(8)
    docs = [value(rnd, 5) for _ in range(150)] + [{}, [], {"a": {}}, [[]], {"b": [1, {"d": 1, "c": [None, {"z": 1, "y": []}]}], "a": 2}, list(range(12))]
    texts = [json.dumps(d, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 2])) for d in docs]
    rows = spark.createDataFrame([*enumerate(texts), (999, "{broken"), (998, None)], "id int, t string").repartition(3)
    got = {r.id: r.canonical for r in canonical(rows, "id", "t").collect()}
    assert len(got) == len(docs) + 2 and got[999] is None and got[998] is None
    for i, d in enumerate(docs):
        assert got[i] == json.dumps(json.loads(texts[i]), sort_keys=True, separators=(",", ":")), texts[i]


def test_floats(spark):
    rnd = random.Random(1)
    xs = [0.0, -0.0, 1.0, 1e15, 1e16, 123456789012345680.0, 1e-4, 1e-5, 9.999e-5, 1.7976931348623157e308, 0.1, 100.0, 12345.678] + [rnd.uniform(-1, 1) * 10 ** rnd.randrange(-20, 25) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(float_text(F.col("x"))).collect()]
    assert got == [json.dumps(x) for x in xs]


def test_nesting_has_a_limit(spark):
    deep = "[" * 6 + "]" * 6
    assert canonical(spark.createDataFrame([(1, deep)], "id int, t string"), "id", "t", 6).first().canonical == deep
    with pytest.raises(Exception, match="levels"):
        canonical(spark.createDataFrame([(1, deep)], "id int, t string"), "id", "t", 4).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "s", "tenant": "t", "filing_fixture": "f", "cases": [{"id": "1", "entity": "E", "metric": "m", "period": "P", "text": "$1", "expected": "traced"}, {"id": "2"}]}, indent=1))
    (tmp_path / "b.json").write_text('{"cases": 5}')
    (tmp_path / "c.json").write_text("[1, 2]")
    (tmp_path / "d.json").write_text("{")
    (tmp_path / "e.json").write_text(json.dumps({"accession": "x", "entity": "E", "facts": [{"tag": "us-gaap:Revenues", "period": "FY2031-Q1", "value": "5", "decimals": -3}]}))
    (tmp_path / "f.json").write_text(json.dumps({"cik": 7, "facts": {"us-gaap": {"New Name": {"label": "L", "units": {"USD": [{"end": "2031-03-31", "val": 5}, {"val": 1.5}], "odd": {"x": 1}}}, "Bad": 3}}}))
    rows = P.read_payloads(spark, str(tmp_path))
    name = lambda f: f.rsplit("/", 1)[-1]
    assert sorted(name(r.file) for r in P.corrupt(rows).collect()) == ["c.json", "d.json"]
    cases = sorted((r.pos, r.name, r.id, r.expected) for r in P.golden_cases(rows).collect())
    assert cases == [(0, "s", "1", "traced"), (1, "s", "2", None)]
    assert [(r.accession, r.facts[0].tag, r.facts[0].decimals) for r in P.instances(rows).collect()] == [("x", "us-gaap:Revenues", -3)]
    units, odd = P.feed_units(rows)
    got = units.collect()
    assert [(r.cik, r.entity, r.concept, r.label, r.u, [(o.end, o.val) for o in r.occ]) for r in got] == [(7, "7", "New Name", "L", "USD", [("2031-03-31", "5"), (None, "1.5")])]
    assert sorted((name(r.file), r.concept, r.u) for r in odd.collect()) == [("f.json", "Bad", None), ("f.json", "New Name", "odd")]


def test_release_files(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([("E", "FY2031-Q1", "a1", "one é"), ("E", "FY2031-Q1", "a2", "two"), ("E/x", None, "a3", None), ("F", None, None, "four")], "entity string, period string, accession string, text string").repartition(3)
    sink.write_release_files(rows, str(out))
    read = lambda: {p.name: p.read_text() for p in out.rglob("*") if p.is_file()}
    want = {"E-FY2031-Q1.txt": "two", "E_x-a3.txt": "", "F-unknown.txt": "four"}
    assert read() == want
    fails = rows.withColumn("text", F.when(F.col("entity") == "F", F.raise_error(F.lit("lost")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        sink.write_release_files(fails, str(out))
    assert read() == want  # nothing is left of it
    sink.write_release_files(rows.filter("entity = 'F'"), str(out), overwrite=True)
    assert read() == {"F-unknown.txt": "four"}
    report = spark.createDataFrame([("E", "s", 4, 1, ["FY2031-Q2: no results"])], "issuer string, source string, requested int, fetched int, missing array<string>")
    rel = spark.createDataFrame([("E", 0, "FY2031-Q1", "T" * 70, "u", 12, 345, ["w"])], "issuer string, nth int, period string, title string, url string, n_figures int, n_chars int, warnings array<string>")
    lines = [r.line for r in sink.release_lines(report, rel).orderBy("line_no").collect()]
    assert lines == ["Fetched 1/4 quarterly releases via s", f"  FY2031-Q1  {'T' * 58} figures   12  chars     345", " " * 13 + "u", " " * 13 + "warning: w", "  MISSING    FY2031-Q2: no results"]
