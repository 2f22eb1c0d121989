"""Labels, segments and overlays against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import marks
from tallyspark.operators import claims as C
from tallyspark.operators import labels as L
from tallyspark.sources.vocabulary import aliases_table, metrics_table

DOC = "tenant_id string, document_id string, text string"
WORDS = ["Total revenue", "revenues", "net income", "operating margin", "was", "of", "and", "but", "the", "\n", ":", ".", ",", "EPS", "free cash flow", "steps", "İx", "operating cash flow", "grew", "gross margin", "", "é"]
FIGURES = ["$4.5 million", "$7", "12%", "-3.5%", "50 bps", "$ (1,409 )", "9 billion", "15% 5%", "1234.5%"]


def texts():
    rnd = random.Random(9)
    out = [None, "", "$5", "Total revenue $5", "$5 million of operating cash flow and $6 million of total revenue", "Revenue: $5\nNet income: $6 million", "1234.5% then 5% gross margin"]
    for _ in range(120):
        out.append(" ".join(rnd.choice(WORDS if rnd.random() < 0.75 else FIGURES) for _ in range(rnd.randrange(3, 60))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("t" if i % 2 else "u", str(i), t) for i, t in enumerate(texts())], DOC).repartition(3)


def loop(text, voc):
    """What the extractor takes for each figure, with no segments and no rule beside nearness."""
    ex = C.Extractor(voc, text or "", "E", "", [])
    doc, found = ex.doc, [m.span() for m in C.FIGURE.finditer(text or "")]
    out = []
    for (start, end), until in zip(found, [f[0] for f in found[1:]] + [None] * bool(found), strict=True):
        before = (max(0, start - 90, doc.line_start(start)), start)
        limit = min(len(text), end + 60) if until is None else min(until, end + 60)
        metric, label = ex.metric_of(C.unit_of(text[start:end]), before, (end, doc.clause_end(end, limit)), set())
        if label and label.start - end <= (len(text) if until is None else until) - label.end:
            doc.used.append(label)
        out.append((start, end, text[start:end].strip(), C.unit_of(text[start:end]), metric))
    return out


def test_nearest_labels(spark, docs):
    got = {}
    for r in L.nearest_labels(docs, L.phrases_of(metrics_table(spark), aliases_table(spark))).collect():
        got.setdefault(int(r.document_id), []).append((r.start, r.end, r.figure, r.unit, r.metric))
    voc = C.Vocabulary()
    for i, t in enumerate(texts()):
        assert sorted(got.get(i, [])) == loop((t or "").replace("\ue000", "\ue001"), voc), t
    assert "MapInPandas" not in L.nearest_labels(docs, L.phrases_of(metrics_table(spark), aliases_table(spark)))._jdf.queryExecution().toString()


def test_places(spark, docs):
    import re

    pattern = r"(?i)re|ev|even|\bof\b"
    got = sorted((int(r.document_id), r.start, r.end) for r in marks.matches(docs, L.KEYS, "text", pattern).collect())
    assert got == sorted((i, *m.span()) for i, t in enumerate(texts()) for m in re.finditer(pattern, t or ""))
    got = sorted((int(r.document_id), r.start, r.found) for r in marks.starts(docs, L.KEYS, "text", pattern[4:]).collect())
    assert got == sorted((i, m.start(), m.group(1)) for i, t in enumerate(texts()) for m in re.finditer(r"(?=(re|ev|even|\bof\b))", t or ""))


def test_tenants_have_phrases_of_their_own(spark):
    rows = [(f"t{i}", "d", f"Ink turnover of tenant {i} was $4 million. Own{i} words $5. Total revenue $6.") for i in range(300)]
    own = spark.createDataFrame([(f"t{i}", f"own{i} words", "net_income") for i in range(0, 300, 2)] + [("t7", "ink turnover", "gross_profit"), ("t7", "total revenue", "net_income")], "tenant_id string, phrase string, metric string")
    metrics = metrics_table(spark)
    known = own.join(metrics.select(F.col("id").alias("metric"), "unit", F.col("position").cast("int").alias("place")), "metric")
    got = {}
    for r in L.nearest_labels(spark.createDataFrame(rows, DOC), L.phrases_of(metrics, aliases_table(spark)), known).collect():
        got.setdefault(r.tenant_id, {})[r.figure] = r.metric
    ids = {r.id for r in metrics.select("id").collect()}
    for i in range(300):
        g = got[f"t{i}"]
        assert (g["$5"] == "net_income") == (i % 2 == 0), i
        if i != 7:
            assert g["$6"] == "total_revenue"
    assert got["t7"]["$4 million"] == ("gross_profit" if "gross_profit" in ids else got["t7"]["$4 million"])


def test_keywords(spark):
    rnd = random.Random(3)
    letters = "abcé "
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 6))) for _ in range(60)] + ["zz", "a"]
    known = [(t, w) for t in ("t", "u") for w in set(words) if rnd.random() < 0.7]
    docs = [(rnd.choice("tuv"), str(i), "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 40)))) for i in range(150)]
    got = L.named_keywords(spark.createDataFrame(docs, "tenant_id string, document_id string, low string"), spark.createDataFrame(known, "tenant_id string, keyword string"))
    assert sorted(map(tuple, got.collect())) == sorted((t, d, k) for t, d, low in docs for t2, k in known if t == t2 and k in low)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_phrase_lists(spark):
    from tallyspark.sources import vocabulary as V

    default = spark.createDataFrame([("m", 0, "one"), ("m", 1, "two"), ("n", 0, "x")], "metric string, pos int, phrase string")
    over = spark.createDataFrame([("t", "m", 0, " Three\u00a0"), ("t", "m", 1, "ONE"), ("t", "m", 2, " "), ("t", "zzz", 0, "q"), ("u", "n", 0, None), ("v", "o", 0, "new")], "tenant_id string, metric string, pos int, phrase string")
    metrics = spark.createDataFrame([("m",), ("n",), ("o",)], "id string")
    lists = V.overlaid_phrases(default, over, metrics)
    got = {(r.tenant_id, r.metric): list(r.phrases) for r in lists.collect()}
    assert got == {(None, "m"): ["one", "two"], (None, "n"): ["x"], ("t", "m"): ["one", "two", "three"], ("u", "n"): ["x"], ("v", "o"): ["new"]}
    put = {(r.tenant_id, r.metric): list(r.phrases) for r in V.overlaid_phrases(default, over, metrics, instead=True).collect()}
    assert put == {(None, "m"): ["one", "two"], (None, "n"): ["x"], ("t", "m"): ["three", "one"], ("v", "o"): ["new"]}
    assert [tuple(r) for r in V.unknown_metrics(over, metrics).collect()] == [("t", "zzz")]
    wanted = spark.createDataFrame([("t", "m"), ("t", "n"), ("w", "m"), ("w", "o")], "tenant_id string, metric string")
    assert {(r.tenant_id, r.metric): list(r.phrases) for r in V.phrases_for(lists, wanted).collect()} == {("t", "m"): ["one", "two", "three"], ("t", "n"): ["x"], ("w", "m"): ["one", "two"], ("w", "o"): []}


def test_places_are_dealt_and_searched_for_once(spark):
    """Documents are dealt by their key before patterns run over them; each branch of the stream stands once."""
    docs = spark.createDataFrame([("T", str(i), "Total revenue was $5 million: fine.\nOperating cash flow, $2") for i in range(3)], "tenant_id string, document_id string, text string")
    phrases = spark.createDataFrame([("total revenue", "total_revenue", "currency", 0), ("total", "x", "percent", 1), ("operating cash flow", "ocf", "currency", 2)], "phrase string, metric string, unit string, place int")
    found = L.nearest_labels(docs, phrases)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("but|while") == 1
    assert sorted((r.document_id, r.figure, r.metric) for r in found.collect()) == sorted((str(i), *x) for i in range(3) for x in (("$5 million", "total_revenue"), ("$2", "ocf")))


def test_phrases_behind_their_first_character(spark):
    """The longest phrase of a place is found whatever else begins with its character, also where that has another case."""
    docs = spark.createDataFrame([("T", "d", "Net income, NET and nE; [x] Élan élan vital")], "tenant_id string, document_id string, text string")
    phrases = spark.createDataFrame([(p, p, "currency", i) for i, p in enumerate(["net", "net income", "ne", "[x]", "élan vital", "élan", "n"])], "phrase string, metric string, unit string, place int")
    got = sorted((r.start, r.metric) for r in L.label_spans(docs, phrases).collect())
    text = "Net income, NET and nE; [x] Élan élan vital".lower()
    assert got == sorted((i, p) for p in ["net", "net income", "ne", "[x]", "élan vital", "élan", "n"] for i in range(len(text)) if text.startswith(p, i))


def test_keywords_of_few_and_of_many(spark):
    """A list beside each text and the index find the same; few keywords need no shuffle of the texts' runs."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 5)))
    texts = [(t, f"{t}{i}", "".join(rnd.choice("abc ") for _ in range(30))) for t in "ABC" for i in range(10)]
    keys = [("A", word()) for _ in range(9)] + [("B", word()) for _ in range(3)] + [("A", ""), ("D", "a")]
    low, known = spark.createDataFrame(texts, "tenant_id string, document_id string, low string"), spark.createDataFrame(keys, "tenant_id string, keyword string")
    want = sorted({(t, d, k) for t, d, x in texts for o, k in keys if o == t and k and k in x})
    for few in (0, 4, 64):
        assert sorted(map(tuple, L.named_keywords(low, known, few).collect())) == want
    assert "split(low" not in L.named_keywords(low, known)._jdf.queryExecution().optimizedPlan().toString()
