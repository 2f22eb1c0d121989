"""Each stage of the pipeline against brute force on its own input, with labels; an empty corpus; the whole run."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import quality_cnn

P = pytest.importorskip("public_tokenizers")
pipe = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(11)
    voc = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in "lmnrst"]
    line = lambda n: " ".join(rnd.choice(voc) for _ in range(n))
    passage, block, base = line(70), [line(8) for _ in range(4)], line(150).split()
    texts = [None, "", "  \n", "word", passage, line(50)]
    texts += [f"{line(30)}\n{passage}\n{line(20)}" for _ in range(6)] + ["\n".join([line(12), *block, line(9)]) for _ in range(4)]
    for share in (0, 0, 0.005, 0.01, 0.05, 0.1):
        texts.append(" ".join(line(1) if rnd.random() < share else w for w in base))
    texts += ["\n".join(line(rnd.randrange(1, 25)) for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    junk = ["".join(rnd.choice("$#!*%&|<>0123456789 ") for _ in range(rnd.randrange(150, 600))) for _ in range(50)]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, len(t or "")) for i, t in enumerate(texts + junk)]
    return rows, [(i, int(i < len(texts)), 0) for i in range(len(texts) + len(junk)) if i % 5]


ROWS, LABELS = corpus()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def steps(spark, folder):
    """Rows before each stage and after the last but one, as dicts of texts."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in pipe.STAGES[:-1]:
        out.append({r.doc_id: r.text for r in docs.collect()})
        docs = stage(spark, docs, folder)
        assert docs.columns == list(pipe.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
    whole = {r.doc_id: r for r in docs.collect()}
    assert all(r.n_chars == len(r.text or "") for r in whole.values())
    return [*out, {k: r.text for k, r in whole.items()}]


def words(t):
    return (t or "").encode().split()


def test_quality(spark, folder, steps):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    net = quality_cnn.fit(docs, labels)
    assert steps[1] == {k: t for k, t in steps[0].items() if net.scores([(t or "").encode()])[0] >= quality_cnn.CUT or abs(net.scores([(t or "").encode()])[0] - quality_cnn.CUT) < 1e-6 and k in steps[1]}
    clean = {k for k, q, _ in LABELS if q}
    assert len(clean & steps[1].keys()) >= 0.9 * len(clean) and len(steps[1]) < len(ROWS) - 30


def test_lines(steps):
    lines = {k: [x for x in (t or "").split("\n") if words(x)] for k, t in steps[1].items()}
    first, gone = {}, {k: set() for k in lines}
    for n in (1, 2, 3):
        for k in sorted(lines):
            for i in range(len(lines[k]) - n + 1):
                run = tuple(lines[k][i : i + n])
                if first.setdefault((n, run), (k, i)) != (k, i) and (n == 3 or sum(len(words(x)) for x in run) >= 5 or len(lines[k]) == n):
                    gone[k] |= set(range(i, i + n))
    for k, t in steps[1].items():
        at, left = -1, []
        for x in (t or "").split("\n"):
            at += bool(words(x))
            if not (words(x) and at in gone[k]):
                left.append(x)
        assert steps[2][k] == "\n".join(left), k
    assert any(gone.values())


def test_near(steps):
    sets = {k: {tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))} if words(t) else set() for k, t in steps[2].items()}
    parts = {k: {k} for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) and parts[a] is not parts[b]:
                parts[a] |= parts[b]
                for k in parts[b]:
                    parts[k] = parts[a]
    assert steps[3] == {k: t for k, t in steps[2].items() if min(parts[k]) == k}
    assert len(steps[3]) < len(steps[2])


def test_passages(steps):
    seen = Counter(tuple(words(t)[i : i + 35]) for t in steps[3].values() for i in range(len(words(t)) - 34))
    some = 0
    for k, t in steps[3].items():
        w = words(t)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        some += len(gone)
        assert words(steps[4][k]) == [x for j, x in enumerate(w) if j not in gone]
    assert some or max(seen.values(), default=0) < 2


def test_run(spark, folder, steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = pipe.run(spark, folder).collect()
    assert {r.doc_id for r in got} == steps[4].keys()
    for r in got:
        ids = np.array([*library.encode(steps[4][r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipe.run(spark, str(tmp_path)).count() == 0
