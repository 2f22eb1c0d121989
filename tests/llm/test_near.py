"""Near duplicates: bucket ties and recall against brute force."""

import random

import numpy as np

from tallyspark.llm import jaccard_join


def test_bucket_ties():
    """Members are connected just as the pairs that are alike connect them."""
    rng = np.random.default_rng(4)
    for trial in range(30):
        base = rng.integers(0, 256, (4, 60)).astype(np.uint8)
        sketch = base[rng.integers(0, 4, 25)]
        noise = rng.random(sketch.shape) < rng.choice([0.05, 0.2, 0.35], (25, 1))
        sketch = np.where(noise, rng.integers(0, 256, sketch.shape), sketch).astype(np.uint8)
        parts = {i: {i} for i in range(25)}
        for i in range(25):
            for j in range(i):
                if (sketch[i] == sketch[j]).sum() >= 38 and parts[i] is not parts[j]:
                    parts[i] |= parts[j]
                    for k in parts[j]:
                        parts[k] = parts[i]
        got = {i: {i} for i in range(25)}
        ties = list(jaccard_join.bucket_ties(sketch, 38))
        for i, j in ties:
            assert got[i] is not got[j], trial  # a forest
            got[i] |= got[j]
            for k in got[j]:
                got[k] = got[i]
        assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in parts.values()}


def edited(rnd, words, share):
    return [f"w{rnd.randrange(10**6)}" if rnd.random() < share else w for w in words]


def test_recall(spark, monkeypatch):
    """Every link at the threshold, of copies with few to many edits and of chance pairs below it; large buckets tie to their first member."""
    rnd = random.Random(9)
    rows = []
    for g in range(60):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([30, 120, 400]))]
        rows += [edited(rnd, base, rnd.choice([0, 0.005, 0.01, 0.02, 0.03, 0.06])) for _ in range(rnd.choice([2, 3, 12]))]
    texts = [" ".join(w) for w in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    links = {i: {j for j in range(len(sets)) if j != i and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))} for i in range(len(sets))}
    near = sum(1 for i in links for j in links[i] if texts[i] != texts[j])
    assert near > 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bucket in (1024, 3):
        monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
        got = {r.doc_id: r for r in jaccard_join.jaccard_classes(docs).collect()}
        assert {i: got[i].n_links for i in got} == {i: len(x) for i, x in links.items()}
        least = {}
        for i in links:
            seen, todo = {i}, [i]
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            least[i] = min(seen)
        assert {i: got[i].class_id for i in got} == least
