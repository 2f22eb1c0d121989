"""Language mixtures, the byte network and the quality rules against plain reckonings."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import language_id, quality_cnn, quality_rules


def test_mixture_plain():
    """Vectorised estimation is expectation-maximisation, document by document and word by word."""
    rng = np.random.default_rng(1)
    count = np.array([3, 1, 7])
    like, share = rng.random((11, 3)), np.full((3, 3), 1 / 3)
    got, seen = language_id.estimate(like, count, share, 5)
    at = 0
    for d, n in enumerate(count):
        p = [1 / 3] * 3
        for _ in range(5):
            total = [0.0] * 3
            for w in like[at : at + n]:
                whole = sum(a * b for a, b in zip(p, w, strict=True))
                total = [t + a * b / whole for t, a, b in zip(total, p, w, strict=True)]
            p = [t / n for t in total]
        assert np.allclose(got[d], p)
        assert math.isclose(seen[d], sum(math.log(sum(a * b for a, b in zip(p, w, strict=True))) for w in like[at : at + n]))
        at += n


def test_language_sets():
    """A text of five languages gets its set; one of a single language gets that alone; texts don't hang on their neighbours."""
    rnd = random.Random(3)
    alphabets = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    buckets = language_id.BUCKETS
    word = lambda a: "".join(rnd.choice(a) for _ in range(6))
    names = [f"l{i}" for i in range(6)]
    table = np.zeros((buckets, 6))
    for j, a in enumerate(alphabets):
        b, _, _ = language_id.letter_trigrams(language_id.Block([" ".join(word(a) for _ in range(400))]))
        np.add.at(table[:, j], b, 1)
    model = language_id.LanguageModel(names, np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * buckets)).astype(np.float32))
    five = " ".join(word(alphabets[i % 5]) for i in range(100))
    one = " ".join(word(alphabets[5]) for _ in range(40))
    long = " ".join(word(alphabets[2]) for _ in range(60_000))
    lang, score, sets = model.predict([five, one, "", "12 34", long, five])
    assert set(sets[0].split(",")) == set(names[:5]) and sets[0] == sets[5]
    assert (lang[1], sets[1], lang[2], lang[3], lang[4]) == ("l5", "l5", "und", "und", "l2")
    assert score[2] == 0 and all(0 <= x <= 1 for x in score)
    alone = model.predict([five])
    assert alone[0][0] == lang[0] and abs(alone[1][0] - score[0]) < 1e-9


def naive_logit(net, text):
    """The network written out: every filter at every stride of every half, halves joined to chunks, one hidden layer."""
    p = net.p
    buffer, n = quality_cnn.halves([text])
    pool = []
    for h in range(int(n[0])):
        rows = []
        for r in range(quality_cnn._ROWS):
            at = h * quality_cnn.HALF + r * quality_cnn.STRIDE
            seen = [x for b in buffer[at : at + quality_cnn.WIDTH] for x in p["embed"][b]]
            rows.append(np.array(seen) @ p["filter"])
        pool.append(np.maximum(np.max(rows, axis=0) + p["bias"], 0))
    chunks = [np.maximum(a, b) for a, b in zip(pool[:-1], pool[1:], strict=True)] or [pool[0]]
    most = np.max([*chunks, pool[-1]], axis=0)
    x = np.concatenate([np.mean(chunks, axis=0), most])
    hidden = np.maximum(x @ p["w1"] + p["b1"], 0)
    return float((hidden @ p["w2"] + p["b2"])[0]) + net.shift


def test_network_plain():
    rnd = random.Random(4)
    net = quality_cnn.ByteNet.new()
    texts = ["".join(rnd.choice("abc \n!é") for _ in range(n)).encode() for n in (0, 1, 5, 40, 900, 3000)]
    got = net.logits(texts)
    for t, z in zip(texts, got, strict=True):
        assert abs(z - naive_logit(net, t)) < 1e-3


def test_network_gradient():
    """Against finite differences of the loss, for some weights of each layer."""
    rnd = random.Random(5)
    net = quality_cnn.ByteNet.new()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = ["".join(rnd.choice("abcdef ") for _ in range(n)).encode() for n in (30, 400, 1200)]
    label = np.array([0, 1, 1], np.float32)

    def loss():
        z = np.array([naive_logit(net, t) for t in texts])
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    g = net.gradient(texts, label)
    for name in ("w2", "b2", "w1", "b1", "bias", "filter"):
        flat = net.p[name].ravel()
        for i in np.argsort(-np.abs(np.asarray(g[name]).ravel()))[:3]:
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-5 - np.asarray(g[name]).ravel()[i]) < 2e-3 * max(1, abs(np.asarray(g[name]).ravel()[i])), name


def test_binomial():
    for n, k, rate, level in ((300, 0, 0.005, 0.3), (300, 1, 0.01, 0.2), (2000, 3, 0.005, 0.02), (50, 2, 0.02, 0.9)):
        exact = sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))
        assert quality_rules.certified(n, k, rate, level) == (k <= rate * n and exact <= level)


def test_calibrated(spark):
    """Strata with many clean labels get cutoffs and reject what is beyond; one with few rejects nothing; clean ones are rejected rarely."""
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(6000):
        stratum = ("aa", None, "few")[i % 3] if i % 300 < 290 else "aa"
        bad = i % 5 == 0
        words = [rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rnd.randrange(50)) for _ in range(60)]
        text = " ".join(words) + ("! " * 70 if bad else "")
        rows.append((i, text, stratum, "x", 1))
        if stratum != "few" or i < 30:
            labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n_words int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == 6000
    for i, _, stratum, *_ in rows:
        r = got[i]
        assert ("shouts" in r.rejected_by) == (i % 5 == 0 and stratum != "few"), i
        assert r.kept == (not r.base_failed and not r.rejected_by)
    clean = [r for i, r in got.items() if i % 5]
    assert sum(bool(r.rejected_by) for r in clean) <= quality_rules.MAX_REJECTION * len(clean)


def test_false_rejections_are_controlled():
    """Of many draws of a holdout, seldom more than the failure rate certifies a rule that rejects more than allowed."""
    rng = np.random.default_rng(2)
    rate, level = 0.02, 0.05
    wrong = sum(quality_rules.certified(1000, int(k), rate, level) for k in rng.binomial(1000, 0.0205, 4000))
    assert wrong <= 4000 * level * 1.3
