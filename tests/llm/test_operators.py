"""Training-data operators against brute force, with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bit_search, byte_bpe, chat_format, jaccard_join, language_id, line_dedup, packing, piece_codec, quality_cnn, quality_rules, substring_dedup
from tallyspark.llm.components import components

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, n_words long, spans string, _n long, key string"


def corpus():
    rnd = random.Random(7)
    voc = ["ab", "cde", "é", "x!", "##", "漢字", "to", "the", "of", "Zürich"]
    line = lambda n: " ".join(rnd.choice(voc) for _ in range(n))
    shared, lines = line(60), [line(9) for _ in range(5)]
    texts = [None, "", " \t\n\x0b ", "one", "a b c", shared, shared, f"{line(20)}\n{shared}\t {line(5)}", "\n".join(lines), f"{line(4)}\n\n" + "\n \n".join(lines), "same " * 120, line(5000) + "\n" + shared]
    texts += [line(rnd.randrange(1, 90)) for _ in range(10)]
    base = line(200).split(" ")
    for i in range(12):  # near copies
        w = list(base)
        for _ in range(i % 4):
            w[rnd.randrange(len(w))] = f"new{i}"
        texts.append(" ".join(w))
    return [(i, t, "en" if i % 2 else None, 1, "x", 2, "k") for i, t in enumerate(texts)]


ROWS = corpus()
WORDS = {i: (t or "").encode().split() for i, t, *_ in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring(docs, empty):
    seen = Counter(tuple(w[i : i + 35]) for w in WORDS.values() for i in range(len(w) - 34))
    for shard in (200_000, 300, 1):  # one shard; anchors of both kinds; whole windows for every anchor
        got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs, shard_words=shard).collect()}
        assert len(got) == len(WORDS)
        for k, w in WORDS.items():
            gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
            assert got[k].text.encode().split() == [x for j, x in enumerate(w) if j not in gone], k
            assert (got[k].n_words, got[k].n_removed) == (len(w), len(gone))
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_one_id_twice(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " end"), (3, "c " + b), (4, "d"), (4, "d"), (5, "e " + " ".join(f"e{i}" for i in range(50)))], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == [(1, 60, 60), (1, 60, 60), (2, 61, 60), (3, 61, 60), (4, 1, 0), (4, 1, 0), (5, 51, 0)]


def test_automaton():
    a = substring_dedup.SuffixAutomaton()
    seqs = [list(b"abcabcx"), list(b"bcab"), list(b"zzzz")]
    for s in seqs:
        a.add(s, 1)
    a.close()
    for s in seqs:
        for i, m in enumerate(a.statistics(s)):
            best = max(n for n in range(i + 2) if n == 0 or sum(t[j : j + n] == s[i + 1 - n : i + 1] for t in seqs for j in range(len(t) - n + 1)) >= 2)
            assert m == best


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
def test_lines(docs, m):
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, m, keep=("lang", "n_words")).select("doc_id", "text", "lang").collect()}
    seen = set()
    for k, t, lang, *_ in ROWS:
        lines = (t or "").split("\n")
        real = [i for i, x in enumerate(lines) if x.encode().split()]
        gone = set()
        for s in range(len(real) - m + 1):
            w = tuple(lines[j] for j in real[s : s + m])
            gone |= set(real[s : s + m]) if w in seen else set()
            seen.add(w)
        assert got[k].text == "\n".join(x for i, x in enumerate(lines) if i not in gone) and got[k].lang == lang


@pytest.mark.parametrize("m", [1, 3, 5])
def test_short_runs(spark, docs, m):
    more = ["Terms apply to all of it.", "Terms apply to all of it.", "ok", "x\nok", "ok", "a b\nc d e", "z\n\na b\n \nc d e\nq", "Yes."]
    rows = [*ROWS, *((100 + i, t, None, 1, "x", 2, "k") for i, t in enumerate(more))]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), m, min_words=5).collect()}
    seen = set()
    for k, t, *_ in rows:
        lines = (t or "").split("\n")
        real = [i for i, x in enumerate(lines) if x.encode().split()]
        gone = set()
        for n in range(1, m + 1):
            for s in range(len(real) - n + 1):
                w = tuple(lines[j] for j in real[s : s + n])
                if w in seen and (n == m or n == len(real) or sum(len(x.encode().split()) for x in w) >= 5):
                    gone |= set(real[s : s + n])
                seen.add(w)
        assert got[k].text == "\n".join(x for i, x in enumerate(lines) if i not in gone) and (got[k].n_lines, got[k].n_removed) == (len(real), len(gone))
    if m == 3:
        assert [got[k].text for k in (6, 101, 103, 104, 106)] == ["", "", "x\nok", "", "z\n\n \nq"]


def test_jaccard(docs, empty):
    for block in (400, 2):  # clusters in one block, and dealt into many
        jaccard_join.BLOCK_DOCS = block
        got = {r.doc_id: r for r in jaccard_join.jaccard_classes(docs).collect()}
        sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for k, w in WORDS.items()}
        label = {k: k for k in sets}
        for a in sets:
            near = [b for b in sets if b != a and sets[a] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
            assert got[a].n_links == len(near), a
            for b in near:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
        assert {k: r.class_id for k, r in got.items()} == label
    jaccard_join.BLOCK_DOCS = 400
    assert jaccard_join.jaccard_classes(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 41), (41, 45)], "src long, dst long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 41: 41, 45: 41, 50: 41}


def test_quality_rules(spark, docs, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")).collect()}
    for k, t, *_ in ROWS:
        w = WORDS[k]
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often = Counter(wins)
        covered = {j for i, x in enumerate(wins) if often[x] > 1 for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert (got[k].n_words, got[k].n_repeat_words, got[k].n_dup_lines) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert got[k].word_chars == sum(len(x.decode()) for x in w) and got[k].n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert got[k].base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and got[k].kept == (not got[k].base_failed)
    assert quality_rules.quality_rules(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_certified():
    from math import comb

    for n, k in ((100, 0), (1000, 1), (3000, 4), (3000, 9)):
        exact = sum(comb(n, i) * 0.005**i * 0.995 ** (n - i) for i in range(k + 1))
        assert quality_rules.certified(n, k, 0.005, 0.01) == (exact <= 0.01)


def test_chats(spark):
    rnd = random.Random(2)
    bits = ["</s>", "[INST]", "[/INST]", "\\", "<", "[", "a", "\n", "<\\/s>", "[\\\\INST]", " "]
    rows = [(c, t if t else None, rnd.choice(["user", "assistant", "system", None, "[/INST]"]), rnd.choice([None, "", "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))])) for c in range(40) for t in range(rnd.randrange(1, 6))]
    rows += [(99, 1, "user", "x"), (99, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, formatted string, k int, piece string")
    out = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    for c, r in out.items():
        mine = sorted(((t is not None, t or 0, x or "", y or "") for k, t, x, y in rows if k == c))
        assert [(t.role, t.text) for t in r.turns] == [(x, y) for _, _, x, y in mine]
        said = [y for _, _, x, y in mine if x == "assistant"]
        assert len(r.loss_spans) == len(said) and r.formatted.count("</s>") == len(mine)
        cut = [re.sub(r"([<\[])\\(\\*)(/s>|INST\]|/INST\])", r"\1\2\3", r.formatted[x.start : x.start + x.length]) for x in r.loss_spans]
        assert cut == said  # under the mask, unescaped: all assistant texts in order
        marks = re.findall(r"</s>|\[/?INST\]", r.formatted)
        assert marks == ["[INST]", "[/INST]", "</s>"] * len(mine)  # no control string but the template's own
    masked = chat_format.format_chats(df).select("conv_id", chat_format.under_mask(F.col("formatted"), F.col("loss_spans")).alias("m"))
    assert {r.conv_id: list(r.m) for r in masked.collect()} == {c: [y for *_, x, y in sorted((t is not None, t or 0, x or "", y or "") for k, t, x, y in rows if k == c) if x == "assistant"] for c in out}
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_packing(spark, docs, empty):
    path = P.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, capacity=64).collect()
    m = byte_bpe.model(path)
    for k, t, *_ in ROWS:
        ids = [*m.library.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in got if r.doc_id == k), key=lambda r: r.piece)
        assert b"".join(r.ids for r in mine) == np.array(ids, "<u4").tobytes()
        assert all(r.length == 64 for r in mine[1:]) and [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    counts = np.bincount([r.length for r in got], minlength=65)
    assert len(by) <= sum(k for _, k in packing.best_fit_plan(counts, 64))
    assert packing.pack_documents(empty, path).count() == 0


def test_pack_counts_small():
    for sizes in ([6, 5, 4, 3, 2], [7, 7, 3, 3], [5, 5, 5], [4, 4, 3, 3, 3, 3], []):
        counts = np.bincount(sizes, minlength=11)
        plan, least = packing.pack_counts(counts, 10)
        used = Counter()
        for fill, k in plan:
            assert sum(fill) <= 10
            used.update({x: fill.count(x) * k for x in set(fill)})
        assert used == Counter(sizes)
        assert sum(k for _, k in plan) == (0 if not sizes else 2) >= least


def test_byte_bpe():
    m = byte_bpe.model(P.path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    alpha = "ab  \n\t▁éß漢字😀<0x'''sstredll/тест..!!  1234　\x00²½́"
    texts = ["", " ", "  ", "it's 'twas !'s don't 're x'll'llx ''s", "hi <|endoftext|> you", "\n\n  \n", *("".join(rnd.choice(alpha) for _ in range(rnd.randrange(60))) for _ in range(500))]
    assert [x.tolist() for x in m.encode(texts)] == [m.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_piece_codec(docs, empty):
    from sentencepiece import SentencePieceProcessor

    path = P.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    for r in piece_codec.encode_decode(docs, path).collect():
        want = sp.encode(ROWS[r.doc_id][1] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == sp.decode(want)
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab  \n\t▁éß漢字😀<0x0A>s/тест..!!  1234　\x00") for _ in range(rnd.randrange(60))) for _ in range(500)] + ["  ", "▁", "<s>", "a" * 5000]
    for t, (ids, text) in zip(texts, piece_codec.encode_texts(piece_codec.codec(path), texts), strict=True):
        want = sp.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want and text == sp.decode(want)
    assert piece_codec.encode_decode(empty, path).count() == 0


def test_language(spark, docs, empty):
    rnd = random.Random(1)
    voc = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["xyzzy", "qwert", "plugh", "zzyx"]}
    rows = [(i, " ".join(rnd.choice(voc[x]) for _ in range(30)), x) for i in range(60) for x in (rnd.choice(["aa", "bb"]),)]
    train = spark.createDataFrame([*rows, (99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    got = {r.doc_id: r for r in language_id.predict(train, model).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows) and got[99].lang_pred == "und"
    mix = model.predict(["lorem ipsum dolor amet " * 12 + "xyzzy qwert plugh zzyx " * 6, "12 !", ""])
    assert mix[0] == ["aa", "und", "und"] and mix[2][0] == "aa,bb" and 0.6 < mix[1][0] < 0.72
    assert language_id.predict(docs, language_id.fit(empty)).filter("lang_pred <> 'und'").count() == 0


def test_classifier(spark, empty):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("$$$" if i % 2 and rnd.random() < 0.3 else "") for _ in range(rnd.randrange(5, 150))), 1 - i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    net = quality_cnn.fit(df.select("doc_id", "text").union(spark.createDataFrame([(999, None)], "doc_id long, text string")), df.select("doc_id", "quality"))
    s = {r.doc_id: r.score for r in quality_cnn.score(df, net).collect()}
    assert np.mean([(s[i] >= 0.7) == bool(q) for i, _, q in rows]) > 0.95
    assert net.scores([b"x" * 100, b"", b"x" * 100])[0] == net.scores([b"x" * 100])[0]
    assert quality_cnn.fit(df, df.filter("quality = 1").select("doc_id", "quality")) is None and quality_cnn.score(empty, None).count() == 0


def brute_nearest(rows, k):
    """Nearest of each query row (ids divisible by 20) by the measure itself; shorter vectors padded."""
    dim = max(len(v) for _, v in rows)
    ids = np.array([i for i, _ in rows])
    d = np.array([[*v, *[0.0] * (dim - len(v))] for _, v in rows])
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = (d[q] * d).cumsum(axis=1)[:, -1]
        order = [j for j in sorted(range(len(ids)), key=lambda j: (-score[j], ids[j])) if ids[j] != ids[q]][:k]
        want += [(int(ids[q]), n + 1, int(ids[j]), float(score[j])) for n, j in enumerate(order)]
    return sorted(want)


def test_bit_search(spark, monkeypatch):
    """Several cells, blocks and chunks; odd vectors; a short one; ties; a common vector; rows of one id; clashing columns."""
    for name, value in (("QUERY_BLOCK", 8), ("CELLS_AT_ONCE", 100), ("LEAST_BLOCK", 32), ("BLOCK_BYTES", 1 << 12)):
        monkeypatch.setattr(bit_search, name, value)
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((4, 16)) * 3
    x = np.concatenate([middle[i % 4] + rng.standard_normal(16) for i in range(200)] + [rng.standard_normal(16) for _ in range(100)]).reshape(-1, 16).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[7].tolist()) for i in range(310, 400)] + [(305, [1.0]), (40, x[3].tolist()), (41, x[41].tolist())]
    odd = [(300, None), (301, [0.0] * 16), (302, [None] + [1.0] * 15), (303, [float("nan")] + [1.0] * 15), (304, [float("inf")] + [1.0] * 15), (306, []), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows + odd], "vec_id long, embedding array<float>, cell string, score double, row int").repartition(5)
    for k in (5, 20):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in bit_search.nearest(df, F.col("vec_id") % 20 == 0, k).collect())
        assert got == brute_nearest(rows, k)
    few = bit_search.nearest(df.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0, 20)
    assert few.count() == 2 and bit_search.nearest(df.limit(0), F.lit(True)).count() == 0


def test_bit_codes_choose():
    """Bounds hold, and few of many vectors are reranked, with nearly all of the nearest among them."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((12000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn, centre = bit_search.rotation(64), np.zeros(64)
    codes, norm, correction = bit_search.encode(x, turn)
    q, seen = x[::200], [0, 0]
    a, c, _ = bit_search.search_block(np.arange(0, 12000, 200), q, np.full(60, -np.inf), np.arange(12000), x, codes, norm, correction, centre, 20, turn, seen)
    true = q @ x.T
    true[np.arange(60), np.arange(0, 12000, 200)] = -9
    want = {(i, j) for i in range(60) for j in np.argsort(-true[i])[:20]}
    assert len(want & set(zip(a.tolist(), c.tolist(), strict=True))) >= 0.99 * len(want)
    assert seen[1] < 0.4 * seen[0]
    got = bit_search.Quantised.of(q, turn).products(codes, 64)
    plain = (q @ turn) @ np.where(np.unpackbits(codes.view(np.uint8), axis=1)[:, :64] > 0, 1, -1).T / 8
    assert np.abs(got - plain).max() < 0.05


def test_pipeline(spark, tmp_path):
    pipe = pytest.importorskip("corpus_pipeline")
    rows = [(r[0], r[1], r[2], "s", len(r[1] or "")) for r in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipe.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(pipe.COLUMNS)
    out = pipe.run(spark, str(tmp_path)).collect()
    left = {r.doc_id: (r.text or "") for r in docs.collect()}
    assert {r.doc_id for r in out} == set(left)
    crc = {(r.doc_id, r.piece): r.ids_crc32 for r in out}
    m = byte_bpe.model(P.path("byte_bpe_50k.json"))
    for k, t in left.items():
        ids = np.append(m.encode([t])[0], np.uint32(2))
        if len(ids) <= 1024:
            assert crc[k, 0] == zlib.crc32(ids.astype("<u4").tobytes())
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
