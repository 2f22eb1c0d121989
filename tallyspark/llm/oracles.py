"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from .quality_rules import FAILURE, MAX_REJECTION, SIGNALS

_WORD = r"[^\x20\x09-\x0D]+"


def _rules() -> str:
    tests = [(s, of, total, i, c) for s, (of, total, grid) in SIGNALS.items() for i, c in enumerate(grid)]
    values = ", ".join(f"('{s}', {i}, {c})" for s, _, _, i, c in tests)
    value = " ".join(f"WHEN '{s}' THEN 100 * {of} > cutoff * {total}" for s, (of, total, _) in SIGNALS.items())
    rate, level = MAX_REJECTION / len(SIGNALS), f"{FAILURE} / {len(SIGNALS)} / (SELECT greatest(count(DISTINCT coalesce(stratum, chr(1))), 1) FROM base)"
    return rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
wins AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s
         FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM docs WHERE len(w) >= 8)),
twice AS (SELECT doc_id, s FROM wins GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n
            FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM wins JOIN twice USING (doc_id, s)) GROUP BY doc_id),
base AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_shouts, len(l)::BIGINT AS n_lines,
         len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
  FROM docs LEFT JOIN covered USING (doc_id)),
tests(signal, i, cutoff) AS (VALUES {values}),
clean AS (SELECT * FROM base WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
held AS (SELECT stratum, signal, i, cutoff, count(*) AS n,
                count(*) FILTER (WHERE CASE signal {value} END) AS k
         FROM clean CROSS JOIN tests GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k > {rate} * n THEN 1.0 ELSE
            list_sum(list_transform(generate_series(0, k), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate}) + (n - j) * ln(1 - {rate})))) END AS p
          FROM held),
sound AS (SELECT *, bool_and(p <= {level}) OVER (PARTITION BY stratum, signal ORDER BY i) AS ok FROM tails),
cutoffs AS (SELECT stratum, signal, min(cutoff) AS cutoff FROM sound WHERE ok GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id FROM base JOIN cutoffs ON base.stratum IS NOT DISTINCT FROM cutoffs.stratum AND CASE signal {value} END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM gone) AS kept
FROM base"""


_SUBSTRING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM win JOIN rep USING (s)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
                  unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, count(*) OVER (PARTITION BY doc_id) AS lines,
             len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
run AS (SELECT doc_id, i, 1 AS n, x AS s, w, lines FROM r
        UNION ALL SELECT a.doc_id, a.i, 2, a.x || chr(10) || b.x, a.w + b.w, a.lines FROM r a JOIN r b ON b.doc_id = a.doc_id AND b.i = a.i + 1
        UNION ALL SELECT a.doc_id, a.i, 3, a.x || chr(10) || b.x || chr(10) || c.x, a.w + b.w + c.w, a.lines
        FROM r a JOIN r b ON b.doc_id = a.doc_id AND b.i = a.i + 1 JOIN r c ON c.doc_id = a.doc_id AND c.i = a.i + 2),
later AS (SELECT doc_id, i, n FROM (SELECT *, row_number() OVER (PARTITION BY n, s ORDER BY doc_id, i) AS k FROM run) WHERE k > 1 AND (n = 3 OR w >= 5 OR lines = n)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS i FROM later),
lost AS (SELECT doc_id, p FROM r JOIN gone USING (doc_id, i)),
t AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY p) AS t FROM l ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, (SELECT count(*) FROM r WHERE r.doc_id = d.doc_id)::BIGINT AS n_lines,
       (SELECT count(*) FROM lost WHERE lost.doc_id = d.doc_id)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS text_sha256
FROM documents d LEFT JOIN t USING (doc_id)"""

_CHATS = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS er,
                regexp_replace(text, '([<\[])(\\*)(/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS et FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('[INST] ' || er || ' [/INST]' || et || '</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

_SEARCH = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""

_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * k >= 4 * (x.n + y.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
copies AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) END AS copy_id FROM d)
SELECT doc_id, (SELECT min(b) FROM reach WHERE a = doc_id) AS class_id, copy_id, (SELECT count(*) FROM links WHERE a = doc_id)::BIGINT AS n_links
FROM copies"""


_PHRASES = r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT c.*, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, (VALUES (1), (2)) s(k) WHERE k < words),
s AS (SELECT cut.lang, cut.phrase, words, a, cut.k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS part FROM c WHERE words = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN held ON held.lang = b.lang AND held.part = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000"""

_FILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::UBIGINT::BIGINT) AS r FROM d),
f AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM g"""


_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT *, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS holder FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i::INT + 1, 5))::INT) AS v FROM d)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM b"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _rules(), "op2_substring_dedup": _SUBSTRING, "op3_line_dedup": _LINES, "op4_chat_format": _CHATS, "op7_bit_search": _SEARCH, "op8_jaccard_join": _JACCARD, "op11_collocations": _PHRASES, "op12_fill_middle": _FILL, "op13_warc": _WARC}
