"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL["op2_quality_rules"] = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS n_letters
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
             + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
             + CASE WHEN 100 * n_letters < 60 * word_chars THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

_LINE_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op8_line_dedup"] = f"""
WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT *, {_LINE_KEY} AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL AND doc_id <> top) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL OR doc_id = top), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""

ORACLE_SQL["op1_ngram_jaccard"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a JOIN documents d ON d.doc_id = r.a GROUP BY d.doc_id
"""

ORACLE_SQL["op3_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

#: Damage by a table-driven CRC-32 (the table follows from its polynomial); then the cheapest edits from the end of each
#: conversation: v0 .. v3 are (cost, audit) from each state of the pattern on.
ORACLE_SQL["op12_conversation_repair"] = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
             lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) AS r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                             lambda a, x: xor(a // 256, t[(xor(a, x) % 256) + 1])), 4294967295) % 20 AS k FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM k WHERE k <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER w AS i, left(role, 1) AS c, lag(left(role, 1)) OVER w || left(role, 1) AS two,
             NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM (SELECT *, i > min(i) OVER (PARTITION BY conv_id, role, text) AS again FROM o)),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
             count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
r AS (SELECT conv_id, n + 1 AS i, {'c': 0, 'a': ''} AS v0, {'c': 10, 'a': 'II'} AS v1, {'c': 5, 'a': 'I'} AS v2, {'c': 0, 'a': ''} AS v3 FROM n
      UNION ALL
      SELECT conv_id, i, list_min([b0, {'c': v2.c + 5, 'a': 'I' || v2.a}]), list_min([b1, {'c': v2.c + 5, 'a': 'I' || v2.a}]), v2, v3
      FROM (SELECT conv_id, i, b0, b1, list_min([b2, {'c': b3.c + 5, 'a': 'I' || b3.a}]) AS v2, list_min([b3, {'c': b2.c + 5, 'a': 'I' || b2.a}]) AS v3
        FROM (SELECT r.conv_id, r.i - 1 AS i,
                list_min([{'c': v0.c + 2, 'a': 'D' || v0.a}, CASE WHEN NOT gone AND f.c = 's' THEN {'c': v1.c + more, 'a': 'K' || v1.a} WHEN NOT gone AND f.c = 'u' THEN {'c': v2.c + more, 'a': 'K' || v2.a} END,
                          CASE WHEN NOT gone THEN {'c': v2.c + 1 + more, 'a': 'R' || v2.a} END]) AS b0,
                list_min([{'c': v1.c + 2, 'a': 'D' || v1.a}, CASE WHEN NOT gone AND f.c = 'u' THEN {'c': v2.c + more, 'a': 'K' || v2.a} END, CASE WHEN NOT gone THEN {'c': v2.c + 1 + more, 'a': 'R' || v2.a} END]) AS b1,
                list_min([{'c': v2.c + 2, 'a': 'D' || v2.a}, CASE WHEN NOT gone AND f.c = 'a' THEN {'c': v3.c + more, 'a': 'K' || v3.a} END, CASE WHEN NOT gone THEN {'c': v3.c + 1 + more, 'a': 'R' || v3.a} END]) AS b2,
                list_min([{'c': v3.c + 2, 'a': 'D' || v3.a}, CASE WHEN NOT gone AND f.c = 'u' THEN {'c': v2.c + more, 'a': 'K' || v2.a} END, CASE WHEN NOT gone THEN {'c': v2.c + 1 + more, 'a': 'R' || v2.a} END]) AS b3
              FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i - 1))),
best AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM r WHERE i = 1),
letters AS (SELECT conv_id, p, substr(audit, p, 1) AS x FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)),
places AS (SELECT conv_id, p, x, count(*) FILTER (x <> 'I') OVER w AS i, count(*) FILTER (x <> 'D') OVER w AS nth, count(*) FILTER (x <> 'D') OVER (PARTITION BY conv_id) % 2 AS s
           FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
lines AS (SELECT places.conv_id, p, CASE WHEN x = 'K' THEN role WHEN (nth - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END AS line
          FROM places LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM places.conv_id AND f.i = places.i WHERE x <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS t FROM lines GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
     LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM a.conv_id
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL["op13_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
a AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
q AS (SELECT q, item_id, t, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, a WHERE t IN (SELECT t FROM q) GROUP BY t),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(w) * n) // l AS m FROM d, a WHERE len(w) > 0),
s AS (SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY q, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""
