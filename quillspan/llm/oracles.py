"""SQL of the training-data queries that SQL can express, over the same tables."""

from __future__ import annotations

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM cut GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM cut, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, k, phrase, a, i, array_to_string(ws[1:i], ' ') AS head, array_to_string(ws[i + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS i FROM (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1))),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.i, h.a AS l, t.a AS r, n, ((1000::HUGEINT * c.a * n) // (h.a::HUGEINT * t.a))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail JOIN totals ON totals.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f q WHERE q.lang = b.lang AND q.k > b.k AND 100 * q.a >= 100 * b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

# crc32 bit by bit; a node is the list of its turns
CONVERSATION_TRIE = r"""
WITH ids AS (
  SELECT conv_id AS c, conv_id - ((conv_id % 100) + 100) % 100 AS base, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
own AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT i.c, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns
  FROM ids i JOIN own o USING (c) LEFT JOIN own b ON b.c = i.base),
members AS (SELECT c, len(turns) AS whole, d, turns[1:d] AS node FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE whole = d), '')) AS ends,
         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(node[d].text) END AS saved
  FROM members GROUP BY node, d),
kids AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS children FROM nodes WHERE d > 0 GROUP BY ALL),
under AS (
  SELECT node[1:j] AS node, j AS d, sum(saved) AS saved, sum(leaf) AS leaves FROM (
    SELECT n.*, CASE WHEN k.children IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, n.d + 1)) AS j FROM nodes n LEFT JOIN kids k ON k.node = n.node AND k.d = n.d)
  GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.children, 0)::BIGINT AS n_children,
       u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN under u ON u.node = n.node AND u.d = n.d LEFT JOIN kids k ON k.node = n.node AND k.d = n.d
LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.node[1:n.d - 1]
"""

REPEATED_PASSAGES = r"""
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
docs AS (SELECT row_number() OVER () AS rid, doc_id, ws FROM split),
windows AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs WHERE len(ws) >= 35)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, i + j AS p FROM windows JOIN again USING (h), (SELECT unnest(range(0, 35)) AS j)),
removed AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid),
words AS (SELECT rid, p, ws[p] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS p FROM docs)),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN removed r USING (rid) LEFT JOIN kept USING (rid)
"""
