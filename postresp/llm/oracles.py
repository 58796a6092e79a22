"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: op6.  ``extra`` counts the characters that escaping puts into a text: one
#: for each backslash and for each <, | or [ that could begin a control string.
OP6 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS starts,
    length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '<|', ''))) // 2 + (length(text) - length(replace(text, '</', ''))) // 2
    + (length(text) - length(replace(text, '<s', ''))) // 2 + (length(text) - length(replace(text, '<\', ''))) // 2
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '<<+'), lambda x: length(x) - 1)), 0)
    + (length(text) - length(replace(text, '|>', ''))) // 2 + (length(text) - length(replace(text, '|\', ''))) // 2
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
    + (length(text) - length(replace(text, '[\', ''))) // 2 AS extra
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length(text) + extra + 5) + sum(CASE WHEN starts THEN length(role) + 5 ELSE 0 END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

#: op1.  Every 100-byte window by brute force; bytes are carried as hex.
OP1 = r"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
windows AS (
  SELECT doc_id, i, array_slice(raw, i, i + 99) AS bytes
  FROM (SELECT doc_id, raw, unnest(range(1, octet_length(raw) - 98)) AS i FROM docs WHERE octet_length(raw) >= 100)),
later AS (SELECT doc_id, i FROM (
  SELECT doc_id, i, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM later),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 99 AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM marked) GROUP BY doc_id, grp),
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0) + 1, octet_length(any_value(d.raw)) FROM docs d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id),
kept AS (
  SELECT p.doc_id, string_agg(hex(array_slice(d.raw, p.f, p.t)), '' ORDER BY p.f) AS h
  FROM pieces p JOIN docs d USING (doc_id) WHERE p.t >= p.f GROUP BY p.doc_id),
gone AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: op7.  All pairs that share a shingle; components by spreading the smallest id.
OP7 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(array_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id, d.doc_id = min(r.b) AS kept
FROM docs d LEFT JOIN sizes z ON z.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n
"""

#: op10, with the default rules: 50 words, half repeated, lines on more than
#: 20 documents and a twentieth of their host's (copies of a text are one
#: document), three tenths of the words left.
OP10 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT r, source, text, k, ls[k] AS line FROM (
  SELECT r, source, text, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM docs)),
worded AS (
  SELECT r, source, text, k, line, {_WORDS.format("line")} AS lw,
    translate(array_to_string({_WORDS.format("line")}, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) + count(DISTINCT CASE WHEN text IS NULL THEN 1 END) AS n FROM documents GROUP BY source),
common AS (
  SELECT c.source, c.norm FROM (SELECT source, norm, count(DISTINCT text) AS n FROM worded GROUP BY source, norm) c
  JOIN hosts h ON h.source IS NOT DISTINCT FROM c.source WHERE c.n > 20 AND c.n > h.n * 0.05),
removed AS (
  SELECT r, sum(len(lw)) AS n FROM worded x JOIN common c ON c.source IS NOT DISTINCT FROM x.source AND c.norm = x.norm GROUP BY r),
windows AS (SELECT r, i, array_slice(w, i, i + 2) AS s FROM (
  SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (
  SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c > 1) GROUP BY r),
base AS (
  SELECT d.r, doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(repeated.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS removed_words
  FROM docs d LEFT JOIN dup ON dup.r = d.r LEFT JOIN repeated ON repeated.r = d.r LEFT JOIN removed ON removed.r = d.r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, removed_words::BIGINT AS removed_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 0.3 * n_words AS kept
FROM base
"""

#: op11.  Words by hand from lower-cased pieces; whole numbers of 128 bits.
OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0),
placed AS (SELECT lang, unnest(w) AS w1, unnest(w[2:]) AS w2, unnest(w[3:]) AS w3 FROM words),
one AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM placed GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM placed WHERE w2 IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM placed WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f) AS n FROM one GROUP BY lang),
longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (
    SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
pairs AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, x.f AS l, y.f AS r, (1000000 * c.f * c.f) // (x.f * y.f) AS score
  FROM two c JOIN one x ON x.lang = c.lang AND x.w1 = c.w1 JOIN one y ON y.lang = c.lang AND y.w1 = c.w2
  LEFT JOIN longer o ON o.lang = c.lang AND o.w1 = c.w1 AND o.w2 = c.w2
  WHERE c.f >= 10 AND (o.f IS NULL OR 100 * o.f < 50 * c.f)),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3 AS phrase, c.f AS a, l1.f AS l1, r1.f AS r1, l2.f AS l2, r2.f AS r2,
    (1000000 * c.f * c.f) // (l1.f * r1.f) AS s1, (1000000 * c.f * c.f) // (l2.f * r2.f) AS s2
  FROM three c JOIN one l1 ON l1.lang = c.lang AND l1.w1 = c.w1 JOIN two r1 ON r1.lang = c.lang AND r1.w1 = c.w2 AND r1.w2 = c.w3
  JOIN two l2 ON l2.lang = c.lang AND l2.w1 = c.w1 AND l2.w2 = c.w2 JOIN one r2 ON r2.lang = c.lang AND r2.w1 = c.w3),
alive AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alive)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op1_suffix_dedup": OP1,
    "op6_chat_format": OP6,
    "op7_near_duplicates": OP7,
    "op10_quality_rules": OP10,
    "op11_collocations": OP11,
}
