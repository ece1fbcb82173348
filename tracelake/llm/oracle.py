"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_STRIP = r"regexp_replace(regexp_replace({}, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, i, line, {_ASCII_LOWER.format(_STRIP.format("line"))} AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
repeated AS (
  SELECT key, max(doc_id) AS kept_in FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (kept_in <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kept_in IS NULL OR kept_in = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN repeated USING (key) GROUP BY doc_id
""",
    "op8_jaccard_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, i + 1, i + 3) AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reached GROUP BY a) USING (doc_id)
""",
    "op10_decontamination": f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
windows AS (
  SELECT item_id, q, n, list_slice(w, q + 1, q + n) AS s
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(greatest(1, len(w) - 9))) AS q FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, p, list_slice(w, p + 1, p + n) AS s
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, p, q, n FROM places JOIN windows USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT DISTINCT doc_id, p, unnest(range(n)) AS k FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id),
runs AS (
  SELECT doc_id, count(*) + any_value(n) - 1 AS longest, min(p) AS begins
  FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q, n ORDER BY p) AS run FROM (SELECT DISTINCT * FROM found))
  GROUP BY doc_id, item_id, p - q, n, run),
best AS (SELECT doc_id, max(longest) AS longest_words, arg_min(begins, (-longest, begins)) AS longest_at FROM runs GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_words, 0) AS longest_words, longest_at
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN best USING (doc_id)
""",
    "op12_source_divergence": f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_ASCII_LOWER.format("coalesce(text, '')")} AS t FROM documents),
found AS (SELECT d, lang, source, unnest(regexp_extract_all(t, '{_LETTERS}')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY ALL HAVING count(DISTINCT d) >= 3),
counted AS (SELECT lang, source, term, count(*) AS n FROM found JOIN (SELECT lang, term FROM kept) USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, coalesce(any_value(k.v), 0) AS v, coalesce(any_value(k.total), 0) AS total FROM docs LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang) k USING (lang) GROUP BY lang),
parts AS (SELECT lang, source, coalesce(any_value(c.total), 0) AS total FROM docs LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL) c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p
  FROM parts g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM parts a JOIN parts b ON a.lang = b.lang AND a.source <> b.source),
pair_values AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
term_values AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value
  FROM p JOIN (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (total + v) AS q FROM kept JOIN langs USING (lang)) USING (lang, term)
  WHERE n > 0 AND p > q),
every AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN pair_values USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', item, value FROM term_values),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
