"""DuckDB SQL that states what operators 12 and 13 return."""

DIVERGENCE = r"""
WITH given AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM given),
kept AS (SELECT lang, term, count(*) AS n_lang FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
sides AS (SELECT DISTINCT lang, source FROM given),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total FROM kept GROUP BY lang),
held AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM held GROUP BY lang, source),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(h.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(h.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.n_lang + 2) // (l.total + 2 * l.v) AS q
  FROM sides s JOIN kept k ON s.lang = k.lang JOIN langs l ON s.lang = l.lang LEFT JOIN totals t ON s.lang = t.lang AND s.source = t.source LEFT JOIN held h ON s.lang = h.lang AND s.source = h.source AND k.term = h.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM sides a JOIN sides b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM terms) WHERE rank <= 10)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked
"""

VARIANTS = r"""
WITH RECURSIVE
crc0 AS (SELECT range AS i, range AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc0 WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc0 WHERE k = 8),
found AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
runs AS (SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS m FROM found WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, m, flatten(list_transform(string_split(doc || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, CAST(unicode(ch) - 64 AS BIGINT)] END)) AS b FROM runs),
hashed AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 199 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, m FROM hashed),
words AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, i, word[1 : i - 1] || '*' || word[i + 1 :] AS hole, word[1 : i - 1] || word[i + 1 :] AS rest FROM cuts),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS r FROM near),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word AND b.r = 1),
walk AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT walk.word, forms.form, k + 1 FROM walk JOIN forms ON walk.root = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, k) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON f.word = e.word
"""
