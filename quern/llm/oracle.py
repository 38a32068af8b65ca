"""Oracle SQL (DuckDB) for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The method's verdict is allow: at the production support and confidence the small tables' labels, which say nothing of URLs, give no rule.
URL_FILTER = r"""WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
 f AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

NEAR_DUPLICATES = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT text, min(doc_id) AS id, count(*) AS n, {_WORDS} AS w FROM documents GROUP BY text),
 g AS MATERIALIZED (SELECT id, g, count(*) AS m FROM (SELECT id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM t WHERE len(w) > 0) GROUP BY id, g),
 c AS (SELECT id, sum(m) AS n FROM g GROUP BY id),
 p AS (SELECT a.id AS a, b.id AS b, sum(least(a.m, b.m)) AS m FROM g a JOIN g b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id),
 e AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE m >= 0.8 * (x.n + y.n - m)),
 r AS (SELECT id AS a, id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
 k AS (SELECT a AS id, min(b) AS class_id FROM r GROUP BY a),
 z AS (SELECT class_id, sum(n) AS class_size FROM k JOIN t USING (id) GROUP BY class_id)
SELECT d.doc_id, CASE WHEN len(w) > 0 THEN class_id ELSE d.doc_id END AS class_id, CASE WHEN len(w) > 0 THEN CAST(class_size AS BIGINT) ELSE 1 END AS class_size
 FROM documents d JOIN t ON t.text IS NOT DISTINCT FROM d.text JOIN k USING (id) JOIN z USING (class_id)"""


def quality_rules() -> str:
    """The same thresholds from the same logarithmic buckets: gamma is 1.01 / 0.99, fences are 3 interquartile ranges of buckets outside the
    quartiles, and groups of fewer than 50 documents take those of their language, then those of all."""
    rates = {"symbol_rate": "(n_symbols + 1) / (n_words + 1)", "dup_line_rate": "(n_dup_lines + 1) / (n_words + 1)", "repeat_rate": "(n_repeat_words + 1) / (n_words + 1)", "word_length": "word_chars / n_words"}
    values = ", ".join(f"{{'rate': '{r}', 'v': {x}}}" for r, x in rates.items())
    level = lambda keys: f"""SELECT {keys + ', ' if keys else ''}rate, max(docs) AS docs, min(bucket) FILTER (upto >= ceil(docs * 0.25)) AS q1, min(bucket) FILTER (upto >= ceil(docs * 0.75)) AS q3 FROM
 (SELECT *, sum(n) OVER (PARTITION BY {keys + ', ' if keys else ''}rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys + ', ' if keys else ''}rate) AS docs
 FROM (SELECT {keys + ', ' if keys else ''}rate, bucket, sum(n) AS n FROM sk GROUP BY {keys + ', ' if keys else ''}rate, bucket)) GROUP BY {keys + ', ' if keys else ''}rate"""  # noqa: E731
    pick = lambda c: f"CASE WHEN a.docs >= 50 THEN a.{c} WHEN b.docs >= 50 THEN b.{c} ELSE c.{c} END"
    # rows are told apart by their number, since ids and texts may repeat
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
 u AS (SELECT i, unnest(w) AS x, generate_subscripts(w, 1) AS k, len(w) AS n FROM d),
 tri AS (SELECT i, k, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g FROM u WINDOW o AS (PARTITION BY i ORDER BY k)),
 twice AS (SELECT i, k FROM (SELECT i, k, count(*) OVER (PARTITION BY i, g) AS m FROM tri WHERE g IS NOT NULL) WHERE m > 1),
 rep AS (SELECT i, count(DISTINCT k + s) AS n FROM twice, range(3) AS t(s) GROUP BY i),
 dup AS (SELECT i, count(*) - count(DISTINCT l) AS n FROM (SELECT i, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY i),
 m AS MATERIALIZED (SELECT d.i, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(CASE WHEN len(w) > 0 THEN length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) ELSE 0 END AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.i = d.i LEFT JOIN dup ON dup.i = d.i),
 f AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
 long AS (SELECT i, lang, source, rate, CAST(ceil(ln(v) / ln(1.01 / 0.99)) AS INT) AS bucket FROM (SELECT i, lang, source, unnest([{values}], recursive := true) FROM f WHERE NOT base_failed)),
 sk AS MATERIALIZED (SELECT lang, source, rate, bucket, count(*) AS n FROM long GROUP BY ALL),
 a AS ({level('lang, source')}), b AS ({level('lang')}), c AS ({level('')}),
 fence AS (SELECT a.lang, a.source, a.rate, {pick('q1')} AS q1, {pick('q3')} AS q3 FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.rate = b.rate JOIN c ON a.rate = c.rate),
 bad AS (SELECT DISTINCT i FROM long l JOIN fence e ON l.lang IS NOT DISTINCT FROM e.lang AND l.source IS NOT DISTINCT FROM e.source AND l.rate = e.rate
  WHERE bucket > q3 + 3 * (q3 - q1) OR l.rate = 'word_length' AND bucket < q1 - 3 * (q3 - q1))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.i IS NULL AS kept FROM f LEFT JOIN bad ON bad.i = f.i"""
