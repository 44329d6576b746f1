"""DuckDB SQL for the operators whose rows SQL can express: brute-force forms, over whole tables and texts."""

from __future__ import annotations

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOWER.format("text")

#: Pairs by shared shingles, then the smallest label that reaches each document.
NEAR_DEDUP = rf"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE [w[j] || ' ' || w[j + 1] for j in range(1, len(w))] END) AS s
  FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
reach(node, label) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT links.b, reach.label FROM reach JOIN links ON links.a = reach.node WHERE reach.label < links.b
),
smallest AS (SELECT node, min(label) AS label FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, label AS component_id, doc_id = label AS kept
FROM sets JOIN smallest ON node = doc_id
"""

#: Every window of every document against every window of every item.
CONTAMINATION = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, w, least(13, len(w)) AS span
  FROM (SELECT item_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
),
item_windows AS (
  SELECT DISTINCT item_id, span, array_to_string(w[j:j + span - 1], ' ') AS win
  FROM (SELECT item_id, w, span, unnest(generate_series(1, len(w) - span + 1)) AS j FROM items)
),
doc_windows AS (
  SELECT doc_id, span, j, array_to_string(w[j:j + span - 1], ' ') AS win
  FROM (
    SELECT doc_id, w, span, unnest(generate_series(1, len(w) - span + 1)) AS j
    FROM docs, (SELECT DISTINCT span FROM items) WHERE len(w) >= span
  )
),
found AS (SELECT d.doc_id, d.span, d.j, i.item_id FROM doc_windows d JOIN item_windows i ON d.span = i.span AND d.win = i.win),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(j, j + span - 1)) AS p FROM (SELECT DISTINCT doc_id, j, span FROM found))
  GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: Base32 of SHA-1: five hexadecimal digits are four letters.
ARCHIVED = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
digests AS (SELECT page_id, body, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM payloads)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * (c // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (c % 4) AS INTEGER)) & 31) + 1, 1)
    for c in range(32)
  ], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests
"""


def url_filter(rules: list[tuple[str, str, str]], blocklist: list[str], names: list[str]) -> str:
    """Cases of the rules, the longest first; then the blocked hosts and names."""
    within = lambda h: f"(host = '{h}' OR ends_with(host, '.{h}'))"
    fits = [(f"{within(h)} AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(reversed(rules), key=lambda r: -len(r[0] + r[1]))]
    case = lambda at: " ".join(f"WHEN {f[0]} THEN '{f[at]}'" for f in fits)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, {_LOWER.format("regexp_extract(r, '^([^/?#]*)', 1)")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
)
SELECT page_id, host, path, CASE {case(1)} END AS rule,
  CASE {case(2)} WHEN {" OR ".join(map(within, blocklist))} OR list_has_any(string_split(host, '.'), {names!r}) THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""

#: Every phrase of one to four words, every cut, every longer phrase around it.
COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_TEXT}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (
  SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS j FROM words, (VALUES (1), (2), (3), (4)) v(k) WHERE len(w) >= k
),
f AS (SELECT lang, k, w[j:j + k - 1] AS p, count(*) AS a FROM places GROUP BY ALL),
candidates AS (SELECT * FROM f WHERE k >= 2 AND a >= 30),
cuts AS (
  SELECT c.lang, c.k, c.p, c.a, x.a AS l, y.a AS r, cut, CAST(2000000 AS HUGEINT) * c.a // (x.a + y.a) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1:cut] JOIN f y ON y.lang = c.lang AND y.p = c.p[cut + 1:c.k]
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS i FROM cuts) WHERE i = 1),
inner_ AS (
  SELECT lang, w[j:j + m - 1] AS p, max(a) AS most
  FROM (
    SELECT lang, p AS w, k, a, m, unnest(generate_series(1, k - m + 1)) AS j FROM candidates, (VALUES (2), (3)) v(m) WHERE m < k
  ) GROUP BY ALL
),
free AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM best
  WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = best.lang AND i.p = best.p AND 100 * i.most >= 80 * best.a)
),
sizes AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
