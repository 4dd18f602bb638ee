"""DuckDB SQL for the results of the queries that SQL can express."""

from __future__ import annotations

_BLANK = r"[\x20\x09-\x0D]+"

_WORDS = rf"""
texts AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, rid, list_filter(string_split_regex(text, '{_BLANK}'), lambda x: x <> '') AS w FROM texts)"""

OP2 = rf"""
WITH RECURSIVE
texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT doc_id, list_filter(string_split_regex(text, '{_BLANK}'), lambda x: x <> '') AS w FROM texts),
raw AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) AS s FROM words WHERE len(w) >= 4
  UNION ALL SELECT doc_id, array_to_string(w, ' ') AS s FROM words WHERE len(w) BETWEEN 1 AND 3),
sets AS (SELECT DISTINCT doc_id, s FROM raw),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON least.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""

OP7 = rf"""
WITH {_WORDS},
starts AS (SELECT rid, unnest(range(1, len(w) - 33)) AS i, w FROM words WHERE len(w) >= 35),
wins AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM starts),
again AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT rid, i + k AS p FROM again, (SELECT unnest(range(0, 35)) AS k)),
places AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM words),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM places ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (rid)
"""

OP9_EVENTS = """(VALUES {rows}) AS f(list, kind, value, action, day)"""

OP9 = r"""
WITH named AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host FROM pages),
hosts AS (SELECT DISTINCT host AS value, md5(host) AS digest, DATE '2024-01-01' + CAST(length(host) * 7 % 300 AS INTEGER) AS day FROM named WHERE host IS NOT NULL AND substring(md5(host), 1, 1) < '4'),
events AS (
  SELECT list, kind, value, action, DATE '2024-01-01' + day AS moment FROM {events}
  UNION ALL SELECT 'block', 'host', value, 'add', day FROM hosts
  UNION ALL SELECT 'block', 'host', value, 'remove', day + 90 FROM hosts WHERE substring(digest, 2, 1) < '8'),
turns AS (SELECT *, lag(action, 1, 'remove') OVER (PARTITION BY list, kind, value ORDER BY moment, action = 'add') AS earlier FROM events),
spans AS (SELECT list, kind, value, action, moment AS since, lead(moment) OVER (PARTITION BY list, kind, value ORDER BY moment, action = 'add') AS until FROM turns WHERE action <> earlier),
labels AS (SELECT page_id, host, string_split(host, '.') AS l FROM named WHERE host IS NOT NULL),
keys AS (
  SELECT page_id, 'host' AS kind, host AS value FROM labels
  UNION ALL SELECT page_id, 'url', lower(host || regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '/$', '')) FROM named WHERE host IS NOT NULL
  UNION ALL SELECT page_id, 'domain', array_to_string(list_slice(l, i, len(l)), '.') FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM labels)),
met AS (
  SELECT n.page_id, s.list, s.kind, s.value FROM named n JOIN keys k ON k.page_id = n.page_id JOIN spans s ON s.kind = k.kind AND s.value = k.value
  WHERE s.action = 'add' AND s.since <= n.fetched AND (s.until IS NULL OR n.fetched < s.until)
  QUALIFY row_number() OVER (PARTITION BY n.page_id ORDER BY CASE s.kind WHEN 'url' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(s.value) DESC, s.list DESC) = 1)
SELECT n.page_id, n.host, coalesce(m.list = 'block', FALSE) AS blocked, m.list, m.kind, m.value FROM named n LEFT JOIN met m ON m.page_id = n.page_id
"""

OP10 = r"""
WITH texts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS line FROM texts),
worded AS (SELECT doc_id, p, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
wins AS (SELECT doc_id, k, line || chr(10) || lead(line) OVER d || chr(10) || lead(line, 2) OVER d AS s FROM worded WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
ranked AS (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS r FROM wins WHERE s IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM ranked, (SELECT unnest(range(0, 3)) AS j) WHERE r > 1),
places AS (SELECT w.doc_id, w.p FROM worded w JOIN gone g ON g.doc_id = w.doc_id AND g.k = w.k),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM lines ANTI JOIN places USING (doc_id, p) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM worded GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN removed r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def op9(events: tuple) -> str:
    """The SQL of op9 for a fixed list of events."""
    rows = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in e) + ")" for e in events)
    return OP9.replace("{events}", OP9_EVENTS.replace("{rows}", rows))
