"""DuckDB SQL of the subpackage's queries, where SQL can express them."""

_LINES = r"""
parts AS (
  SELECT doc_id, text, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS all_lines FROM documents
), kept AS (
  SELECT doc_id, text, all_lines, list_filter(range(1, len(all_lines) + 1), lambda i: all_lines[i] <> '') AS places FROM parts
), windows AS (
  SELECT doc_id, i - 1 AS pos, array_to_string([all_lines[places[i]], all_lines[places[i + 1]], all_lines[places[i + 2]]], chr(10)) AS w
  FROM kept, LATERAL (SELECT unnest(range(1, len(places) - 1)) AS i)
), owned AS (
  SELECT w, min(doc_id) AS owner, min(pos) FILTER (WHERE doc_id = least_doc) AS first_pos
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY w) AS least_doc FROM windows) GROUP BY w
), inside AS (
  SELECT *, min(pos) OVER (PARTITION BY doc_id, w) AS own_first FROM windows
), later AS (
  SELECT i.doc_id, i.pos FROM inside i JOIN owned o USING (w) WHERE i.doc_id > o.owner OR i.pos >= i.own_first + 3
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS n FROM later, (SELECT unnest([0, 1, 2]) AS d)
), runs AS (
  SELECT doc_id, min(n) AS a, max(n) AS b FROM (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM gone) GROUP BY doc_id, g
), merged AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed, sum(b - a + 1)::BIGINT AS n_removed FROM runs GROUP BY doc_id
), by_doc AS (
  SELECT doc_id, list(n) AS gone FROM gone GROUP BY doc_id
)"""

OP5 = f"""
WITH {_LINES}
SELECT k.doc_id,
       CASE WHEN m.n_removed IS NULL THEN coalesce(k.text, '') WHEN m.n_removed = len(k.places) THEN ''
            ELSE array_to_string(list_filter(string_split(k.text, chr(10)), lambda x, i: NOT list_contains(list_transform(g.gone, lambda n: k.places[n + 1]), i)), chr(10)) END AS text,
       len(k.places)::BIGINT AS n_lines, coalesce(m.n_removed, 0)::BIGINT AS n_removed, coalesce(m.removed, '') AS removed
FROM kept k LEFT JOIN merged m USING (doc_id) LEFT JOIN by_doc g USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM words, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7 = rf"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), keys AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS k
  FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i) WHERE len(w) > 0
), lengths AS (
  SELECT DISTINCT n FROM keys
), spots AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, lengths, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n
), hits AS (
  SELECT s.doc_id, s.i, s.n, k.item FROM spots s JOIN keys k ON s.k = k.k AND s.n = k.n
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(x.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(x.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named x USING (doc_id)
"""

ORACLE: dict[str, str] = {"op5_line_windows": OP5, "op6_minhash_stars": OP6, "op7_benchmark_automaton": OP7}
