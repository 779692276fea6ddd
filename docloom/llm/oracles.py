"""DuckDB SQL of the queries that SQL can express."""

_WORDS = r"[x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> '']"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in string_split_regex({_LOWER}, '[\x20\x09-\x0D]+') if x <> ''] AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i : i + 4], ' ') for i in range(1, len(ws) - 3)] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT b.v, r.root FROM reach r JOIN both_ways b ON b.u = r.doc_id
)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP5 = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS ws,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> ''] AS ls FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS k FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i)
), twice AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
), base AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls) AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeated r ON r.doc_id = w.doc_id
), failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines AS rule_failed FROM base
), host AS (
  SELECT source, count(*)::DOUBLE AS n, sum(rule_failed::INT)::DOUBLE AS k FROM failed GROUP BY source
), total AS (
  SELECT sum(n) AS total, sum(k) / sum(n) AS p, count(*) AS h, sum(k * k / n) AS squares, sum(n * n) AS sizes FROM host
), prior AS (
  SELECT p, greatest(p * (1 - p) / greatest(CASE WHEN total - sizes / total > 0
    THEN (squares - total * p * p - (h - 1) * p * (1 - p)) / (total - sizes / total) ELSE 0 END, 1e-9) - 1, 1e-3) AS strength FROM total
), verdict AS (
  SELECT source, (k + strength * p) / (n + strength) <= 0.5 AS ok FROM host, prior
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND v.ok AS kept
FROM failed f JOIN verdict v ON f.source IS NOT DISTINCT FROM v.source
"""

_CONTENT = r"[x for x in string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> '']"

OP6 = rf"""
WITH d AS (
  SELECT doc_id, {_CONTENT.format(_LOWER)} AS ws FROM documents
), b AS (
  SELECT item_id, {_CONTENT.format(_LOWER)} AS ws FROM benchmark WHERE item_id IS NOT NULL
), q AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS k
  FROM b, LATERAL (SELECT unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i) WHERE len(ws) > 0
), sizes AS (
  SELECT DISTINCT size FROM q
), place AS (
  SELECT doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS k
  FROM d, sizes, LATERAL (SELECT unnest(range(1, len(ws) - size + 2)) AS i)
), found AS (
  SELECT doc_id, i, place.size, q.item_id FROM place JOIN q ON place.k = q.k AND place.size = q.size
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id
), token AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d
), total AS (
  SELECT w, count(*) AS n FROM token GROUP BY w
), term AS (
  SELECT k, size, unnest(string_split(k, ' ')) AS w, generate_subscripts(string_split(k, ' '), 1) AS o FROM (SELECT DISTINCT k, size FROM q)
), rarest AS (
  SELECT k, size, term.w, o FROM term JOIN total ON total.w = term.w QUALIFY row_number() OVER (PARTITION BY k ORDER BY n, o) = 1
), around AS (
  SELECT t.doc_id, r.k, r.size, t.p - r.o AS s FROM token t JOIN rarest r ON r.w = t.w
), close AS (
  SELECT DISTINCT doc_id, k FROM (
    SELECT a.doc_id, a.k, a.size, a.s, count(DISTINCT term.o) AS c FROM around a JOIN term ON term.k = a.k
    JOIN token t ON t.doc_id = a.doc_id AND t.w = term.w AND abs(t.p - a.s - term.o) <= 1 GROUP BY ALL
  ) WHERE c = size
), near_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n FROM close JOIN q ON q.k = close.k GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(near_items.n, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN near_items ON near_items.doc_id = d.doc_id
"""

OP8 = r"""
WITH page AS (
  SELECT row_number() OVER () AS page, * FROM documents
), l AS (
  SELECT page, doc_id, source, ordinality AS i, line FROM page, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, ordinality) WHERE text IS NOT NULL
), pages AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), seen AS (
  SELECT source, line, count(DISTINCT page) AS n FROM l WHERE regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') <> '' GROUP BY source, line
), bad AS (
  SELECT s.source, s.line FROM seen s JOIN pages p ON s.source IS NOT DISTINCT FROM p.source WHERE s.n >= 5 AND s.n > 0.03::DOUBLE * p.n
), marked AS (
  SELECT l.*, b.line IS NOT NULL AS drop_it FROM l LEFT JOIN bad b ON l.line = b.line AND l.source IS NOT DISTINCT FROM b.source
), cleaned AS (
  SELECT page, count(*) AS n, count(*) FILTER (drop_it) AS dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop_it), '')) AS kept FROM marked GROUP BY page
)
SELECT page.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(dropped, 0)::BIGINT AS n_dropped, kept AS kept_sha256
FROM page LEFT JOIN cleaned ON cleaned.page = page.page
"""

OP9 = rf"""
WITH w AS (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS i)
), lost AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS owner FROM g) WHERE owner < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM lost) GROUP BY doc_id
), each AS (
  SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT e.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM each e LEFT JOIN (SELECT doc_id, unnest(ps) AS q FROM gone) z ON z.doc_id = e.doc_id AND z.q = e.p
  WHERE z.q IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

ORACLE_SQL = {
    "op4_ngram_jaccard": OP4,
    "op5_quality_rules": OP5,
    "op6_decontamination": OP6,
    "op8_line_dedup": OP8,
    "op9_substring_dedup": OP9,
}
