"""SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

BENCHMARK_DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT n FROM wins))),
found AS (SELECT doc_id, item_id, i, s.n FROM starts s JOIN wins USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""

EXACT_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

CHAT_FORMATTING = """
WITH said AS (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
  FROM conversations WHERE role = 'assistant'),
ends AS (
  SELECT a.conv_id, a.turn, coalesce(b.text, '') AS stale
  FROM said a LEFT JOIN said b ON a.conv_id = b.conv_id AND b.r = 2 WHERE a.r = 1),
sides AS (
  SELECT 'c' AS side, c.conv_id, c.turn, role, text
  FROM conversations c JOIN ends e ON c.conv_id = e.conv_id AND c.turn <= e.turn
  UNION ALL
  SELECT 'r', c.conv_id, c.turn, role, CASE WHEN c.turn = e.turn THEN stale ELSE text END
  FROM conversations c JOIN ends e ON c.conv_id = e.conv_id AND c.turn <= e.turn),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn, role, text) AS i,
    '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown
  FROM sides),
common AS (
  SELECT c.conv_id, coalesce(min(c.i) FILTER (WHERE r.i IS NULL OR c.role <> r.role OR c.text <> r.text) - 1, count(*)) AS n_common
  FROM (SELECT * FROM numbered WHERE side = 'c') c LEFT JOIN (SELECT * FROM numbered WHERE side = 'r') r ON c.conv_id = r.conv_id AND c.i = r.i
  GROUP BY c.conv_id),
placed AS (
  SELECT n.*, n_common, sum(length(shown)) OVER (PARTITION BY side, n.conv_id ORDER BY i) AS z
  FROM numbered n JOIN common USING (conv_id))
SELECT conv_id, CAST(any_value(n_common) AS BIGINT) AS n_common,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 'c' AND i <= n_common), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 'c' AND i > n_common), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 'r' AND i > n_common), '') AS rejected,
  coalesce(string_agg((z - length(text) - 11) || ':' || z, ',' ORDER BY i) FILTER (WHERE side = 'c' AND i > n_common AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((z - length(text) - 11) || ':' || z, ',' ORDER BY i) FILTER (WHERE side = 'r' AND i > n_common AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY conv_id
"""

LINE_DEDUP = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM d),
runs AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
firsts AS (
  SELECT *, first_value(doc_id) OVER w AS first_id, first_value(pos) OVER w AS first_pos
  FROM runs WHERE win IS NOT NULL WINDOW w AS (PARTITION BY win ORDER BY doc_id, pos)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = first_id THEN greatest(pos, first_pos + 3) ELSE pos END, pos + 3)) AS pos
  FROM firsts WHERE doc_id <> first_id OR pos > first_pos),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.pos IS NULL) AS left_over, count(g.pos) AS n_removed, count(*) AS n_lines
  FROM lines l LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(left_over, '') END AS text,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM d LEFT JOIN kept USING (doc_id)
"""


def secret_scans(rules, n_base: int) -> str:
    """SQL for the secret scan.  Marks stand around each match; (pieces of) the
    text between marks then give the places.  The marks are control characters
    that stand for nothing in the texts.

    ``rules`` are (kind, pattern, group, least length, class that may not stand
    before); the patterns are plain enough to mean the same to both engines, with
    both cases spelled out.
    """
    parts = []
    for order, (kind, pattern, group, least, after_no) in enumerate(rules):
        quoted = pattern.replace("'", "''")
        marked = f"(^|[^{after_no[1:]})({quoted})" if after_no else f"()({quoted})"
        parts.append(f"""
  SELECT doc_id, {order} AS o, '{kind}' AS kind, {least} AS least, i, p, left(p, strpos(p, chr(2)) - 1) AS m,
    regexp_extract(left(p, strpos(p, chr(2)) - 1), '{quoted}', {group}) AS g
  FROM (
    SELECT doc_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS i
    FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '{marked}', '\\1' || chr(1) || '\\2' || chr(2), 'g'), chr(1)) AS ps FROM documents))""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{rules[k][0]}') AS n_{rules[k][0]}" for k in range(n_base))
    return f"""
WITH pieces AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT *, coalesce(sum(CASE WHEN i = 0 THEN length(p) ELSE length(p) - 1 END)
    OVER (PARTITION BY doc_id, o ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM pieces),
spans AS (SELECT doc_id, o, kind, a, kind || ':' || a || ':' || (a + length(m)) AS s FROM placed WHERE i > 0 AND length(g) >= least),
told AS (
  SELECT doc_id, {counts}, string_agg(s, ',' ORDER BY a, o) FILTER (WHERE o < {n_base}) AS base, string_agg(s, ',' ORDER BY a, o) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{rules[k][0]}, 0) AS n_{rules[k][0]}" for k in range(n_base))},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN told USING (doc_id)
"""
