r"""DuckDB SQL for those queries of this subpackage that SQL can express on whole tables."""

ORACLES: dict[str, str] = {}

WORDS = r"SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents"

ORACLES["op4_adaptive_rules"] = rf"""
WITH d AS ({WORDS}),
wins AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, w[s], w[s + 1], w[s + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)),
reps AS (SELECT doc_id, count(DISTINCT i) AS r FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS i FROM wins WHERE n > 1) GROUP BY 1),
dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dl FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dl, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words
  FROM d LEFT JOIN reps USING (doc_id) LEFT JOIN dups USING (doc_id)),
m AS (SELECT doc_id, lang, source, unnest(['words', 'length', 'symbols', 'lines', 'repeats']) AS measure, unnest([n_words, word_chars / n_words, n_symbols / n_words, n_dup_lines / n_words, n_repeat_words / n_words]) AS x FROM f WHERE n_words > 0),
b AS (SELECT *, CASE WHEN x > 0 THEN ceil(ln(x) / ln(1.02)) ELSE -1048576 END AS bucket FROM m),
g AS (SELECT 0 AS level, lang AS l, source AS s, measure, bucket, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 1, lang, NULL, measure, bucket, count(*) FROM b GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, measure, bucket, count(*) FROM b GROUP BY ALL),
v AS (SELECT *, CASE WHEN bucket > -1048576 THEN 2 * pow(1.02, bucket) / 2.02 ELSE 0 END AS v FROM g),
z AS (SELECT *, CASE measure WHEN 'words' THEN v WHEN 'length' THEN ln(v) ELSE sqrt(v) END AS y, 'up' AS side FROM v UNION ALL SELECT *, -ln(v), 'low' FROM v WHERE measure = 'length'),
c AS (SELECT *, sum(n) OVER w AS upto, sum(n * y) OVER w AS sy, sum(n * y * y) OVER w AS syy, sum(n) OVER (PARTITION BY level, l, s, measure, side) AS total FROM z WINDOW w AS (PARTITION BY level, l, s, measure, side ORDER BY y)),
size AS (SELECT level, l, s, min(v) FILTER (WHERE upto >= 0.5 * total) AS size FROM c WHERE measure = 'words' GROUP BY ALL),
tried AS (SELECT i.level, i.l, i.s, i.measure, i.side, i.bucket, i.y, i.upto, i.sy, i.syy, min(j.y) FILTER (WHERE j.upto >= i.upto + 0.05 * (i.total - i.upto)) - min(j.y) FILTER (WHERE j.upto >= 0.99 * i.upto) AS gap
  FROM c i JOIN c j ON i.level = j.level AND i.l IS NOT DISTINCT FROM j.l AND i.s IS NOT DISTINCT FROM j.s AND i.measure = j.measure AND i.side = j.side
  WHERE i.measure <> 'words' AND i.upto >= i.total / 2 AND i.upto < i.total GROUP BY ALL),
cuts AS (SELECT t.level, t.l, t.s, t.measure, t.side, arg_min(bucket, y) AS bucket FROM tried t JOIN size ON t.level = size.level AND t.l IS NOT DISTINCT FROM size.l AND t.s IS NOT DISTINCT FROM size.s
  WHERE gap >= 2.5 * sqrt(greatest(syy / upto - (sy / upto) * (sy / upto), 0) + CASE measure WHEN 'repeats' THEN 6 ELSE 1 END / size / 4) GROUP BY ALL),
q AS (SELECT level, l, s, measure, any_value(total) AS total, min(v) FILTER (WHERE upto >= 0.5 * total) AS q50, min(y) FILTER (WHERE upto >= 0.5 * total) AS mid, min(y) FILTER (WHERE upto >= 0.05 * total) AS few, min(y) FILTER (WHERE upto >= 0.95 * total) AS most FROM c WHERE side = 'up' AND measure <> 'words' GROUP BY ALL),
r AS (SELECT q.level, q.l, q.s, q.measure, total, q50, CASE WHEN u.bucket > -1048576 THEN pow(1.02, u.bucket) WHEN u.bucket IS NOT NULL THEN 0 END AS cut, pow(1.02, d.bucket - 1) AS low_cut,
  CASE WHEN mid > few THEN CASE measure WHEN 'length' THEN exp(mid + 3 * (mid - few)) ELSE pow(mid + 3 * (mid - few), 2) END END AS rest, CASE WHEN most > mid THEN exp(mid - 3 * (most - mid)) END AS low_rest
  FROM q LEFT JOIN (SELECT level AS ul, l AS u_l, s AS u_s, measure AS um, bucket FROM cuts WHERE side = 'up') u ON q.level = ul AND q.l IS NOT DISTINCT FROM u_l AND q.s IS NOT DISTINCT FROM u_s AND q.measure = um
  LEFT JOIN (SELECT level AS dl, l AS d_l, s AS d_s, measure AS dm, bucket FROM cuts WHERE side = 'low') d ON q.level = dl AND q.l IS NOT DISTINCT FROM d_l AND q.s IS NOT DISTINCT FROM d_s AND q.measure = dm),
t AS (SELECT m.doc_id, m.measure, m.x,
  coalesce(CASE WHEN r0.total >= 200 AND r0.q50 <= r0.cut THEN r0.cut END, CASE WHEN r1.total >= 200 AND r0.q50 <= r1.cut THEN r1.cut END, CASE WHEN r0.q50 <= r2.cut THEN r2.cut END, CASE WHEN r0.total >= 200 THEN r0.rest END, CASE WHEN r1.total >= 200 THEN r1.rest END, r2.rest) AS top,
  coalesce(CASE WHEN r0.total >= 200 AND r0.q50 >= r0.low_cut THEN r0.low_cut END, CASE WHEN r1.total >= 200 AND r0.q50 >= r1.low_cut THEN r1.low_cut END, CASE WHEN r0.q50 >= r2.low_cut THEN r2.low_cut END, CASE WHEN r0.total >= 200 THEN r0.low_rest END, CASE WHEN r1.total >= 200 THEN r1.low_rest END, r2.low_rest) AS bottom
  FROM m JOIN r r0 ON r0.level = 0 AND r0.measure = m.measure AND r0.l IS NOT DISTINCT FROM m.lang AND r0.s IS NOT DISTINCT FROM m.source
  JOIN r r1 ON r1.level = 1 AND r1.measure = m.measure AND r1.l IS NOT DISTINCT FROM m.lang JOIN r r2 ON r2.level = 2 AND r2.measure = m.measure),
bad AS (SELECT DISTINCT doc_id FROM t WHERE x > top OR measure = 'length' AND x <= bottom)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f
"""

ORACLES["op9_repeated_windows"] = rf"""
WITH d AS ({WORDS}),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35),
k AS (SELECT doc_id, s, count(*) OVER (PARTITION BY array_to_string(list_slice(w, s, s + 34), ' ')) AS n FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM k WHERE n > 1),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op10_lsh_forest"] = rf"""
WITH RECURSIVE d AS ({WORDS}),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM sh GROUP BY doc_id),
cls AS (SELECT k, min(doc_id) AS copy_id, count(*) AS n_copies, any_value(n) AS n FROM sets GROUP BY k),
reps AS (SELECT doc_id, g, cls.n FROM sh JOIN cls ON doc_id = copy_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM reps a JOIN reps b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-6),
reach AS (SELECT copy_id AS root, copy_id AS node FROM cls UNION SELECT root, b FROM reach JOIN links ON node = a),
class AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(copy_id, d.doc_id) AS copy_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN cls USING (k) LEFT JOIN class ON node = copy_id LEFT JOIN degree ON a = copy_id
"""

ORACLES["op13_relational_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(i)),
m AS (SELECT *, length(t) + length(t) - length(replace(t, '\', '')) + coalesce(list_sum(list_transform(regexp_extract_all(t, '#{3,}'), lambda x: length(x) - 2)), 0) + len(regexp_extract_all(t, '</(turn|part)>')) AS size,
  length(role) + length(role) - length(replace(role, '\', '')) + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)), 0) + len(regexp_extract_all(role, '</(turn|part)>|:\n')) AS head,
  coalesce(role = lag(role) OVER w, false) AS goes_on, coalesce(role = lead(role) OVER w, false) AS is_gone_on FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN goes_on THEN 7 ELSE 6 + head END + size + CASE WHEN is_gone_on THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
