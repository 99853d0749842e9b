"""SQL that gives the rows of the corpus queries, where SQL can."""

import math

from .chat import CONTROL, END, TURN
from .quality_rules import RULES

_WORDS = r"'[^ \t\n\v\f\r]+'"
_SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.v) = 0 THEN 0 ELSE list_inner_product(q.v, c.v) END::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_WORDS}), []) AS w FROM documents),
 s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
 m AS (SELECT k, min(doc_id) AS o FROM s GROUP BY 1),
 r AS (SELECT DISTINCT doc_id, i + j AS p FROM s JOIN m USING (k), (SELECT range AS j FROM range(50)) WHERE o < doc_id),
 u AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
 k AS (SELECT u.doc_id, count(r.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY u.p) FILTER (r.p IS NULL), '') AS kept FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.p = u.p GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_SMALL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
 b AS (SELECT item_id::VARCHAR AS item, coalesce(regexp_extract_all({_SMALL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
 i AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') AS k FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(j) WHERE len(w) > 0),
 s AS (SELECT doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM i), unnest(range(1, len(w) - n + 2)) AS t(j)),
 h AS (SELECT doc_id, item, s.n, j FROM s JOIN i ON s.n = i.n AND s.k = i.k),
 c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM h) GROUP BY 1),
 g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)"""

_CONTROLS = "|".join("".join(f"\\{c}" if c in "|[]/<>" and c in "|[]" else c for c in s) for s in CONTROL)
_CHARS = rf"(length({{0}}) + length({{0}}) - length(replace({{0}}, '\', '')) + len(regexp_extract_all({{0}}, '{_CONTROLS}')))"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum({len(TURN) + len(END) + 2} + {_CHARS.format("role")} + {_CHARS.format("text")})::BIGINT AS formatted_chars FROM c GROUP BY 1"""

SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM d, unnest(range(0, length(h) // 2 - 49)) AS t(i)),
 m AS (SELECT k, min(doc_id) AS o FROM s GROUP BY 1),
 r AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s JOIN m USING (k) WHERE o < doc_id),
 p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
 q AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM (SELECT *, (a > coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))::INT AS fresh FROM p)),
 z AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM q GROUP BY doc_id, g),
 e AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS rn FROM z),
 k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(CASE WHEN rn = 1 THEN substr(h, 1, 2 * a) ELSE '' END || substr(h, 2 * b + 1, 2 * (coalesce(n, length(h) // 2) - b)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_SMALL.format("text")}, {_WORDS}), []) AS w FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS k FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 r(id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT r.id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY 1"""


AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, {_WORDS}), []) AS w FROM documents),
 e AS (SELECT t, min(doc_id) AS first FROM d GROUP BY 1),
 l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
 m AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, map {{{{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': doc_id > first}}}} AS f FROM d JOIN e USING (t) LEFT JOIN l USING (doc_id)),
 c AS (SELECT part, good, toxic, f, count(*) AS n FROM m GROUP BY ALL),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
 r AS (SELECT *, filter_order[step] AS own, f[filter_order[step]] AS fails, len(list_filter(range(1, step), lambda s: f[filter_order[s]])) > 0 AS gone, len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: f[y])) AS fs FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
 g AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (fails AND fs = 1), 0) AS unique_fails, coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g""".replace("{{", "{").replace("}}", "}")

_ALPHA, _DELTA = 0.03, 0.05
_RULE = {r: f"CASE WHEN n_words > 0 THEN {m.replace(' div ', ' // ')} END" for r, (m, _) in RULES.items()}
_TESTS = " UNION ALL ".join(f"SELECT '{r}' AS rule, {_RULE[r]} AS v, unnest({list(range(len(cuts)))}) AS step, unnest({cuts}) AS cutoff, lang, good FROM p" for r, (_, cuts) in RULES.items())
_ABOVE = " OR ".join(f"coalesce({_RULE[r]} > c.cut['{r}'], false)" for r in RULES)
RULED = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, {_WORDS}), []) AS w FROM documents),
 s AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
 a AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM s),
 u AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM a, (SELECT range AS j FROM range(5)) WHERE c > 1 GROUP BY 1),
 m AS (SELECT d.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS y, coalesce(u.n, 0) AS n_repeat_words FROM d LEFT JOIN u USING (doc_id)),
 b AS MATERIALIZED (SELECT *, len(y) - len(list_distinct(y)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
 l AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
 p AS (SELECT * FROM b JOIN l USING (doc_id) WHERE NOT base_failed),
 h AS ({_TESTS}),
 k AS (SELECT lang, rule, step, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS nb, count(*) FILTER (good AND coalesce(v > cutoff, false)) AS g, count(*) FILTER (NOT good AND coalesce(v > cutoff, false)) AS bad FROM h GROUP BY ALL),
 q AS (SELECT *, count(DISTINCT lang) OVER () AS strata, CASE WHEN g >= n * {_ALPHA / len(RULES)!r} THEN 1.0 ELSE list_sum(list_transform(range(0, g + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * {math.log(_ALPHA / len(RULES))!r} + (n - j) * {math.log1p(-_ALPHA / len(RULES))!r}))) END AS tail FROM k WHERE n > 0),
 r AS (SELECT *, bool_and(tail <= {_DELTA / len(RULES)!r} / strata) OVER (PARTITION BY lang, rule ORDER BY step) AS certified, bad * n - g * greatest(nb, 1) AS gain FROM q),
 z AS (SELECT lang, rule, cutoff FROM r WHERE certified AND gain > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, step) = 1),
 c AS (SELECT lang, map_from_entries(list((rule, cutoff))) AS cut FROM z GROUP BY 1)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT ({_ABOVE}) AS kept FROM b LEFT JOIN c USING (lang)"""
