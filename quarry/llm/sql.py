"""DuckDB SQL for the queries of this folder that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
n AS (SELECT item_id, w, least(len(w), 8) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, list_slice(w, i, i + m - 1) AS win FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM n)),
dw AS (SELECT doc_id, i, m, list_slice(w, i, i + m - 1) AS win
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP5 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, lag(role, 1, 'start') OVER w AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
             replace(replace(text, '\', '\b'), '<', '\l') AS escaped, replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS marked
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn ' || marked || '>' || escaped || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
       bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AND (k < n OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""

_TRIM = r"' ' || chr(9) || chr(13) || chr(12) || chr(11)"

OP8 = rf"""
WITH l AS (SELECT doc_id, source, generate_subscripts(s, 1) AS pos, unnest(s) AS raw FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
t AS (SELECT *, trim(raw, {_TRIM}) AS line FROM l),
boiler AS (SELECT line, min((doc_id, pos)) AS first FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5),
m AS (SELECT t.*, boiler.line IS NOT NULL AND (t.doc_id, t.pos) IS DISTINCT FROM boiler.first AS gone FROM t LEFT JOIN boiler ON t.line = boiler.line),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN k.text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN k USING (doc_id)
"""

OP9 = """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(e, lambda x: floor(64 * x)) AS v FROM f WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.rid <> c.rid),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES = {"op2_decontaminate": OP2, "op5_chat_format": OP5, "op8_line_dedup": OP8, "op9_topk": OP9}
