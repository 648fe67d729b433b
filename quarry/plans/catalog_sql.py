"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from ..values import CONTEXT_TAGS, GEO_LABEL, METRICS_LABEL, NO_TEXT, SKIP_KEYWORDS, SKIP_PATTERNS, TOKENS, YEARS_LABEL


# A test text in Cyrillic letters, as the tables hold none.
LATIN, AS_CYRILLIC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдеёжзіийклмнопрстуўхцчАБВГДЕЁЖЗІИЙКЛМНОПРСТУЎХЦЧ"


def _tokens(x: str, profile: str = "unicode") -> str:
    found = rf"regexp_extract_all(lower(coalesce({x}, '')), '{TOKENS[profile]}')"
    return rf"list_concat(list_filter({found}, lambda t: NOT regexp_full_match(t, '\d+')), list_filter({found}, lambda t: regexp_full_match(t, '\d+')))"


_DAY = "CASE {0} % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'quarter' ELSE 'month' END"

CHUNKS = f"""
d AS (SELECT *, row_number() OVER (ORDER BY source, doc_id) - 1 AS pos, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents),
c AS (SELECT d.doc_id, d.pos, d.source, d.page, d.source || '::page' || d.page || '::chunk' || d.pos AS id, d.text, substr(d.text, 1, 256) AS context, [d.lang] AS geo,
             list_slice({_tokens('substr(d.text, 1, 256)')}, 1, 2) AS metrics, [2000 + d.doc_id % 20, 2000 + d.doc_id % 20 + d.doc_id % 3] AS years, {_DAY.format('d.doc_id')} AS tg,
             lpad(CAST(d.doc_id % 30 AS VARCHAR), 2, '0') || CASE WHEN d.doc_id % 2 = 1 THEN '.1' ELSE '' END AS oked, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS v
      FROM d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
q AS (SELECT item_id AS query_id, text AS query, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS v, [CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END] AS geo,
             list_slice({_tokens('text')}, 1, 2) AS metrics, [2000 + item_id % 20] AS years, {_DAY.format('item_id')} AS tg, lpad(CAST(item_id % 30 AS VARCHAR), 2, '0') AS oked
      FROM benchmark LEFT JOIN embeddings e ON e.vec_id = item_id)
"""

SEMANTIC = """
s0 AS (SELECT q.query_id, c.pos, round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(c.v, c.v)), 9) AS score FROM q, c WHERE q.v IS NOT NULL AND c.v IS NOT NULL),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM s0) WHERE rank <= 20)
"""

INDEX = f"""
hint AS (SELECT pos, concat_ws(' ', array_to_string(list_slice(metrics, 1, 3), ' '), array_to_string(geo, ' '), list_min(years) || '-' || list_max(years)) AS h FROM c),
f AS (SELECT pos, 'text' AS field, {_tokens('text')} AS t FROM c UNION ALL SELECT pos, 'context', {_tokens('context')} FROM c UNION ALL SELECT pos, 'hints', {_tokens('h')} FROM hint),
corpus AS (SELECT field, count(*) AS n, avg(len(t)) AS avgdl FROM f GROUP BY field),
post AS (SELECT field, pos, dl, term, count(*) AS tf FROM (SELECT field, pos, len(t) AS dl, unnest(t) AS term FROM f) GROUP BY ALL),
raw AS (SELECT field, term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS r FROM post JOIN corpus USING (field) GROUP BY field, term),
idf AS (SELECT field, term, df, CASE WHEN r < 0 THEN 0.25::DOUBLE * (SELECT avg(r) FROM raw m WHERE m.field = raw.field) ELSE r END AS idf FROM raw)
"""

LEXICAL = f"""
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_concat({_tokens('query')}, list_concat({_tokens("array_to_string(geo, ' ')")}, {_tokens("array_to_string(metrics, ' ')")}))) AS term FROM q) GROUP BY ALL),
l0 AS (SELECT query_id, pos, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s FROM post JOIN qt USING (term) JOIN idf USING (field, term) JOIN corpus USING (field) GROUP BY query_id, pos),
l1 AS (SELECT q.query_id, c.pos, round(coalesce(s, 0), 9) AS score FROM q CROSS JOIN c LEFT JOIN l0 ON l0.query_id = q.query_id AND l0.pos = c.pos),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM l1) WHERE rank <= 20)
"""

META = f"""
cm AS (SELECT pos, list_distinct({_tokens("array_to_string(geo, ' ')")}) AS g, list_distinct({_tokens("array_to_string(metrics, ' ')")}) AS m, years AS y, tg, oked FROM c),
qm AS (SELECT query_id, list_distinct({_tokens("array_to_string(geo, ' ')")}) AS g, list_distinct({_tokens("array_to_string(metrics, ' ')")}) AS m, years AS y, tg, oked FROM q),
parts AS (SELECT query_id, pos, CASE WHEN len(cm.g) > 0 AND len(qm.g) > 0 THEN len(list_intersect(cm.g, qm.g))::DOUBLE / len(qm.g) ELSE 0 END AS geo,
     CASE WHEN len(cm.m) > 0 AND len(qm.m) > 0 THEN len(list_intersect(cm.m, qm.m))::DOUBLE / len(list_distinct(list_concat(cm.m, qm.m))) ELSE 0 END AS metrics,
     CASE WHEN len(list_intersect(cm.y, qm.y)) > 0 THEN len(list_intersect(cm.y, qm.y))::DOUBLE / len(list_distinct(qm.y)) WHEN list_max(cm.y) < list_min(qm.y) OR list_max(qm.y) < list_min(cm.y) THEN 0 ELSE 0.3 END::DOUBLE AS years,
     (cm.tg = qm.tg)::INT::DOUBLE AS granularity, CASE WHEN cm.oked = qm.oked THEN 1 WHEN starts_with(cm.oked, qm.oked) OR starts_with(qm.oked, cm.oked) THEN 0.7 ELSE 0 END::DOUBLE AS oked, len(qm.m) AS asked
     FROM cm, qm),
meta AS (SELECT *, round(least(1, 0.35::DOUBLE * geo + 0.30::DOUBLE * metrics + 0.20::DOUBLE * years + 0.05::DOUBLE * granularity + 0.10::DOUBLE * oked), 9) AS total FROM parts),
rec AS (SELECT * FROM (SELECT query_id, pos, total, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, pos) AS rank FROM meta WHERE total > 0 AND asked > 0) WHERE rank <= 50)
"""

FUSION = """
m0 AS (SELECT query_id, pos, score AS s, NULL::DOUBLE AS l, 0 AS origin, rank FROM sem UNION ALL SELECT query_id, pos, NULL, score, 1, rank FROM lex UNION ALL SELECT query_id, pos, NULL, NULL, 2, rank FROM rec),
m1 AS (SELECT query_id, pos, coalesce(max(s), 0) AS semantic_raw, coalesce(max(l), 0) AS lexical_raw, min((origin, rank)) AS o FROM m0 GROUP BY query_id, pos),
m2 AS (SELECT m1.*, meta.total AS metadata_score, ln(1 + greatest(lexical_raw, 0)) AS lg FROM m1 JOIN meta USING (query_id, pos)),
m3 AS (SELECT *, min(semantic_raw) OVER w AS a, max(semantic_raw) OVER w AS b, avg(semantic_raw) OVER w AS mean, min(lg) OVER w AS la, max(lg) OVER w AS lb FROM m2 WINDOW w AS (PARTITION BY query_id)),
m4 AS (SELECT query_id, pos, o, semantic_raw, lexical_raw, metadata_score, CASE WHEN b - a > 1e-3 THEN (semantic_raw - a) / (b - a + 1e-9) ELSE mean END AS semantic_score, CASE WHEN lb - la > 1e-3 THEN (lg - la) / (lb - la + 1e-9) ELSE lg END AS lexical_score FROM m3),
cand AS (SELECT *, round(0.55::DOUBLE * semantic_score + 0.25::DOUBLE * lexical_score + 0.20::DOUBLE * metadata_score, 9) AS hybrid_score FROM m4),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, o) AS rank FROM cand) WHERE rank <= 5)
"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


HYBRID = _with(CHUNKS, SEMANTIC, INDEX, LEXICAL, META, FUSION)

_CLASSIFY_TEXT = "CASE doc_id % 7 WHEN 0 THEN 'Содержание: ' || text WHEN 1 THEN 'Население' || chr(10) || 'POPULATION 2020' || chr(10) || text WHEN 2 THEN ' ' || chr(10) || ' ' WHEN 3 THEN 'Первый список ' || text ELSE text END"
_PATTERNS = " OR ".join(f"regexp_matches(substr(text, 1, 200), '(?i){p}')" for p in SKIP_PATTERNS)
_KEYWORDS = ", ".join(f"'{k}'" for k in SKIP_KEYWORDS)
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_TYPE = rf"""CASE WHEN page <= 5 THEN 'metadata' WHEN {_STRIP.format('text')} = '' THEN 'skip' WHEN {_PATTERNS} THEN 'metadata'
       WHEN len(list_intersect(list_slice(regexp_split_to_array(lower({_STRIP.format('text')}), '\s+'), 1, 5), [{_KEYWORDS}])) > 0 THEN 'metadata'
       WHEN len(ls) > 1 AND regexp_matches(ls[1], '[\x{{0400}}-\x{{04FF}}]') AND regexp_matches({_STRIP.format('ls[2]')}, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$') AND regexp_matches(ls[2], '[A-Z]')
            AND len(regexp_split_to_array({_STRIP.format('ls[2]')}, '\s+')) <= 5 THEN 'metadata' ELSE 'data' END"""
CLASSIFY = rf"""
t AS (SELECT doc_id, CAST(doc_id % 40 AS INTEGER) AS page, {_CLASSIFY_TEXT} AS text FROM documents),
l AS (SELECT *, string_split(substr(text, 1, 200), chr(10)) AS ls FROM t),
k AS (SELECT doc_id, page, {_TYPE} AS chunk_type FROM l)
"""

_TAGS = "concat_ws(', ', " + ", ".join(f"CASE WHEN {' OR '.join(f'contains(base, {chr(39)}{x}{chr(39)})' for x in CONTEXT_TAGS[t])} THEN '{t}' END" for t in sorted(CONTEXT_TAGS)) + ")"
POST = rf"""
p AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE substr(text, 1, 60) END AS ctx, geo, years, list_filter(list_transform(metrics, lambda x: lower(x)), lambda x: length(x) BETWEEN 1 AND 19) AS mt FROM c),
p1 AS (SELECT *, lower(ctx || ' ' || text) AS base FROM p),
p2 AS (SELECT *, {_TAGS} AS tags FROM p1),
p3 AS (SELECT *, CASE WHEN tags = '' THEN ctx WHEN ctx <> '' THEN ctx || ' | ' || tags ELSE tags END AS c1,
        concat_ws('; ', CASE WHEN len(mt) > 0 THEN '{METRICS_LABEL}' || array_to_string(mt, ', ') END, '{GEO_LABEL}' || array_to_string(geo, ', '), '{YEARS_LABEL}' || list_min(years) || '-' || list_max(years)) AS suffix FROM p2)
SELECT doc_id, substr({_STRIP.format("replace(CASE WHEN c1 <> '' THEN c1 || ' | ' || suffix ELSE suffix END, chr(10), ' ')")}, 1, 256) AS context, CASE WHEN len(mt) > 0 THEN array_to_string(mt, '|') END AS metrics FROM p3
"""

# Distances are over bytes, so the accented letters of the tables become capitals (words are lower-case).
_BYTES = "translate({0}, 'äçèéêíñóößü', 'ABCDEFGHIJK')"
SPELLING = f"""
w AS (SELECT word, count(*) AS freq, {_BYTES.format('word')} AS b FROM (SELECT unnest({_tokens('text')}) AS word FROM documents) GROUP BY word),
a AS (SELECT DISTINCT substr(t, 1, 1) || substr(t, 3) AS word FROM (SELECT unnest({_tokens('text')}) AS t FROM benchmark)),
lost AS (SELECT word, {_BYTES.format('word')} AS b FROM a WHERE word NOT IN (SELECT word FROM w)),
near AS (SELECT lost.word, w.word AS candidate, freq, damerau_levenshtein(lost.b, w.b) AS d FROM lost JOIN w ON abs(length(lost.b) - length(w.b)) <= 2 WHERE d <= 2),
fixed AS (SELECT word, arg_min(candidate, (d, -freq, candidate)) AS candidate FROM near GROUP BY word)
"""

# What the rule generator answers for a text of a data page, and what becomes of it.
_LETTERS = r"regexp_extract_all({0}, '\p{{L}}{{4,}}')"
_FIRST = "list_slice(list_transform(list_filter(list_zip({0}, range(len({0}))), lambda x: list_position({0}, x[1]) = x[2] + 1), lambda x: x[1]), 1, 5)"
_YEARS = r"list_sort(list_distinct(list_transform(regexp_extract_all({0}, '\b(?:19|20)\d\d\b'), lambda y: CAST(y AS INTEGER))))"
ENRICH = rf"""
t AS (SELECT doc_id, pos, id, CAST(page AS INTEGER) AS page, text FROM c),
l AS (SELECT *, string_split(substr(text, 1, 200), chr(10)) AS ls FROM t),
k AS (SELECT doc_id, pos, id, text, substr(text, 1, 800) AS body, {_TYPE} AS chunk_type FROM l),
e AS (SELECT *, {_LETTERS.format('body')} AS words, {_YEARS.format('body')} AS ys, {_STRIP.format('body')} AS s FROM k),
g AS (SELECT *, regexp_extract(s, '(?s)^(.*?[.!?])\s', 1) AS sentence FROM e),
p AS (SELECT doc_id, pos, id, chunk_type, text, CASE WHEN chunk_type = 'data' THEN substr(CASE WHEN sentence <> '' THEN sentence ELSE s END, 1, 256) WHEN coalesce(text, '') = '' THEN '{NO_TEXT}' ELSE substr(text, 1, 200) END AS ctx,
             CASE WHEN chunk_type = 'data' THEN list_filter(list_transform({_FIRST.format('words')}, lambda x: lower(x)), lambda x: length(x) < 20) END AS mt,
             CASE WHEN chunk_type = 'data' AND len(ys) > 0 THEN ys END AS years FROM g),
p1 AS (SELECT *, lower(ctx || ' ' || coalesce(text, '')) AS base FROM p),
p2 AS (SELECT *, {_TAGS} AS tags FROM p1),
p3 AS (SELECT *, CASE WHEN tags = '' THEN ctx ELSE ctx || ' | ' || tags END AS c1,
        concat_ws('; ', CASE WHEN len(mt) > 0 THEN '{METRICS_LABEL}' || array_to_string(mt, ', ') END,
                  CASE WHEN len(years) > 0 THEN '{YEARS_LABEL}' || CASE WHEN len(years) > 1 THEN list_min(years) || '-' || list_max(years) ELSE CAST(years[1] AS VARCHAR) END END) AS suffix FROM p2),
done AS (SELECT *, substr({_STRIP.format("replace(CASE WHEN suffix <> '' THEN c1 || ' | ' || suffix ELSE c1 END, chr(10), ' ')")}, 1, 256) AS context FROM p3)
"""

_CYRILLIC_TEXT = f"translate(text, '{LATIN}', '{AS_CYRILLIC}')"

ORACLES = {
    "page_chunks": rf"""
WITH fr AS (SELECT source, doc_id, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id END AS page, text FROM documents),
g AS (SELECT source, CAST(page AS INTEGER) AS page, {_STRIP.format("string_agg(text, chr(10) ORDER BY doc_id)")} AS text FROM fr GROUP BY source, page)
SELECT source, page, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars FROM g WHERE text <> ''""",
    "chunk_ids": _with(CHUNKS) + "SELECT doc_id, pos, CAST(page AS INTEGER) AS page, id, CAST(CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h END AS BIGINT) AS stable_id FROM (SELECT *, CAST('0x' || substr(md5(id), 1, 16) AS UBIGINT)::HUGEINT AS h FROM c)",
    "normalize_tokens": f"SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents",
    "normalize_chunk_ids": "SELECT doc_id, 'src ' || source || ' page ' || doc_id AS normal FROM documents",
    "chunk_classify": _with(CLASSIFY) + "SELECT doc_id, page, chunk_type FROM k",
    "chunk_class_counts": _with(CLASSIFY) + "SELECT chunk_type, count(*) AS n FROM k GROUP BY chunk_type",
    "context_post_process": "WITH " + CHUNKS.strip() + "," + POST,
    "validate_records": "SELECT doc_id, doc_id % 2 = 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS is_valid, CAST((doc_id % 2 = 1)::INT + (doc_id % 4 = 0)::INT + (doc_id % 5 = 0)::INT AS INTEGER) AS n_errors, CAST(1 + (doc_id % 300 > 256)::INT + (doc_id % 6 = 0)::INT AS INTEGER) AS n_warnings FROM documents",
    "validate_all": "SELECT bool_and(doc_id % 2 = 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0) AS all_valid, count(*) AS records FROM documents",
    "normalize_fields": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'молоко' ELSE 'молоко|рожь' END AS metrics, CASE doc_id % 5 WHEN 0 THEN '2021' WHEN 1 THEN '2020|2021' ELSE (2000 + doc_id % 20) || '|2021' END AS years, CAST(least(doc_id % 300, 256) AS INTEGER) AS context_chars FROM documents",
    "json_extract_props": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "json_balanced": "SELECT event_id, json_extract_string(props, '$.k') AS k, true AS query_answer_empty FROM events",
    "l2_normalize": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(list_dot_product(v, v) / list_dot_product(v, v), 6) AS norm2, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM v",
    "semantic_topk": _with(CHUNKS, SEMANTIC) + "SELECT query_id, CAST(rank AS INTEGER) AS rank, pos, round(score, 6) AS score FROM sem",
    "bm25_idf": _with(CHUNKS, INDEX) + "SELECT field, term, df, round(idf, 6) AS idf FROM idf",
    "bm25_corpus": _with(CHUNKS, INDEX) + "SELECT field, n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM idf WHERE idf.field = corpus.field) AS vocabulary FROM corpus",
    "bm25_topk": _with(CHUNKS, INDEX, LEXICAL) + "SELECT query_id, CAST(rank AS INTEGER) AS rank, pos, round(score, 6) AS score FROM lex",
    "metadata_scores": _with(CHUNKS, META) + "SELECT query_id, pos, round(geo, 6) AS geo, round(metrics, 6) AS metrics, round(years, 6) AS years, granularity, oked, round(total, 6) AS total FROM meta",
    "metadata_recall": _with(CHUNKS, META) + "SELECT query_id, CAST(rank AS INTEGER) AS rank, pos, round(total, 6) AS metadata_score FROM rec",
    "hybrid_candidates": HYBRID + "SELECT query_id, pos, o[1] AS origin, round(semantic_raw, 6) AS semantic_raw, round(lexical_raw, 6) AS lexical_raw, round(semantic_score, 6) AS semantic_score, round(lexical_score, 6) AS lexical_score, round(metadata_score, 6) AS metadata_score, round(hybrid_score, 6) AS hybrid_score FROM cand",
    "hybrid_topk": HYBRID + "SELECT query_id, CAST(rank AS INTEGER) AS rank, pos, round(hybrid_score, 6) AS hybrid_score FROM top",
    "hybrid_debug_counts": HYBRID
    + "SELECT q.query_id, (SELECT count(*) FROM sem WHERE sem.query_id = q.query_id) AS semantic_count, (SELECT count(*) FROM lex WHERE lex.query_id = q.query_id) AS lexical_count, count(cand.pos) AS merged_count, "
    "count(*) FILTER (o[1] = 1) AS lexical_added, count(*) FILTER (o[1] = 2) AS metadata_added, CASE WHEN any_value(len(q.metrics)) > 0 THEN count(cand.pos) ELSE 0 END AS metadata_seed_count, least(count(cand.pos), 5) AS returned "
    "FROM q LEFT JOIN cand USING (query_id) GROUP BY q.query_id",
    "search_summary": HYBRID + "SELECT query_id, CAST(rank AS INTEGER) AS rank, c.id, round(hybrid_score, 4) AS score, concat_ws('; ', 'geo: ' || array_to_string(c.geo, ', '), CASE WHEN len(c.metrics) > 0 THEN 'metrics: ' || array_to_string(c.metrics, ', ') END, 'years: ' || array_to_string(c.years, ', '), 'granularity: ' || c.tg, 'oked: ' || c.oked) AS metadata FROM top JOIN c USING (pos) WHERE rank <= 3",
    "upsert_by_source": "SELECT doc_id, source, CAST(length(text) AS INTEGER) AS n FROM documents WHERE source IS NULL OR source NOT IN ('src1', 'src2', 'src3') UNION ALL SELECT doc_id, source, CAST(length(text) + 1 AS INTEGER) FROM documents WHERE source IN ('src1', 'src3')",
    "store_integrity": _with(CHUNKS) + "SELECT count(*) AS chunks, count(v) AS vectors, count(*) FILTER (trim(coalesce(context, '')) = '' AND v IS NULL) AS blank, count(*) = count(v) + count(*) FILTER (trim(coalesce(context, '')) = '' AND v IS NULL) AS ok FROM c",
    "normalize_tokens_cyrillic": f"SELECT doc_id, array_to_string({_tokens(_CYRILLIC_TEXT, 'cyrillic')}, ' ') AS tokens FROM documents",
    "spell_correct": _with(SPELLING) + "SELECT a.word, coalesce(candidate, a.word) AS correction FROM a LEFT JOIN fixed USING (word)",
    "llm_enrich": _with(CHUNKS, ENRICH) + "SELECT doc_id, chunk_type, context, CASE WHEN len(mt) > 0 THEN array_to_string(mt, '|') END AS metrics, array_to_string(years, '|') AS years, CASE WHEN len(years) > 0 THEN 'year' END AS time_granularity FROM done",
    "llm_enrich_queries": f"SELECT item_id AS query_id, array_to_string({_FIRST.format(_LETTERS.format('text'))}, '|') AS metrics, CASE WHEN len({_YEARS.format('text')}) > 0 THEN 'year' END AS time_granularity FROM benchmark",
    "build_knowledge_base": _with(CHUNKS, ENRICH) + "SELECT pos, id, chunk_type, context, 1.0::DOUBLE AS norm2 FROM done",
}
