"""SQL twins of the queries in ``stored.py``."""

from __future__ import annotations

from .oracle import (
    BEST, CHAT, DEPS, DOC_FEATURES, EDITS, FEEDBACK, FILES, FILES_BEFORE, FINAL, LEVELS, MEMORY, ORACLE_SQL, PARSED, REQUEST_FEATURES, requests_cte, rnd, scored_cte, terms_of, WALK,
)

ORACLE_SQL["trace_log"] = f"""WITH {requests_cte()}, {FEEDBACK},
rows AS (SELECT 't-r' || event_id AS trace_id, 'r' || event_id AS request_id, 'route.decision' AS event_type, NULL AS query, NULL AS notes,
  CASE WHEN event_id % 9 = 0 THEN 'fallback-local: budget' ELSE 'confidence gate passed' END AS reason, (50 + event_id % 50) / 100e0 AS confidence,
  NULL AS verdict, NULL AS issues, NULL AS n_dependencies FROM events WHERE event_type IN ('purchase', 'signup')
 UNION ALL SELECT 'q-' || request_id, request_id, 'retrieval.assembly', substr(prompt, 1, 240), NULL, NULL, NULL, NULL, NULL, len({terms_of('prompt')}) FROM requests
 UNION ALL SELECT 'f-f' || seq, CASE WHEN seq % 2 = 1 THEN 'f' || seq ELSE 'feedback-only' END, 'cognitive.feedback', substr(text, 1, 240), substr(text, 1, 500), NULL, NULL,
  verdict, array_to_string(issues, '|'), NULL FROM feedback JOIN documents ON doc_id = seq)
SELECT trace_id, request_id, event_type, '2024-02-01 00:00:00' AS created_at, md5(coalesce(query, '')) AS query_hash, md5(coalesce(notes, '')) AS notes_hash,
  coalesce(reason, '') AS reason, coalesce(confidence, 0e0) AS confidence, coalesce(verdict, '') AS verdict, coalesce(issues, '') AS issues,
  CAST(coalesce(n_dependencies, 0) AS BIGINT) AS n_dependencies FROM rows"""

ORACLE_SQL["trace_tail"] = """SELECT event_id AS seq, event_type, props FROM (FROM events ORDER BY event_id DESC LIMIT 200) WHERE event_id % 7 <> 0"""

ORACLE_SQL["usage_latest"] = """SELECT 'prompt ' || event_id AS prompt, event_type AS domain, event_id % 12 AS selected_count, event_id % 3 = 0 AS xml_focus, event_id % 6 = 0 AS xml_selected,
  event_id % 40 AS n_dependencies, CASE WHEN event_id % 4 = 0 THEN 'stale context' ELSE '' END AS risks, event_id * 17 % 3000 AS dropped_count FROM events WHERE event_id % 3 > 0"""

ORACLE_SQL["workload"] = f"""WITH {CHAT}, s AS (SELECT *, regexp_replace(prompt, '^\\s+|\\s+$', '', 'g') AS body FROM chat)
SELECT CAST(2 AS BIGINT) AS index, CASE WHEN conv_id % 2 = 0 THEN 'team' ELSE 'standard' END AS workspace_id, project_id, CASE WHEN conv_id % 3 > 0 THEN user_id ELSE 'cognitive-usage' END AS user_id,
  CASE WHEN conv_id % 7 > 0 THEN 'code' ELSE 'general' END AS domain, md5(body) AS prompt_hash FROM s WHERE conv_id % 5 > 0 AND body <> ''"""

ORACLE_SQL["report_history"] = """SELECT * FROM (SELECT user_id, count(*) AS events, '2024-01-01' AS created_at FROM events GROUP BY user_id
  UNION ALL SELECT user_id, count(*), '2024-01-02' FROM events WHERE event_type = 'error' GROUP BY user_id) ORDER BY created_at DESC, user_id DESC LIMIT 100"""

ORACLE_SQL["memory_log"] = f"""WITH {MEMORY} SELECT id, user_id, CASE WHEN seq // 1000 % 2 = 0 THEN '01:00' ELSE '00:00' END AS stamped FROM memory WHERE project_id = 'p1'
ORDER BY stamped DESC, seq DESC LIMIT 1000"""

ORACLE_SQL["feedback_log"] = f"""WITH {FEEDBACK} SELECT 'f' || seq AS id, verdict, array_to_string(issues, '|') AS issues FROM feedback WHERE project_id = 'p1' ORDER BY seq DESC LIMIT 5000"""

ORACLE_SQL["stored_summaries"] = f"""WITH {FILES} SELECT path, hash,
  md5(CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 AND content <> '' THEN content ELSE '# doc_' || doc_id || chr(10) END) AS content_hash FROM files"""

_LINKS = """links AS (SELECT page_id, trim(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS source, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages)"""
ORACLE_SQL["stored_graph"] = f"""WITH {_LINKS}, e AS (SELECT source, CASE WHEN page_id % 2 = 0 THEN target ELSE trim(target) END AS target,
  CASE WHEN page_id % 2 = 0 THEN 'map' ELSE 'edge' END AS kind, CASE WHEN page_id % 2 = 0 THEN NULL WHEN page_id % 3 > 0 THEN 'links' ELSE 'related_to' END AS relation
  FROM links WHERE trim(target) <> '' AND (page_id % 2 = 0 OR source <> ''))
SELECT source, target, kind, relation, count(*) AS edges FROM e GROUP BY ALL"""

ORACLE_SQL["graph_node_ids"] = f"""WITH {_LINKS} SELECT DISTINCT source, CASE WHEN page_id % 2 = 0 THEN 'map' ELSE 'edge' END AS kind FROM links"""

ORACLE_SQL["partition_lookup"] = f"""WITH {MEMORY} SELECT scope AS workspace_id, project_id, id, CAST(CASE WHEN project_id = 'p1' THEN 2 ELSE 1 END AS BIGINT) AS version FROM memory
WHERE (scope = 'project' AND project_id = 'p1') OR (scope = 'episodic' AND project_id = 'p2')"""

ORACLE_SQL["knowledge_state"] = f"""WITH {FILES}, {FILES_BEFORE}
SELECT f.project, 'file:' || f.path AS node_id, CASE WHEN b.hash = f.hash THEN 'old/file:' || f.path ELSE 'file/file/' || f.path || '/README.md' END AS document_path,
  CAST(CASE WHEN b.hash IS NULL THEN 1 WHEN b.hash <> f.hash THEN b.doc_id % 5 + 2 ELSE b.doc_id % 5 + 1 END AS BIGINT) AS generation
FROM files f LEFT JOIN files_before b ON b.project = f.project AND b.path = f.path"""

ORACLE_SQL["tree_view"] = f"""WITH {FILES}, {FILES_BEFORE},
d AS (SELECT project, count(*) FILTER (f.hash IS DISTINCT FROM b.hash) AS stale
  FROM (SELECT project, path, hash FROM files) f FULL JOIN (SELECT project, path, hash FROM files_before) b USING (project, path) GROUP BY project),
n AS (SELECT project, CAST(0 AS BIGINT) AS level_rank, path AS source_path, 'file:' || path AS node_id FROM files UNION ALL SELECT DISTINCT project, 1, folder, 'folder:' || folder FROM files)
SELECT n.*, stale FROM n JOIN d USING (project)"""

ORACLE_SQL["embedding_texts"] = f"""WITH {FILES}, {DEPS} SELECT doc_id,
  md5('source=' || path || ';deps=' || array_to_string(dependencies[1:20], ', ') || ';content=' || trim(replace(substr(content, 1, 900), chr(10), ' '))) AS text_hash FROM corpus"""

_PROMPTS = """
a AS (SELECT 'b' || item_id AS request_id, item_id, text FROM benchmark UNION ALL SELECT 'p' || page_id, page_id, url || ' ' || html FROM pages),
p AS (SELECT request_id, ['remove', 'update', 'create new file', 'raise rate to 1.5 in', 'add +2 in'][item_id % 5 + 1]
  || ' ./app/main.py, src/a.lua and src/a.lua, docs/n' || item_id % 7 || '.md ' || text AS prompt FROM a)"""
ORACLE_SQL["edit_rates"] = rf"""WITH {_PROMPTS}, l AS (SELECT request_id, lower(prompt) AS low FROM p)
SELECT request_id, coalesce(nullif(regexp_extract(low, '(?:rate|taxa|parametro|par[âa]metro)\D{{0,20}}(?:para|to|=)\s*(\d+(?:\.\d+)?)', 1), ''),
  nullif(regexp_extract(low, '(?:para|to|=)\s*(\d+(?:\.\d+)?)', 1), ''), regexp_extract_all(low, '\d+(?:\.\d+)?')[-1]) AS rate FROM l"""
ORACLE_SQL["edit_priority"] = rf"""WITH {_PROMPTS},
t AS (SELECT *, list_filter(list_transform(regexp_extract_all(prompt, '([A-Za-z0-9_./\\-]+\.[A-Za-z0-9]{{1,10}})', 1), lambda x: trim(regexp_replace(replace(x, '\', '/'), '^(\./)+', ''), '/')), lambda x: x <> '') AS found FROM p),
u AS (SELECT request_id, contains(lower(prompt), 'update') AS applies, list_filter(found, lambda x, i: list_position(found, x) = i)[1:8] AS targets FROM t),
r AS (SELECT request_id, applies, unnest(targets) AS target, generate_subscripts(targets, 1) AS position FROM u),
s AS (SELECT *, CAST(CASE WHEN NOT applies THEN 0 WHEN ends_with(lower(target), '.lua') THEN 30 WHEN starts_with(lower(target), 'docs/') THEN 20 ELSE 0 END AS BIGINT) AS priority FROM r),
b AS (SELECT *, max(priority) OVER (PARTITION BY request_id) AS top, row_number() OVER (PARTITION BY request_id ORDER BY priority DESC, position) AS n FROM s)
SELECT request_id, target, CAST(position AS BIGINT) AS position, priority FROM b WHERE top = 0 OR n = 1"""

_START, _END = EDITS.index("outcome AS ("), EDITS.index("results AS (")
_PATTERN_EDITS = EDITS[:_START] + r"""outcome AS (SELECT *, CASE WHEN doc_id % 7 = 3 THEN content WHEN doc_id % 2 = 0 THEN regexp_replace(content, '(th)(e|at)', '\2-\1', 'g') ELSE body1 END AS body2 FROM patched),
""" + EDITS[_END:]
ORACLE_SQL["bulk_edit_patterns"] = f"""WITH {FILES}, {_PATTERN_EDITS}
SELECT step_id, split_part(o, '~', 1) AS status, split_part(o, '~', 2) AS message,
  CASE WHEN starts_with(o, 'applied') AND type = 'patch_file' THEN sha256(body2) WHEN starts_with(o, 'applied') AND type = 'create_file' THEN sha256('# Auto-generated' || chr(10) || '# Intent: tidy up' || chr(10)) END AS after_hash FROM results"""
ORACLE_SQL["stopped_plans"] = f"""WITH {FILES}, {_PATTERN_EDITS},
f AS (SELECT *, min(doc_id) FILTER (starts_with(o, 'failed~Execution failed')) OVER (PARTITION BY plan_id) AS first FROM results)
SELECT plan_id, step_id, CASE WHEN first IS NOT NULL AND starts_with(o, 'applied') THEN 'rolled_back' ELSE split_part(o, '~', 1) END AS status,
  CASE WHEN first IS NOT NULL AND starts_with(o, 'applied') THEN 'Rolled back due to execution failure in the plan.' ELSE split_part(o, '~', 2) END AS message
FROM f WHERE first IS NULL OR doc_id <= first"""

ORACLE_SQL["cache_fill"] = r"""WITH d AS (SELECT DISTINCT regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents)
SELECT sha256('hashing:' || body) AS cache_key, CAST(1 AS BIGINT) AS times, CAST(16 AS BIGINT) AS dims FROM d WHERE body <> ''"""

ORACLE_SQL["reflection_stream"] = """SELECT ['correct', 'partial', 'incorrect'][event_id % 3 + 1] AS verdict, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1"""

# A full rebuild of either listing; a node is one generation older if its hash differs from the earlier one.
_LINES = ORACLE_SQL["folder_documents"].split("f AS (", 1)[1]
ORACLE_SQL["incremental_state"] = f"""WITH {FILES}, {DEPS}, {PARSED},
earlier AS (SELECT * REPLACE (CASE WHEN doc_id % 17 = 3 THEN replace(path, '/doc_', '/old_') ELSE path END AS path,
  CASE WHEN doc_id % 11 = 5 THEN sha256(content || 'x') ELSE hash END AS hash) FROM parsed WHERE doc_id % 13 <> 7),
tree_before AS (WITH base AS (SELECT * FROM earlier), {LEVELS} SELECT project, node_id, source_hash FROM inner_nodes UNION ALL SELECT project, node_id, source_hash FROM leaf),
tree AS (WITH base AS (SELECT * FROM parsed), {LEVELS} SELECT level, project, node_id, parent_id, source_hash, confidence FROM inner_nodes
  UNION ALL SELECT 'file', project, node_id, parent_id, source_hash, confidence FROM leaf),
d AS (SELECT project, path, module, unnest(dependencies) AS dep FROM corpus),
links AS (SELECT project, 'map' AS kind, '' AS relation, path || '>' || dep AS id FROM d
  UNION ALL SELECT project, 'edge', 'related_to', 'file:' || path || '>module:' || module FROM corpus
  UNION ALL SELECT project, 'edge', CASE WHEN contains(lower(dep), 'event') OR contains(lower(dep), 'emit') THEN 'emits' ELSE 'uses' END, 'file:' || path || '>symbol:' || dep
    FROM d WHERE trim(dep) <> ''),
f AS ({_LINES.split("SELECT project, folder, CAST(0", 1)[0].strip().removesuffix(")")}),
lines AS (SELECT project, folder, CAST(0{_LINES.split("SELECT project, folder, CAST(0", 1)[1]})
SELECT t.level AS what, t.project, t.node_id AS id, concat_ws('~', coalesce(t.parent_id, ''), t.source_hash) AS value,
  CAST(CASE WHEN b.source_hash <> t.source_hash THEN 2 ELSE 1 END AS BIGINT) AS n, t.confidence
FROM tree t LEFT JOIN tree_before b ON b.project = t.project AND b.node_id = t.node_id
UNION ALL SELECT kind, project, id, relation, count(*), 0e0 FROM links GROUP BY project, kind, relation, id
UNION ALL SELECT 'line', project, folder || '~' || item, line, section, 0e0 FROM lines"""

ORACLE_SQL["cooldown_stream"] = ORACLE_SQL["cooldown_triggers"]

ORACLE_SQL["trace_fanout"] = """
SELECT 'verdict' AS what, ['correct', 'partial', 'incorrect'][event_id % 3 + 1] AS id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 2
UNION ALL SELECT 'project', 'p' || user_id % 5, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 2"""

_OWN = "rf JOIN df ON rf.workspace_id = ['mmo_workspace', 'unity_workspace', 'plain'][doc_id % 3 + 1] AND rf.project_id = 'p' || doc_id % 5"
ORACLE_SQL["context_pack_scoped"] = f"""WITH RECURSIVE {FILES}, {DEPS}, {requests_cte(True)}, {REQUEST_FEATURES}, {DOC_FEATURES}, {scored_cte(join=_OWN)}, {BEST}, {WALK}
SELECT request_id, position AS rank, source, CAST(length(content) AS BIGINT) AS chars, sha256(content) AS content_hash, selected_count, dropped_count, used_chars
FROM chosen JOIN packet USING (request_id)"""

# Latin-1 bytes are written out code point by code point.
ORACLE_SQL["corpus_scan"] = rf"""WITH {FILES},
k AS (SELECT project, path, language, module, folder, CASE WHEN doc_id % 5 = 1 THEN 'narrow' WHEN doc_id % 50 = 2 THEN 'padded' ELSE 'plain' END AS kind,
  CASE WHEN doc_id % 5 = 1 THEN regexp_replace(content, '[^\x{{00}}-\x{{ff}}]', 'é', 'g') WHEN doc_id % 50 = 2 THEN content || repeat(' ', 310000) ELSE content END AS body
  FROM files WHERE doc_id % 7 <> 3 AND doc_id % 11 <> 4),
b AS (SELECT *, CASE WHEN kind = 'narrow' THEN length(body) ELSE strlen(body) END AS size,
  CASE WHEN kind = 'narrow' THEN sha256(unhex(array_to_string(list_transform(string_split(body, ''), lambda c: printf('%02x', ord(c))), ''))) ELSE sha256(body) END AS raw_hash FROM k)
SELECT 'ingest' AS variant, project, path, raw_hash AS hash, size, language, module, folder, md5(body) AS content_hash FROM b WHERE size <= CASE WHEN language IN ('xml', 'lua') THEN 2000000 ELSE 300000 END
UNION ALL SELECT 'knowledge', project, path, sha256(body), size, language, module, folder, md5(body) FROM b WHERE size <= 300000"""

_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _share(hay: str) -> str:
    return f"CASE WHEN len(terms) = 0 THEN 0e0 ELSE len(list_filter(terms, lambda x: contains(lower({hay}), x))) / CAST(len(terms) AS DOUBLE) END"


_SHOWN = f"""SELECT request_id, source, freshness, {FINAL} AS final_score, freshness >= 75e-2 AS is_hot, {rnd('relevance', 6)} AS relevance, {rnd('confidence')} AS confidence,
  {rnd('importance')} AS importance, CAST(n_deps AS BIGINT) AS n_deps, length(body) AS size FROM c"""
ORACLE_SQL["memory_scores"] = f"""{ORACLE_SQL["memory_search"].rsplit("SELECT request_id, id, seq FROM j", 1)[0]},
t AS (SELECT request_id, {terms_of('prompt')} AS terms FROM chat),
d AS (SELECT request_id, 'memory:' || scope || ':' || id AS source, {_STRIP.format(c='content')} AS body, confidence, terms, scope,
  greatest(0e0, epoch(TIMESTAMP '2024-02-01 00:00:00') - (1704067200 + m.seq)) / 86400e0 AS age FROM j JOIN memory m USING (id) JOIN t USING (request_id) WHERE rn <= 8),
c AS (SELECT *, {_share('body')} AS relevance, 0e0 AS semantic, CASE WHEN age <= 1 THEN 1e0 WHEN age <= 7 THEN 85e-2 WHEN age <= 30 THEN 70e-2 WHEN age <= 90 THEN 55e-2 ELSE 40e-2 END AS freshness,
  CASE WHEN scope = 'project' THEN 65e-2 ELSE 55e-2 END AS importance, 0 AS n_deps FROM d)
{_SHOWN}"""
ORACLE_SQL["knowledge_scores"] = f"""{ORACLE_SQL["knowledge_search"].rsplit("SELECT request_id, node_id", 1)[0]},
t AS (SELECT request_id, {terms_of('prompt')} AS terms FROM requests),
d AS (SELECT r.request_id, 'knowledge:file:' || r.node_id AS source, {_STRIP.format(c='f.content')} AS body, f.doc_id % 50 / 50e0 AS confidence, len(f.dependencies) AS n_deps, t.terms,
  regexp_extract(f.path, '[^/]*$', 0) || ' ' || f.path || ' ' || array_to_string(f.dependencies, ' ') || ' async' AS described
  FROM r JOIN corpus f ON r.node_id = 'file:' || f.path JOIN t USING (request_id) WHERE rank <= 5),
c AS (SELECT *, greatest({_share('body')}, {_share('described')}) AS relevance, 0e0 AS semantic, 70e-2 AS freshness, least(1e0, 60e-2 + least(30e-2, n_deps * 3e-2)) AS importance FROM d WHERE body <> '')
{_SHOWN}"""
