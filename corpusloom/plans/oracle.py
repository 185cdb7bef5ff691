"""SQL twins of the registered queries, for DuckDB over the same parquet tables."""

from __future__ import annotations

from ..functions import rules

ORACLE_SQL: dict[str, str] = {}


def rnd(expr: str, digits: int = 4) -> str:
    """Round half up on the shortest decimal form of a double, as the engine does."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def any_of(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


def count_of(column: str, needles) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{n}') AS INT)" for n in needles) + ")"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


FILES = """
files AS (
  SELECT *, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS module,
         regexp_replace(path, '/[^/]*$', '') AS folder,
         CASE doc_id % 4 WHEN 0 THEN 'xml' WHEN 1 THEN 'lua' WHEN 2 THEN 'python' ELSE 'markdown' END AS language
  FROM (SELECT doc_id, lang AS project,
    CASE doc_id % 4 WHEN 0 THEN 'data/' || source || '/doc_' || doc_id || '.xml'
                    WHEN 1 THEN 'data/scripts/' || source || '/doc_' || doc_id || '.lua'
                    WHEN 2 THEN 'src/' || source || '/doc_' || doc_id || '.py'
                    ELSE 'docs/' || source || '/doc_' || doc_id || '.md' END AS path,
    text AS content, sha256(text) AS hash, n_chars AS size,
    TIMESTAMP '2024-02-01 00:00:00' - to_days(CAST(doc_id % 130 AS INTEGER)) AS modified_at
  FROM documents))"""

FILES_BEFORE = """
files_before AS (
  SELECT * REPLACE (CASE WHEN doc_id % 17 = 3 THEN replace(path, '/doc_', '/old_') ELSE path END AS path,
                    CASE WHEN doc_id % 11 = 5 THEN sha256(content || 'x') ELSE hash END AS hash)
  FROM files WHERE doc_id % 13 <> 7)"""

_MAIN = r"""list_filter(list_transform(
    regexp_extract_all(content, '(?m)^\s*import\s+([A-Za-z0-9_\.\{\}\*\s,]+)\s+from\s+[''"]([^''"]+)[''"]', 2)
 || regexp_extract_all(content, '(?m)^\s*import\s+([A-Za-z0-9_\.]+)', 1)
 || regexp_extract_all(content, '(?m)^\s*from\s+([A-Za-z0-9_\.]+)\s+import', 1)
 || regexp_extract_all(content, '(?m)^\s*using\s+([A-Za-z0-9_\.]+)', 1)
 || regexp_extract_all(content, 'require\([''"]([^''"]+)[''"]\)', 1), lambda d: trim(d)), lambda d: d <> '')"""

# Unicode word boundaries are written out, since \b is an ASCII boundary here.
_WORD = r"[^\p{L}\p{N}\p{M}_]"


def xml_marks(column: str) -> str:
    tags = (
        f"list_filter(list_transform(regexp_extract_all({column}, '<\\s*([A-Za-z_][A-Za-z0-9_:-]*)', 1), lambda t: lower(t)),"
        f" lambda t: t IN ({quoted(rules.XML_TAGS)}))"
    )
    names = "|".join(rules.XML_ATTRIBUTES)
    attributes = f"list_transform(regexp_extract_all({column}, '(?i)(?:^|{_WORD})({names})\\s*=', 1), lambda a: lower(a))"
    scripts = f"""list_transform(regexp_extract_all({column}, '(?i)(?:^|{_WORD})script\\s*=\\s*[''"]([^''"]+)[''"]', 1), lambda s: 'script:' || trim(s))"""
    return f"({tags} || list_transform({tags}, lambda t: 'xml-tag:' || t) || {attributes} || {scripts})"


def lua_marks(column: str) -> str:
    probes = " || ".join(
        f"CASE WHEN regexp_matches({column}, '{p.replace('(?U)', '').replace(chr(92) + 'b', '(?:^|' + _WORD + ')') if not p.endswith(chr(92) + 'b') else '(?:^|' + _WORD + ')onUse(?:$|' + _WORD + ')'}') THEN ['{label}'] ELSE [] END"
        for label, p in rules.LUA_PROBES
    )
    calls = (
        f"list_filter(regexp_extract_all({column}, '(?:^|{_WORD})(on[\\p{{L}}\\p{{N}}\\p{{M}}_]+)', 1),"
        f" lambda c: length(c) > 3 AND regexp_full_match(c, 'on[A-Za-z0-9_]+'))"
    )
    return f"({probes} || {calls})"


DEPS = f"""
marked AS (SELECT *, CASE language WHEN 'xml' THEN {xml_marks('content')} WHEN 'lua' THEN {lua_marks('content')} ELSE [] END AS text_marks,
  {_MAIN} AS imports FROM files),
placed AS (SELECT *,
  CASE WHEN language = 'xml' THEN ['classic-xml-bind', 'classic-' || split_part(path, '/', 2) || '-bind'] ELSE [] END
  || CASE WHEN language = 'lua' THEN ['runtime-script-file'] ELSE [] END
  || CASE WHEN language = 'lua' AND list_has_any(text_marks, [{quoted(rules.RUNTIME_REGISTER_MARKERS)}]) THEN ['runtime-script-register'] ELSE [] END
  || CASE WHEN len(list_filter(text_marks, lambda m: starts_with(m, 'script:'))) > 0 THEN ['xml-script-binding'] ELSE [] END
  || CASE WHEN language = 'lua' AND list_contains(text_marks, 'Action()') THEN ['revscripts-action'] ELSE [] END AS place_marks
  FROM marked),
corpus AS (SELECT * EXCLUDE (text_marks, imports, place_marks),
  list_sort(list_distinct(imports || text_marks || place_marks))[1:40] AS dependencies FROM placed)"""

_SYMBOLS = [p.replace("(?mdU)", "(?m)") for p in rules.SYMBOL_PATTERNS]
_TYPED = r"(?m)^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:[A-Za-z_][A-Za-z0-9_<>,\[\]]*\s+)+([A-Za-z_][A-Za-z0-9_]*)\s*\("
_KNOWLEDGE_SYMBOLS = _SYMBOLS[:4] + [_TYPED, _SYMBOLS[4]]


def first_seen(patterns, column: str = "content", k: int = 20) -> str:
    """Distinct matches in order of first appearance, first k."""
    found = " || ".join(f"regexp_extract_all({column}, '{p}', 1)" for p in patterns)
    ordered = f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"
    return f"({ordered})[1:{k}]"


LINES = r"""(CASE WHEN content = '' THEN 0 ELSE len(regexp_extract_all(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'))
  + CASE WHEN regexp_matches(content, '[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]\z') THEN 0 ELSE 1 END END)"""


def bullets(items: str) -> str:
    return f"CASE WHEN len({items}) = 0 THEN ['- none'] ELSE list_transform({items}, lambda b: '- ' || b) END"


ORACLE_SQL["corpus_scan_profile"] = f"""WITH {FILES}
SELECT project, language, module, folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS chars, min(hash) AS first_hash
FROM files GROUP BY ALL"""

_SUFFIX = r"lower(regexp_extract(path, '(?:^|/)[^/]+(\.[^./]+)$', 1))"
_NORM = "'/' || lower(trim(path, '/')) || '/'"

ORACLE_SQL["path_classes"] = f"""WITH {FILES},
listed AS (SELECT path FROM files UNION SELECT regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '^/', '') FROM pages),
n AS (SELECT path, {_NORM} AS norm, {_SUFFIX} AS suffix, lower(regexp_extract(trim(path, '/'), '(?:^|/)[^/]+(\\.[^./]+)$', 1)) AS ext FROM listed)
SELECT path, suffix, (starts_with(norm, '/app/') OR {any_of('norm', rules.NOISE_SEGMENTS)}) AS noise,
  (NOT (contains(norm, '/data/tools/') OR starts_with(norm, '/tools/') OR {any_of('norm', rules.LOW_SIGNAL_DIRS)}))
  AND (ext IN ({quoted(rules.DOMAIN_EXTENSIONS)}) OR ({any_of('norm', rules.CODE_DIRS)} AND ext = '' AND (starts_with(norm, '/src/') OR starts_with(norm, '/assets/')))) AS domain
FROM n"""

ORACLE_SQL["workspace_ids"] = r"""WITH r AS (SELECT ' ' || s_name || ' ' AS w, 'p' || s_nationkey AS p FROM supplier),
s AS (SELECT w, regexp_replace(lower(trim(w)), '[^\p{L}\p{N}_-]', '_', 'g') || '::' || p AS scoped FROM r)
SELECT w, scoped, split_part(scoped, '::', 1) AS workspace, split_part(scoped, '::', 2) AS project FROM s"""

ORACLE_SQL["project_profiles"] = """
SELECT lang AS project, CASE lang WHEN 'en' THEN 'unity' WHEN 'fr' THEN 'unreal' WHEN 'de' THEN 'node' ELSE 'python' END AS engine,
  CASE WHEN lang IN ('en', 'fr') THEN 'game' ELSE 'service' END AS project_type
FROM documents GROUP BY lang"""

ORACLE_SQL["file_markers"] = f"""WITH {FILES}, {DEPS}
SELECT dependency, count(*) AS files FROM (SELECT unnest(dependencies) AS dependency FROM corpus) GROUP BY dependency"""

ORACLE_SQL["page_xml_markers"] = f"""
SELECT DISTINCT page_id, unnest({xml_marks('html')}) AS marker FROM pages"""

_STEM = r"regexp_replace(regexp_extract(path, '[^/]*$', 0), '\.[^.]+$', '')"
_PURPOSE = f"""CASE
 WHEN language = 'lua' AND contains(low, 'action()') AND contains(low, ':register') THEN '{rules.PURPOSES['action_runtime']}'
 WHEN language = 'xml' AND contains(low, 'script') THEN 'Defines classic XML bindings for ' || split_part(path, '/', 2) || ' scripts and callback entrypoints.'
 WHEN language = 'lua' AND (contains(low, ':register') OR contains(low, 'register(')) THEN '{rules.PURPOSES['runtime_handlers']}'
 WHEN contains(low, 'inventory') THEN '{rules.PURPOSES['inventory']}'
 WHEN contains(low, 'router') OR contains(low, 'endpoint') THEN '{rules.PURPOSES['api']}'
 WHEN contains(low, 'repository') OR contains(low, 'sqlite') THEN '{rules.PURPOSES['storage']}'
 ELSE 'Implements the main responsibilities of ' || stem || '.' END"""

ORACLE_SQL["file_summaries"] = f"""WITH {FILES}, {DEPS},
s AS (SELECT *, lower(content) AS low, {_STEM} AS stem, {first_seen(_SYMBOLS)} AS symbols FROM corpus),
p AS (SELECT *, {_PURPOSE} AS purpose FROM s)
SELECT doc_id, purpose, CAST(len(symbols) AS BIGINT) AS symbols,
  sha256(array_to_string(['# ' || stem, '', 'Purpose:', purpose, '', 'Dependencies:'] || {bullets('dependencies')} || ['', 'Core Symbols:'] || {bullets('symbols[1:10]')}, chr(10)) || chr(10)) AS summary_hash
FROM p"""

_PATTERNS = "list_sort(" + " || ".join(
    f"CASE WHEN {any_of('low', keys)} THEN ['{label}'] ELSE [] END" for label, keys in rules.ARCHITECTURE_PATTERNS
) + ")"

PARSED = f"""
parsed0 AS (SELECT *, lower(content) AS low, {LINES} AS line_count, {first_seen(_KNOWLEDGE_SYMBOLS)} AS symbols,
  list_sort(list_distinct({_MAIN}))[1:30] AS dependencies FROM files),
parsed AS (SELECT *, {_PATTERNS} AS patterns,
  {rnd("least(96e-2, greatest(35e-2, 5e-1 + least(2e-1, len(symbols) * 2e-2) + least(12e-2, len(dependencies) * 2e-2) + CASE WHEN line_count > 20 THEN 6e-2 ELSE 0e0 END + CASE WHEN line_count > 120 THEN 4e-2 ELSE 0e0 END))", 2)} AS confidence,
  CASE WHEN debt >= 3 THEN 'high' WHEN debt >= 1 THEN 'medium' ELSE 'low' END AS risk_level
  FROM (SELECT *, CASE WHEN line_count > 500 THEN 2 WHEN line_count > 220 THEN 1 ELSE 0 END + {count_of('low', rules.DEBT_WORDS)} AS debt FROM parsed0))"""


def section(title: str, items: str) -> str:
    return f"CASE WHEN len({items}) = 0 THEN [] ELSE ['{title}'] || list_transform({items}, lambda b: '- ' || b) END"


ORACLE_SQL["file_confidence_risk"] = f"""WITH {FILES}, {PARSED}
SELECT doc_id, CAST(line_count AS BIGINT) AS line_count, array_to_string(symbols, '|') AS symbols, array_to_string(dependencies, '|') AS dependencies,
  array_to_string(patterns, '|') AS patterns, confidence, risk_level,
  sha256(array_to_string(['Responsibilities:', '- preserve source intent and API boundaries', '- expose coherent behavior for this unit']
   || {section('Core Symbols:', 'symbols[1:6]')} || {section('Dependencies:', 'dependencies[1:8]')} || {section('Detected Patterns:', 'patterns')}, chr(10))) AS summary_hash
FROM parsed"""

ORACLE_SQL["text_chunks"] = r"""WITH b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS chunk_no, md5(substr(body, n * 260 + 1, 260)) AS chunk_hash
FROM (SELECT *, unnest(range(CAST(ceil(length(body) / 260e0) AS BIGINT))) AS n FROM b WHERE body <> '')"""

ORACLE_SQL["folder_rollup"] = f"""WITH {FILES}, {DEPS}
SELECT project, folder, count(DISTINCT path) AS file_count,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(dependencies))))[1:20], '|'), '') AS dependencies
FROM corpus GROUP BY ALL"""

ORACLE_SQL["folder_documents"] = f"""WITH {FILES}, {DEPS},
f AS (SELECT project, folder, list_sort(list_distinct(flatten(list(dependencies))))[1:20] AS deps FROM corpus GROUP BY ALL)
SELECT project, folder, CAST(0 AS BIGINT) AS section, '' AS item, '# ' || folder AS line FROM f
UNION ALL SELECT project, folder, 1, '', '' FROM f
UNION ALL SELECT project, folder, 2, '', '## Files' FROM f
UNION ALL SELECT project, folder, 3, path, '- ' || path FROM corpus
UNION ALL SELECT project, folder, 4, '', '' FROM f
UNION ALL SELECT project, folder, 5, '', '## Dependencies' FROM f
UNION ALL SELECT project, folder, 6, d, '- ' || d FROM (SELECT project, folder, unnest(CASE WHEN len(deps) = 0 THEN ['none'] ELSE deps END) AS d FROM f)"""

ORACLE_SQL["project_rollup"] = f"""WITH {FILES}, {DEPS}
SELECT project, count(*) AS file_count, count(DISTINCT module) AS module_count,
  array_to_string(list_sort(list_distinct(flatten(list(dependencies))))[1:30], '|') AS dependencies
FROM corpus GROUP BY project"""

# Levels unrolled: the deepest folder has three parts.
_LEVELS = """
leaf AS (SELECT project, 'file:' || path AS node_id, 'folder:' || folder AS parent_id, hash AS source_hash, confidence, regexp_extract(path, '[^/]*$', 0) AS title FROM base),
chain AS (SELECT DISTINCT project, unnest([split_part(folder, '/', 1), array_to_string(string_split(folder, '/')[1:2], '/'), array_to_string(string_split(folder, '/')[1:3], '/')]) AS f FROM base),
f3 AS (SELECT c.project, 'folder:' || f AS node_id, 'folder:' || regexp_replace(f, '/[^/]*$', '') AS parent_id, {agg}, 'Folder ' || f AS title
  FROM chain c JOIN leaf k ON k.project = c.project AND k.parent_id = 'folder:' || f WHERE len(string_split(f, '/')) = 3 GROUP BY c.project, f),
k2 AS (SELECT * EXCLUDE (child_count) FROM f3 UNION ALL SELECT project, node_id, parent_id, source_hash, confidence, title FROM leaf),
f2 AS (SELECT c.project, 'folder:' || f AS node_id, 'folder:' || regexp_replace(f, '/[^/]*$', '') AS parent_id, {agg}, 'Folder ' || f AS title
  FROM chain c JOIN k2 k ON k.project = c.project AND k.parent_id = 'folder:' || f WHERE len(string_split(f, '/')) = 2 GROUP BY c.project, f),
f1 AS (SELECT c.project, 'folder:' || f AS node_id, 'module:' || f AS parent_id, {agg}, 'Folder ' || f AS title
  FROM chain c JOIN f2 k ON k.project = c.project AND k.parent_id = 'folder:' || f WHERE len(string_split(f, '/')) = 1 GROUP BY c.project, f),
m AS (SELECT k.project, k.parent_id AS node_id, 'project:' || k.project AS parent_id, {agg}, 'Module ' || replace(k.parent_id, 'module:', '') AS title FROM f1 k GROUP BY k.project, k.parent_id),
p AS (SELECT k.project, k.parent_id AS node_id, 'global:default' AS parent_id, {agg}, k.project || ' Knowledge' AS title FROM m k GROUP BY k.project, k.parent_id),
g AS (SELECT k.project, k.parent_id AS node_id, CAST(NULL AS VARCHAR) AS parent_id, {agg}, 'Global Project Memory' AS title FROM p k GROUP BY k.project, k.parent_id),
inner_nodes AS (SELECT 'folder' AS level, * FROM f3 UNION ALL SELECT 'folder', * FROM f2 UNION ALL SELECT 'folder', * FROM f1
  UNION ALL SELECT 'module', * FROM m UNION ALL SELECT 'project', * FROM p UNION ALL SELECT 'global', * FROM g)"""
_MERGE = (
    "sha256(string_agg(k.node_id || ':' || k.source_hash, '|' ORDER BY k.node_id)) AS source_hash, "
    + rnd("least(98e-2, greatest(4e-1, CAST(sum(CAST(k.confidence AS DECIMAL(20,4))) AS DOUBLE) / count(*)))", 2)
    + " AS confidence, count(*) AS child_count"
)
LEVELS = _LEVELS.replace("{agg}", _MERGE)
# UNION ALL by position: child_count sits before title in the inner levels.
LEVELS = LEVELS.replace(
    "k2 AS (SELECT * EXCLUDE (child_count) FROM f3", "k2 AS (SELECT project, node_id, parent_id, source_hash, confidence, title FROM f3"
)

ORACLE_SQL["merkle_hashes"] = f"""WITH {FILES}, base AS (SELECT *, 6e-1 AS confidence FROM files), {LEVELS}
SELECT project, node_id, level, parent_id, source_hash FROM inner_nodes"""

ORACLE_SQL["hierarchy_rollup"] = f"""WITH {FILES}, {PARSED}, base AS (SELECT * FROM parsed), {LEVELS},
up AS (SELECT b.*, unnest(['folder:' || split_part(folder, '/', 1), 'folder:' || array_to_string(string_split(folder, '/')[1:2], '/'), 'folder:' || array_to_string(string_split(folder, '/')[1:3], '/'), 'module:' || module, 'project:' || project, 'global:default']) AS node_id FROM base b),
roll AS (SELECT project, node_id, count(DISTINCT path) AS file_count, list_sort(list_distinct(flatten(list(patterns)))) AS patterns,
  list_sort(list_distinct(flatten(list(dependencies))))[1:10] AS deps FROM up GROUP BY ALL),
kids AS (SELECT project, parent_id AS node_id, list(title ORDER BY node_id)[1:8] AS titles
  FROM (SELECT project, parent_id, node_id, title FROM leaf UNION ALL SELECT project, parent_id, node_id, title FROM inner_nodes) GROUP BY ALL)
SELECT i.project, i.node_id, level, confidence, CASE WHEN file_count >= 25 THEN 'high' WHEN file_count >= 8 THEN 'medium' ELSE 'low' END AS risk_level,
  CAST(child_count AS BIGINT) AS child_count, CAST(file_count AS BIGINT) AS file_count, array_to_string(patterns, '|') AS patterns, source_hash,
  sha256(array_to_string(['Aggregated ' || level || ' knowledge.', 'Child nodes: ' || child_count] || {section('Core Components:', 'titles')}
    || {section('Dependencies:', 'deps')} || {section('Architecture Patterns:', 'patterns')}, chr(10))) AS summary_hash
FROM inner_nodes i JOIN roll USING (project, node_id) JOIN kids USING (project, node_id)"""

ORACLE_SQL["coverage_gaps"] = f"""WITH {FILES},
e AS (SELECT project, unnest(['.xml', '.lua', '.py', '.md', '.ts', '.shader']) AS extension FROM (SELECT DISTINCT project FROM files)),
h AS (SELECT project, (max(CAST(contains(lower(path), 'scripts') AS INT)) + max(CAST(contains(lower(path), 'src1/') AS INT))
  + max(CAST(contains(lower(path), 'doc_7') AS INT)) + max(CAST(contains(lower(path), 'absent') AS INT))) / 4e0 AS r FROM files GROUP BY project)
SELECT e.project, extension, round(r, 4) AS hit_ratio FROM e JOIN h USING (project)
WHERE (e.project, extension) NOT IN (SELECT DISTINCT project, {_SUFFIX} FROM files)"""

CHANGES = f"""
changes AS (SELECT project, path, f.hash AS current_hash, b.hash AS previous_hash,
  CASE WHEN b.hash IS NULL THEN 'created' WHEN f.hash IS NULL THEN 'deleted' WHEN f.hash <> b.hash THEN 'modified' END AS event_type
  FROM (SELECT project, path, hash FROM files) f FULL JOIN (SELECT project, path, hash FROM files_before) b USING (project, path)),
numbered AS (SELECT *, coalesce(current_hash, previous_hash) AS hash,
  row_number() OVER (PARTITION BY project, event_type, coalesce(current_hash, previous_hash) ORDER BY path) AS rn
  FROM changes WHERE event_type IN ('created', 'deleted')),
renames AS (SELECT c.project, c.path, d.path AS previous_path, c.hash FROM numbered c JOIN numbered d
  ON c.project = d.project AND c.hash = d.hash AND c.rn = d.rn AND c.event_type = 'created' AND d.event_type = 'deleted'),
events_out AS (
  SELECT project, path, 'renamed' AS event_type, previous_path, hash AS previous_hash, hash AS current_hash FROM renames
  UNION ALL SELECT project, path, event_type, NULL, previous_hash, current_hash FROM changes c
  WHERE event_type IS NOT NULL
    AND NOT (event_type = 'created' AND EXISTS (SELECT 1 FROM renames r WHERE r.project = c.project AND r.path = c.path))
    AND NOT (event_type = 'deleted' AND EXISTS (SELECT 1 FROM renames r WHERE r.project = c.project AND r.previous_path = c.path)))"""

ORACLE_SQL["snapshot_changes"] = f"""WITH {FILES}, {FILES_BEFORE}, {CHANGES}
SELECT project, path, event_type, previous_path, previous_hash, current_hash FROM events_out"""

_COARSE = FILES.replace("sha256(text) AS hash", "md5(CAST(length(text) AS VARCHAR)) AS hash")
_COARSE_BEFORE = FILES_BEFORE.replace("sha256(content || 'x')", "hash")
ORACLE_SQL["rename_pairs"] = f"""WITH {_COARSE}, {_COARSE_BEFORE}, {CHANGES}
SELECT project, hash, path, previous_path FROM renames"""

ORACLE_SQL["change_report"] = f"""WITH {FILES}, {FILES_BEFORE}, {CHANGES}
SELECT project, count(*) FILTER (event_type = 'created') AS created, count(*) FILTER (event_type = 'modified') AS modified,
  count(*) FILTER (event_type = 'deleted') AS deleted, count(*) FILTER (event_type = 'renamed') AS renamed, count(*) AS changes_detected
FROM events_out GROUP BY project"""

ORACLE_SQL["removed_files"] = f"""WITH {FILES}, {FILES_BEFORE}
SELECT project, path, hash FROM files_before b WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.project = b.project AND f.path = b.path)"""

ORACLE_SQL["impacted_folders"] = f"""WITH {FILES}, {FILES_BEFORE}, {CHANGES}
SELECT DISTINCT project, regexp_replace(path, '/[^/]*$', '') AS folder FROM (SELECT project, path FROM events_out UNION ALL SELECT project, previous_path FROM events_out WHERE previous_path IS NOT NULL)"""

ORACLE_SQL["ingestion_reports"] = f"""WITH {FILES}, {FILES_BEFORE},
j AS (SELECT project, regexp_replace(path, '/[^/]*$', '') AS folder, f.hash AS h, b.hash AS bh,
  (f.hash IS NOT NULL AND (b.hash IS NULL OR f.hash <> b.hash)) AS changed, f.hash IS NULL AS removed
  FROM (SELECT project, path, hash FROM files) f FULL JOIN (SELECT project, path, hash FROM files_before) b USING (project, path))
SELECT project, count(h) AS scanned_files, count(*) FILTER (changed) AS changed_files, count(*) FILTER (removed) AS removed_files,
  count(*) FILTER (changed) AS generated_file_summaries,
  count(DISTINCT folder) FILTER ((changed OR removed) AND folder IN (SELECT x.folder FROM files x WHERE x.project = j.project)) AS generated_folder_summaries
FROM j GROUP BY project"""

_ALL_NODES = f"""
inner_now AS (WITH base AS (SELECT *, 6e-1 AS confidence FROM files), {LEVELS} SELECT project, node_id, source_hash FROM inner_nodes),
inner_before AS (WITH base AS (SELECT *, 6e-1 AS confidence FROM files_before), {LEVELS} SELECT project, node_id, source_hash FROM inner_nodes),
n AS (SELECT project, 'file:' || path AS node_id, hash AS source_hash FROM files UNION ALL SELECT * FROM inner_now),
o AS (SELECT project, 'file:' || path AS node_id, hash AS source_hash, doc_id % 5 + 1 AS generation FROM files_before
  UNION ALL SELECT *, length(node_id) % 5 + 1 FROM inner_before)"""

ORACLE_SQL["generation_bumps"] = f"""WITH {FILES}, {FILES_BEFORE}, {_ALL_NODES}
SELECT n.project, n.node_id, (o.source_hash IS NULL OR o.source_hash <> n.source_hash) AS changed,
  CAST(CASE WHEN o.source_hash IS NULL THEN 1 WHEN o.source_hash <> n.source_hash THEN o.generation + 1 ELSE o.generation END AS BIGINT) AS generation
FROM n LEFT JOIN o ON o.project = n.project AND o.node_id = n.node_id"""

ORACLE_SQL["knowledge_drift"] = f"""WITH {FILES}, {FILES_BEFORE}, {_ALL_NODES}
SELECT project, count(*) FILTER (n.source_hash IS DISTINCT FROM o.source_hash) AS drift FROM n FULL JOIN o USING (project, node_id) GROUP BY project"""

ORACLE_SQL["page_xml_markers"] = f"""WITH m AS (SELECT page_id, replace(html, '<a href=', '<Action ItemId="1" script=') AS markup FROM pages)
SELECT DISTINCT page_id, unnest({xml_marks('markup')}) AS marker FROM m"""

# --- requests ----------------------------------------------------------------------------------

_SUFFIXES = (
    "", " actions.xml register opcode", " shader material loot drop", " npc spell quest tools",
    " how does doc_4.xml bind the script at startup", " refactor the security architecture",
)


def requests_cte(plain: bool = False) -> str:
    prompt = "text" if plain else f"text || [{quoted(_SUFFIXES)}][item_id % {len(_SUFFIXES)} + 1]"
    return f"""
requests AS (SELECT CAST(item_id AS VARCHAR) AS request_id, ['mmo_workspace', 'unity_workspace', 'plain'][item_id % 3 + 1] AS workspace_id,
  'p' || item_id % 5 AS project_id, 'u' || item_id % 7 AS user_id, {prompt} AS prompt FROM benchmark)"""


def terms_of(prompt: str) -> str:
    return f"""list_distinct(list_filter(regexp_extract_all(lower({prompt}), '[a-z0-9_]+(?:-[a-z0-9_]+)*')
  || string_split_regex(regexp_replace(lower({prompt}), '[^\\p{{L}}\\p{{N}}_\\- ]', '', 'g'), ' +'), lambda t: length(t) >= 2))"""


CHAT = """
chat AS (SELECT conv_id || '-' || turn AS request_id, conv_id, turn, 'p' || conv_id % 5 AS project_id, 'u' || conv_id % 7 AS user_id, text AS prompt
  FROM conversations WHERE role = 'user')"""

ORACLE_SQL["prompt_terms"] = f"""WITH {requests_cte()}, {CHAT},
a AS (SELECT request_id, prompt FROM requests UNION ALL SELECT 'c' || request_id, prompt FROM chat)
SELECT request_id, unnest({terms_of('prompt')}) AS term FROM a"""

_L = "lower(prompt)"
_XML_FOCUS = f"(contains({_L}, '.xml') OR contains({_L}, ' xml') OR starts_with({_L}, 'xml'))"
_LOOT_FOCUS = f"(contains({_L}, 'items.xml') OR {any_of(_L, rules.LOOT_TERMS)} OR ({any_of(_L, rules.LOOT_ITEM_WORDS)} AND {any_of(_L, rules.LOOT_DROP_WORDS)}))"
_XML_TERMS = f"list_distinct(list_filter(regexp_extract_all({_L}, '([a-z0-9_\\-]+)\\.xml', 1), lambda x: length(x) >= 2))"
_INTENT = "CASE " + " ".join(f"WHEN {any_of(_L, w)} THEN '{n}'" for n, w in rules.INTENTS) + " ELSE 'general-query' END"
_ACTIVE = {
    "unity_profile": "contains(workspace_id, 'unity')",
    "mmo_profile": "(contains(workspace_id, 'mmo') AND NOT contains(workspace_id, 'unity'))",
    "networking_profile": any_of(_L, rules.NETWORK_WORDS),
    "lua_profile": any_of(_L, rules.LUA_WORDS),
    "shader_profile": any_of(_L, rules.SHADER_WORDS),
    "xml_profile": _XML_FOCUS,
}


def boost(i: int) -> str:
    return "(0e0 + " + " + ".join(f"CASE WHEN {_ACTIVE[p[0]]} THEN {p[i]}e0 ELSE 0e0 END" for p in rules.PROFILES) + ")"


_BOOSTS = {name: boost(i) for i, name in enumerate(rules.PROFILE_COLUMNS) if i}
_PROFILE = "coalesce(nullif(array_to_string(" + " || ".join(
    f"CASE WHEN {_ACTIVE[p[0]]} THEN ['{p[0]}'] ELSE [] END" for p in rules.PROFILES
) + ", '+'), ''), 'default')"

ORACLE_SQL["prompt_profiles"] = f"""WITH {requests_cte()}
SELECT request_id, {_INTENT} AS intent, {_XML_FOCUS} AS xml_focus, {_LOOT_FOCUS} AS loot_focus, coalesce(array_to_string(list_sort({_XML_TERMS}), '|'), '') AS xml_terms,
  {_PROFILE} AS profile_name, {', '.join(f'{rnd(sql)} AS {name}_boost' for name, sql in _BOOSTS.items())} FROM requests"""

ORACLE_SQL["lexical_topk"] = f"""WITH {requests_cte(True)}, t AS (SELECT request_id, {terms_of('prompt')} AS terms FROM requests),
p AS (SELECT request_id, doc_id, len(list_filter(terms, lambda x: contains(lower(text), x))) AS hits, len(terms) AS n FROM t, documents),
r AS (SELECT request_id, doc_id, hits, hits / CAST(n AS DOUBLE) AS relevance, row_number() OVER (PARTITION BY request_id ORDER BY hits / CAST(n AS DOUBLE) DESC, doc_id) AS rank
  FROM p WHERE hits / CAST(n AS DOUBLE) > 5e-2)
SELECT request_id, doc_id, CAST(hits AS BIGINT) AS hits, {rnd('relevance', 6)} AS relevance, rank FROM r WHERE rank <= 10"""

_ACTION_WORDS = rules.ACTION_XML_TERMS + rules.ACTION_RUNTIME_TERMS + rules.ACTION_BIND_TERMS
_P = {
    "no_tooling": f"NOT {any_of(_L, rules.TOOLING_TERMS)}",
    "architecture": any_of(_L, rules.ARCHITECTURE_TERMS + rules.CLASSIC_SCRIPT_TERMS + rules.RUNTIME_SCRIPT_TERMS),
    "classic": any_of(_L, rules.CLASSIC_SCRIPT_TERMS),
    "runtime": any_of(_L, rules.RUNTIME_SCRIPT_TERMS),
    "action": any_of(_L, _ACTION_WORDS),
    "action_runtime": any_of(_L, rules.ACTION_RUNTIME_TERMS),
    "xml": any_of(_L, ("xml",) + rules.ACTION_XML_TERMS + rules.CLASSIC_SCRIPT_TERMS),
    "npc": f"contains({_L}, 'npc')", "spell": f"contains({_L}, 'spell')", "quest": f"contains({_L}, 'quest')",
    "loot": _LOOT_FOCUS,
}
_D = {
    "in_src": "contains(norm, '/src/')", "in_app": "contains(norm, '/app/')", "in_assets": "contains(norm, '/assets/')",
    "in_scripts": "contains(norm, '/scripts/')", "in_data_scripts": "contains(norm, '/data/scripts/')",
    "in_binding_dir": any_of("norm", rules.BINDING_DIRS),
    "main_code_ext": "ext IN ('.cs', '.cpp', '.h', '.hpp', '.lua', '.ts', '.tsx', '.js', '.py')",
    "in_low_signal": any_of("norm", rules.LOW_SIGNAL_DIRS),
    "in_tools": "(contains(norm, '/data/tools/') OR starts_with(norm, '/tools/'))",
    "core_source": any_of("norm", rules.CORE_SOURCE_HINTS),
    "in_scripts_or_assets": "(contains(norm, '/scripts/') OR contains(norm, '/assets/'))",
    "xml_ext": "ext = '.xml'", "xml_file": "ends_with(norm, '.xml/')",
    "scripts_code": "(contains(norm, '/scripts/') AND ext IN ('.lua', '.cs', '.ts', '.tsx', '.js', '.py'))",
    "actions_xml": "contains(norm, '/data/actions/actions.xml/')", "in_action_scripts": "contains(norm, '/data/actions/scripts/')",
    "src_actions": "contains(norm, '/src/actions')", "src_luascript": "contains(norm, '/src/luascript')",
    "src_baseevents": "contains(norm, '/src/baseevents')", "src_scriptmanager": "contains(norm, '/src/scriptmanager')",
    "src_script": "contains(norm, '/src/script')",
    "npc_path": any_of("norm", ("/data/scripts/", "/src/npc")), "spell_path": any_of("norm", ("/data/spells/", "/src/spells")),
    "quest_path": "contains(norm, '/src/quests')", "items_xml": "ends_with(norm, '/data/items/items.xml/')",
    "other_items_xml": "(NOT ends_with(norm, '/data/items/items.xml/') AND contains(norm, '/data/items/') AND ext = '.xml')",
    "monster_xml": f"({any_of('norm', ('/data/monster/', '/data/monsters/'))} AND ext = '.xml')",
    "in_loot": "contains(norm, '/loot/')", "loot_script": f"(contains(norm, '/data/scripts/') AND {any_of('norm', ('loot', 'drop'))})",
    "shader_ext": "ext IN ('.shader', '.shadergraph', '.shadersubgraph', '.hlsl')",
    "network_path": any_of("norm", ("/network", "protocol", "opcode", "packet")),
}
_BOOST_PATHS = {"xml": "xml_ext", "scripts": "in_scripts", "assets": "in_assets", "src": "in_src", "shader": "shader_ext", "networking": "network_path"}


def bonus_sql() -> str:
    parts = []
    for prompt_feature, path_feature, weight in rules.PATH_BONUS:
        cond = "d_xml_file AND len(list_filter(xml_terms, lambda x: contains(norm, '/' || x || '.xml/'))) > 0" if path_feature == "named_xml" else f"d_{path_feature}"
        if prompt_feature:
            cond = f"p_{prompt_feature} AND {cond}"
        parts.append(f"CASE WHEN {cond} THEN {weight}e0 ELSE 0e0 END")
    parts += [f"CASE WHEN d_{feature} THEN {name}_boost ELSE 0e0 END" for name, feature in _BOOST_PATHS.items()]
    return "(0e0 + " + " + ".join(parts) + ")"


REQUEST_FEATURES = f"""
rf AS (SELECT *, {terms_of('prompt')} AS terms, {_XML_TERMS} AS xml_terms, {_XML_FOCUS} AS xml_focus, {_LOOT_FOCUS} AS loot_focus,
  {', '.join(f'({sql}) AS p_{name}' for name, sql in _P.items())}, {', '.join(f'{sql} AS {name}_boost' for name, sql in _BOOSTS.items())} FROM requests)"""

AGE = "date_diff('microsecond', modified_at, TIMESTAMP '2024-02-01 00:00:00') / 86400e6"
DOC_FEATURES = f"""
dn AS (SELECT *, {_NORM} AS norm, {_SUFFIX} AS ext, {first_seen(_SYMBOLS)} AS symbols FROM corpus),
df AS (SELECT *, lower(path || ' ' || content || ' ' || array_to_string(symbols, ' ') || ' ' || array_to_string(dependencies, ' ')) AS hay,
  'artifact:file:' || path AS source, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS body, len(dependencies) AS n_deps,
  CASE WHEN {AGE} <= 1 THEN 1e0 WHEN {AGE} <= 7 THEN 85e-2 WHEN {AGE} <= 30 THEN 70e-2 WHEN {AGE} <= 90 THEN 55e-2 ELSE 40e-2 END AS freshness,
  {', '.join(f'({sql}) AS d_{name}' for name, sql in _D.items())} FROM dn)"""

FINAL = rnd("(CASE WHEN semantic > 0 THEN " + rnd("relevance * 45e-2 + semantic * 55e-2") + " ELSE relevance END) * 5e-1 + freshness * 15e-2 + confidence * 2e-1 + importance * 15e-2")
FLAGS = """(CASE WHEN ends_with(lower(source), '.xml') THEN 1 ELSE 0 END
  + CASE WHEN ends_with(lower(source), '.xml') AND len(list_filter(xml_terms, lambda x: contains(lower(source), '/' || x || '.xml'))) > 0 THEN 2 ELSE 0 END)"""


def scored_cte(source: str = "df", join: str = "rf, df") -> str:
    return f"""
pairs AS (SELECT * FROM (SELECT *, len(list_filter(terms, lambda x: contains(hay, x))) / CAST(len(terms) AS DOUBLE) AS relevance FROM {join}) WHERE relevance > 5e-2),
imp AS (SELECT *, greatest(5e-2, least(1e0, 5e-1 + least(45e-2, n_deps * 4e-2) + {bonus_sql()})) AS importance, 78e-2 AS confidence, 0e0 AS semantic FROM pairs),
scored AS (SELECT request_id, source, path, body, relevance, semantic, freshness, confidence, importance, n_deps, {FLAGS} AS flags, freshness >= 75e-2 AS is_hot, {FINAL} AS final_score FROM imp)"""


def retrieval_ctes(plain: bool) -> str:
    return f"{FILES}, {DEPS}, {requests_cte(plain)}, {REQUEST_FEATURES}, {DOC_FEATURES}, {scored_cte()}"


_RANK = "ORDER BY final_score DESC, is_hot DESC, n_deps DESC, source"
ORACLE_SQL["candidate_ranking"] = f"""WITH {retrieval_ctes(False)},
r AS (SELECT *, row_number() OVER (PARTITION BY request_id {_RANK}) AS rank FROM scored)
SELECT request_id, source, {rnd('relevance', 6)} AS relevance, freshness, {rnd('importance')} AS importance, final_score, is_hot,
  CAST(n_deps AS BIGINT) AS n_deps, CAST(flags AS BIGINT) AS flags, rank FROM r WHERE rank <= 20"""

BEST = """
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, substr(trim(regexp_replace(lower(body), '\\s+', ' ', 'g')), 1, 420)
  ORDER BY final_score DESC, source) AS dup FROM scored) WHERE dup = 1)"""

ORACLE_SQL["candidate_dedup"] = f"""WITH {retrieval_ctes(False)}, {BEST}
SELECT request_id, count(*) AS candidates, {rnd('CAST(sum(CAST(final_score AS DECIMAL(10,4))) AS DOUBLE)')} AS score_sum, min(source) AS first_source FROM best GROUP BY request_id"""

# The budget walk over chosen items only: from (rank, used) the next is the first later candidate that fits, or the very next while 260 or more
# remain.  Plain prompts ask for no XML or loot and every one matches, so no item is forced in and no fallback is due.
WALK = f"""
ranked AS MATERIALIZED (SELECT request_id, source, substr(body, 1, 3500) AS head, length(body) AS size, final_score, freshness, confidence, is_hot,
  row_number() OVER (PARTITION BY request_id {_RANK}) AS rank FROM best),
walk AS (SELECT request_id, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, '' AS content, CAST(0 AS BIGINT) AS position FROM requests
  UNION ALL SELECT request_id, rank, CAST(used + length(content) AS BIGINT), content, position FROM (
    SELECT request_id, rank, used, position, CASE WHEN size <= 3500 - used THEN head
      ELSE regexp_replace(substr(head, 1, greatest(260, 3496 - used)), '\\s+$', '') || chr(10) || '...' END AS content
    FROM (SELECT w.request_id, min(r.rank) AS rank, any_value(w.used) AS used, any_value(w.position) + 1 AS position, arg_min(r.head, r.rank) AS head, arg_min(r.size, r.rank) AS size
      FROM walk w JOIN ranked r ON r.request_id = w.request_id AND r.rank > w.rank AND w.used < 3500 AND (r.size <= 3500 - w.used OR 3500 - w.used >= 260) GROUP BY w.request_id))),
chosen AS (SELECT w.request_id, w.position, source, w.content, final_score, freshness, confidence, is_hot FROM walk w JOIN ranked r USING (request_id, rank) WHERE w.position > 0),
packet AS (SELECT q.request_id, count(c.source) AS selected_count, (SELECT count(*) FROM ranked r WHERE r.request_id = q.request_id) - count(c.source) AS dropped_count,
  CAST(coalesce(sum(length(c.content)), 0) AS BIGINT) AS used_chars, count(*) FILTER (c.freshness < 40e-2) AS stale, count(*) FILTER (c.confidence < 50e-2) AS unsure,
  count(*) FILTER (c.is_hot) AS hot_context_count, count(*) FILTER (starts_with(c.source, 'artifact:file:')) AS artifacts,
  CASE WHEN count(c.source) > 0 THEN {rnd('CAST(sum(CAST(c.final_score AS DECIMAL(10,4))) AS DOUBLE) / count(c.source)')} ELSE 0e0 END AS avg_context_score
  FROM requests q LEFT JOIN chosen c USING (request_id) GROUP BY q.request_id)"""
ORACLE_SQL["context_pack"] = f"""WITH RECURSIVE {retrieval_ctes(True)}, {BEST}, {WALK}
SELECT request_id, position AS rank, source, CAST(length(content) AS BIGINT) AS chars, sha256(content) AS content_hash, selected_count, dropped_count, used_chars
FROM chosen JOIN packet USING (request_id)"""

ORACLE_SQL["risk_counts"] = f"""WITH RECURSIVE {retrieval_ctes(True)}, {BEST}, {WALK},
n AS (SELECT *, CASE WHEN selected_count = 0 THEN ['No relevant context selected; fallback to model-only reasoning may reduce quality.'] ELSE [] END
  || CASE WHEN stale > 0 THEN [stale || ' selected contexts may be stale (low freshness score).'] ELSE [] END
  || CASE WHEN dropped_count > 0 THEN ['Token budget dropped ' || dropped_count || ' context candidates.'] ELSE [] END
  || CASE WHEN unsure > 0 THEN [unsure || ' selected contexts have low confidence score.'] ELSE [] END AS notes FROM packet),
w AS (SELECT *, CASE WHEN selected_count < 2 THEN ['low_selected_context'] ELSE [] END || CASE WHEN artifacts = 0 AND selected_count <= 2 THEN ['no_artifact_sources'] ELSE [] END
  || CASE WHEN selected_count = 0 THEN ['no_relevant_context'] ELSE [] END || CASE WHEN stale > 0 THEN ['stale_context_signal'] ELSE [] END
  || CASE WHEN dropped_count >= 10 AND selected_count <= 1 THEN ['high_drop_low_selection'] ELSE [] END AS codes FROM n)
SELECT request_id, array_to_string(notes, '; ') AS risks, array_to_string(codes, '|') AS reasons, len(codes) > 0 AS weak, avg_context_score, hot_context_count FROM w"""

_NOISY = " OR ".join(f"starts_with(low, '{x}')" for x in (*rules.DEPENDENCY_NOISE_PREFIXES, "__"))
_ROOTED = " OR ".join(f"starts_with(low, 'file:{x}')" for x in rules.DEPENDENCY_FILE_ROOTS)
ORACLE_SQL["packet_lists"] = f"""WITH {retrieval_ctes(True)},
raw AS (SELECT DISTINCT s.request_id, unnest(df.dependencies) AS x FROM scored s JOIN df USING (source)),
d AS (SELECT request_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS d, lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS low FROM raw),
clean AS (SELECT DISTINCT request_id, d FROM d WHERE NOT ({_NOISY}) AND low NOT IN ({quoted(rules.DEPENDENCY_NOISE)}) AND (NOT starts_with(low, 'file:') OR {_ROOTED})
  AND (starts_with(low, 'file:') OR NOT contains(low, '.')) AND length(d) >= 3),
deps AS (SELECT request_id, list_sort(list(d))[1:180] AS l FROM clean GROUP BY request_id),
recent AS (SELECT request_id, list_sort(list_distinct(list(path)))[1:25] AS l FROM scored WHERE freshness >= 85e-2 GROUP BY request_id)
SELECT q.request_id, coalesce(array_to_string(deps.l, '|'), '') AS dependencies, coalesce(array_to_string(recent.l, '|'), '') AS recent_changes
FROM requests q LEFT JOIN deps USING (request_id) LEFT JOIN recent ON recent.request_id = q.request_id"""

ORACLE_SQL["packet_systems"] = rf"""WITH {FILES},
v AS (SELECT project AS request_id, CASE WHEN split_part(path, '/', 1) = 'data' THEN 'data/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS v FROM files
  UNION ALL SELECT 'page' || page_id % 10, CASE WHEN page_id % 3 = 0 THEN ' file:' ELSE '' END || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) FROM pages),
r AS (SELECT request_id, regexp_replace(replace(v, '\', '/'), '^\s+|\s+$', '', 'g') AS raw FROM v),
n AS (SELECT request_id, CASE WHEN starts_with(raw, 'file:') THEN substr(raw, 6) ELSE raw END AS name FROM r WHERE raw <> ''),
p AS (SELECT *, lower(split_part(name, '/', 1)) AS head, lower(split_part(name, '/', 2)) AS second FROM n),
s AS (SELECT DISTINCT request_id, CASE WHEN head = 'data' THEN CASE WHEN second <> '' AND second NOT IN ({quoted(rules.SYSTEM_DATA_NOISE)}) THEN 'data/' || second END
  WHEN head IN ({quoted(rules.SYSTEM_NOISE)}) THEN NULL WHEN regexp_matches(lower(name), '^\.[^/]+/workspaces/') THEN split_part(name, '/', 5) ELSE name END AS system FROM p)
SELECT request_id, array_to_string(list_sort(list(system))[1:40], '|') AS systems FROM s WHERE system <> '' GROUP BY request_id""".replace("\\\\", "\\")

ORACLE_SQL["fallback_context"] = f"""WITH {FILES}, {DEPS},
requests AS (SELECT CAST(n_nationkey AS VARCHAR) AS request_id, ['mmo_workspace', 'unity_workspace'][n_nationkey % 2 + 1] AS workspace_id,
  n_name || CASE n_nationkey % 3 WHEN 0 THEN ' doc_8.xml' WHEN 1 THEN ' onuse' ELSE '' END AS prompt FROM nation),
{REQUEST_FEATURES}, {DOC_FEATURES},
hit AS (SELECT DISTINCT request_id FROM rf, df WHERE len(list_filter(terms, lambda x: contains(hay, x))) / CAST(len(terms) AS DOUBLE) > 5e-2),
idle AS (SELECT *, 0e0 AS relevance FROM rf, df WHERE request_id NOT IN (SELECT request_id FROM hit) AND ext IN ({quoted(rules.DOMAIN_EXTENSIONS)}) AND NOT d_in_low_signal AND NOT d_in_tools),
imp AS (SELECT *, greatest(5e-2, least(1e0, 5e-1 + least(45e-2, n_deps * 4e-2) + {bonus_sql()})) AS importance, 78e-2 AS confidence, 0e0 AS semantic FROM idle),
r AS (SELECT *, {FINAL} AS final_score, row_number() OVER (PARTITION BY request_id ORDER BY importance DESC, freshness DESC, n_deps DESC, source) AS rn FROM imp)
SELECT request_id, source, {rnd('importance')} AS importance, freshness, CAST(n_deps AS BIGINT) AS n_deps, final_score FROM r WHERE rn <= 24"""

ORACLE_SQL["hybrid_score"] = f"""WITH {retrieval_ctes(True).replace('scored AS (', 'scored0 AS (')},
short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY relevance DESC, importance DESC, freshness DESC, source) AS place FROM scored0) WHERE place <= 40),
v AS (SELECT s.request_id, s.source, {rnd('(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) + 1e0) / 2e0')} AS cosine
  FROM short s JOIN df ON df.source = s.source JOIN embeddings d ON d.vec_id = df.doc_id JOIN embeddings q ON CAST(q.vec_id AS VARCHAR) = s.request_id),
imp2 AS (SELECT s.* EXCLUDE (semantic, final_score), coalesce(cosine, 0e0) AS semantic FROM scored0 s LEFT JOIN v USING (request_id, source)),
scored AS (SELECT *, {FINAL} AS final_score FROM imp2),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id {_RANK}) AS rank FROM scored)
SELECT request_id, source, semantic, final_score, rank FROM r WHERE rank <= 10"""

ORACLE_SQL["assist_shortlists"] = f"""WITH {retrieval_ctes(False)},
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY relevance DESC, importance DESC, freshness DESC, source) AS place, count(*) OVER (PARTITION BY request_id) AS n FROM scored)
SELECT request_id, source, place FROM r WHERE place <= 20 AND n >= 8"""

ORACLE_SQL["hinted_scores"] = f"""WITH {retrieval_ctes(True).replace('scored AS (', 'scored0 AS (')},
h AS (SELECT s.* EXCLUDE (final_score), s.source = 'artifact:file:src/src1/doc_' || (CAST(request_id AS BIGINT) * 4 + 2) || '.py' AS listed,
  CASE WHEN contains(lower(s.source || ' ' || s.body || ' ' || array_to_string(df.dependencies, ' ')), 'the') THEN 5e-1 ELSE 0e0 END AS share FROM scored0 s JOIN df USING (source)),
imp3 AS (SELECT * REPLACE (greatest(relevance, CASE WHEN listed THEN 1e0 ELSE 0e0 END, share * 95e-2) AS relevance, CASE WHEN listed THEN 1e0 ELSE importance END AS importance,
  CASE WHEN listed THEN 98e-2 ELSE confidence END AS confidence) FROM h),
scored AS (SELECT *, {FINAL} AS final_score FROM imp3),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id {_RANK}) AS rank FROM scored)
SELECT request_id, source, {rnd('relevance', 6)} AS relevance, final_score, rank FROM r WHERE rank <= 10"""

# --- memory and knowledge ------------------------------------------------------------------------

MEMORY = """
memory AS (SELECT 'm' || conv_id || '-' || turn AS id, 'p' || conv_id % 5 AS project_id, 'u' || conv_id % 7 AS user_id,
  CASE WHEN role = 'user' THEN 'episodic' ELSE 'project' END AS scope, text AS content, (40 + (conv_id * 7 + turn * 13) % 60) / 100e0 AS confidence, conv_id * 1000 + turn AS seq FROM conversations)"""
COPIES = """
memory_dup AS (SELECT * FROM memory UNION ALL SELECT id || '-c', project_id, user_id, scope, '  ' || replace(content, ' ', '  '), confidence, seq + 500 FROM memory WHERE seq % 3 = 0)"""

ORACLE_SQL["memory_search"] = f"""WITH {MEMORY}, {CHAT},
q AS (SELECT *, list_filter(string_split_regex(trim(regexp_replace(lower(prompt), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 2)[1:6] AS words FROM chat),
j AS (SELECT q.request_id, m.id, m.seq, row_number() OVER (PARTITION BY q.request_id ORDER BY m.seq DESC) AS rn FROM q JOIN memory m USING (project_id, user_id)
  WHERE len(words) = 0 OR len(list_filter(words, lambda w: contains(lower(content), w))) > 0)
SELECT request_id, id, seq FROM j WHERE rn <= 8"""

DUPLICATES = """
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, user_id ORDER BY seq DESC) AS n FROM memory_dup) WHERE n <= 500),
duplicates AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, user_id, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) ORDER BY seq DESC) AS k FROM newest) WHERE k > 1)"""
ORACLE_SQL["memory_compaction"] = f"""WITH {MEMORY}, {COPIES}, {DUPLICATES} SELECT id, project_id, user_id FROM duplicates"""
ORACLE_SQL["memory_compacted"] = f"""WITH {MEMORY}, {COPIES}, {DUPLICATES}
SELECT project_id, user_id, count(*) AS entries, min(id) AS first_id FROM memory_dup WHERE id NOT IN (SELECT id FROM duplicates) GROUP BY ALL"""
ORACLE_SQL["memory_health"] = f"""WITH {MEMORY}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq DESC) AS n FROM memory)
SELECT project_id, count(*) AS scanned_entries, count(*) FILTER (confidence < 45e-2) AS low_confidence_entries FROM r WHERE n <= 300 GROUP BY project_id"""
ORACLE_SQL["memory_recent"] = f"""WITH {MEMORY} SELECT id, user_id, confidence FROM memory WHERE project_id = 'p1' ORDER BY seq DESC LIMIT 50"""

ORACLE_SQL["auto_memories"] = f"""WITH {CHAT}
SELECT 'auto-' || request_id AS id, project_id, user_id, 'episodic' AS scope,
  sha256('TaskType: debugging' || chr(10) || 'Request: ' || substr(prompt, 1, 600) || chr(10) || 'Response: ' || substr(a.text, 1, 1200)) AS content_hash,
  'task|debugging|auto' AS tags, {rnd('greatest(45e-2, least(90e-2, conv_id % 100 / 100e0 - 5e-2))')} AS confidence,
  '{{"trace_id":"t' || request_id || '","selected_tier":"flash","provider":"remote"}}' AS provenance
FROM chat c JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') a USING (conv_id, turn)"""

ORACLE_SQL["knowledge_search"] = f"""WITH {FILES}, {DEPS}, {requests_cte()},
q AS (SELECT request_id, list_filter(string_split(trim(regexp_replace(lower(prompt), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 2) AS words FROM requests),
n AS (SELECT 'file:' || path AS node_id, lower(regexp_extract(path, '[^/]*$', 0) || ' ' || path || ' ' || content || ' ' || array_to_string(dependencies, ' ') || ' async') AS hay, doc_id % 50 / 50e0 AS confidence FROM corpus),
s AS (SELECT request_id, node_id, len(list_filter(words, lambda w: contains(hay, w))) / CAST(len(words) AS DOUBLE) * (6e-1 + 4e-1 * confidence) AS score FROM q, n),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, node_id) AS rank FROM s WHERE score > 0)
SELECT request_id, node_id, {rnd('score', 6)} AS score, rank FROM r WHERE rank <= 5"""

ORACLE_SQL["knowledge_scope"] = f"""WITH {requests_cte()},
f AS (SELECT CAST(page_id % (SELECT count(*) FROM benchmark) AS VARCHAR) AS request_id, ['.artifacts/workspaces/mmo_workspace/p1/', '.artifacts/workspaces/plain/p2/', 'app/'][page_id % 3 + 1] || page_id AS source_path FROM pages)
SELECT request_id, source_path FROM f JOIN requests USING (request_id)
WHERE NOT starts_with(source_path, 'app/') AND starts_with(source_path, '.artifacts/workspaces/' || workspace_id || '/' || project_id || '/')"""

# --- graph ------------------------------------------------------------------------------------------

ORACLE_SQL["relationship_graph"] = f"""WITH {FILES}, {DEPS},
d AS (SELECT path, unnest(dependencies) AS dep FROM corpus),
e AS (SELECT 'file:' || path AS s, 'module:' || module AS t, 'related_to' AS relation FROM corpus
  UNION ALL SELECT 'file:' || path, 'symbol:' || dep, CASE WHEN contains(lower(dep), 'event') OR contains(lower(dep), 'emit') THEN 'emits' ELSE 'uses' END FROM d),
n AS (SELECT DISTINCT project, id FROM (SELECT c.project, unnest(['file:' || c.path, 'module:' || c.module]) AS id FROM corpus c
  UNION ALL SELECT project, 'symbol:' || dep FROM (SELECT project, unnest(dependencies) AS dep FROM corpus)))
SELECT relation AS what, count(*) AS n FROM e GROUP BY relation
UNION ALL SELECT split_part(id, ':', 1), count(*) FROM n GROUP BY 1
UNION ALL SELECT 'map', count(*) FROM d"""

EDGES = """
edges AS MATERIALIZED (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS source, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target,
  CASE WHEN page_id % 2 = 0 THEN 'map' ELSE 'edge' END AS kind, CASE WHEN page_id % 3 = 0 THEN ' ' ELSE 'links' END AS relation FROM pages)"""
ORACLE_SQL["normalized_links"] = f"""WITH {EDGES}
SELECT CASE WHEN trim(relation) = '' THEN 'related_to' ELSE trim(relation) END AS relation, kind, count(*) AS edges FROM edges WHERE trim(source) <> '' AND trim(target) <> '' GROUP BY ALL"""

SEEDS = f"""
names AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT DISTINCT target FROM edges),
q AS (SELECT name AS request_id, {terms_of('name')} AS terms FROM names),
nodes AS (SELECT source AS node FROM edges UNION SELECT target FROM edges),
hits AS MATERIALIZED (SELECT request_id, node FROM q, nodes WHERE len(list_filter(terms, lambda x: contains(lower(node), x))) > 0),
ends AS (SELECT request_id, source, target FROM hits JOIN edges ON target = node UNION SELECT request_id, source, target FROM hits JOIN edges ON source = node AND kind = 'edge'),
seeded AS (SELECT request_id, unnest([source, target]) AS node FROM ends
  UNION SELECT h.request_id, h.node FROM hits h WHERE node IN (SELECT source FROM edges WHERE kind = 'map')),
seeds AS MATERIALIZED (SELECT DISTINCT request_id, node FROM seeded UNION SELECT request_id, node FROM q, (SELECT DISTINCT source AS node FROM edges WHERE kind = 'map' ORDER BY 1 LIMIT 3) f
  WHERE request_id NOT IN (SELECT request_id FROM seeded))"""
ORACLE_SQL["graph_seeds"] = f"WITH {EDGES}, {SEEDS} SELECT request_id, node FROM seeds"

EXPAND = """
near AS MATERIALIZED (SELECT source AS node, target AS neighbour FROM edges UNION SELECT target, source FROM edges),
sc AS (SELECT request_id, count(*) AS c FROM seeds GROUP BY request_id),
v0 AS MATERIALIZED (SELECT request_id, node, 0 AS depth, row_number() OVER (PARTITION BY request_id ORDER BY node) AS place FROM seeds JOIN sc USING (request_id) WHERE c < 80),
c1 AS (SELECT v.request_id, neighbour AS node, min(place) AS pp FROM v0 v JOIN near USING (node) WHERE NOT EXISTS (SELECT 1 FROM v0 w WHERE w.request_id = v.request_id AND w.node = neighbour) GROUP BY ALL),
r1 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pp, node) AS n FROM c1),
v1 AS MATERIALIZED (SELECT r1.request_id, node, 1 AS depth, n + c AS place FROM r1 JOIN sc USING (request_id) WHERE n <= 80 - c),
u1 AS MATERIALIZED (SELECT * FROM v0 UNION ALL SELECT * FROM v1),
t1 AS (SELECT request_id, count(*) AS c FROM u1 GROUP BY request_id),
c2 AS (SELECT v.request_id, neighbour AS node, min(place) AS pp FROM v1 v JOIN near USING (node) WHERE NOT EXISTS (SELECT 1 FROM u1 w WHERE w.request_id = v.request_id AND w.node = neighbour) GROUP BY ALL),
r2 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pp, node) AS n FROM c2),
visited AS (SELECT request_id, node, depth FROM u1 UNION ALL SELECT r2.request_id, node, 2 FROM r2 JOIN t1 USING (request_id) WHERE n <= 80 - c
  UNION ALL SELECT request_id, node, 0 FROM seeds JOIN sc USING (request_id) WHERE c >= 80)"""
ORACLE_SQL["graph_expand"] = f"""WITH {EDGES}, {SEEDS}, {EXPAND}
SELECT request_id, node, CAST(depth AS BIGINT) AS depth, CASE WHEN contains(node, '/') AND split_part(node, '/', 1) <> '' THEN split_part(node, '/', 1) END AS system, NOT contains(node, '/') AS is_dependency FROM visited"""
ORACLE_SQL["visited_relations"] = f"""WITH {EDGES}, {SEEDS}, {EXPAND},
t AS (SELECT DISTINCT v.request_id, e.* FROM visited v JOIN edges e ON e.source = v.node OR e.target = v.node WHERE e.kind = 'edge')
SELECT request_id, CASE WHEN trim(relation) = '' THEN 'related_to' ELSE relation END AS relation, count(*) AS edges FROM t GROUP BY ALL"""

# --- quality --------------------------------------------------------------------------------------------

TRACES = """
traces AS (SELECT event_id AS seq, 'p' || user_id % 5 AS project,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'route' WHEN event_type = 'error' THEN 'feedback' ELSE 'retrieval' END AS kind,
  event_id % 100 / 100e0 AS score, event_id % 7 AS contexts, event_id % 11 AS dropped, event_id * 37 % 3501 AS used, (50 + event_id % 50) / 100e0 AS confidence,
  event_id % 9 = 0 AS fell_back, event_id % 4 = 0 AS stale, event_id % 4 AS deps, event_id % 3 <> 0 AS has_systems, event_id % 3 AS verdict, event_id % 8 AS bits,
  value / 100000e0 AS cost, event_id % 200 AS pt, event_id % 300 AS ct, ts FROM events)"""


def rate(kind: str, cond: str) -> str:
    return rnd(f"coalesce(count(*) FILTER (kind = '{kind}' AND {cond}) / CAST(nullif(count(*) FILTER (kind = '{kind}'), 0) AS DOUBLE), 0e0)")


KPI = f"""count(*) AS sample_size, count(*) FILTER (kind = 'retrieval') AS retrieval_samples, count(*) FILTER (kind = 'route') AS route_samples,
  {rnd("coalesce(avg(score) FILTER (kind = 'retrieval'), 0e0)")} AS retrieval_precision,
  {rate('route', 'confidence >= 82e-2 AND (score < 25e-2 OR contexts = 0)')} AS hallucination_rate,
  {rate('retrieval', 'stale')} AS stale_context_rate, {rate('retrieval', '(deps = 0 OR has_systems)')} AS architectural_consistency,
  {rnd("coalesce(avg(greatest(0e0, least(1e0, used / 3500e0 * (1e0 - dropped / CAST(greatest(1, dropped + contexts) AS DOUBLE))))) FILTER (kind = 'route'), 0e0)")} AS token_efficiency,
  {rate('route', 'confidence >= 75e-2 AND NOT fell_back')} AS reasoning_success,
  {rate('feedback', 'verdict = 0')} AS feedback_correct_rate, {rate('feedback', 'verdict = 1')} AS feedback_partial_rate, {rate('feedback', 'verdict = 2')} AS feedback_incorrect_rate,
  {rate('feedback', 'bits >= 4')} AS feedback_hallucination_rate, {rate('feedback', 'bits % 4 >= 2')} AS feedback_xml_missing_rate,
  {rate('feedback', 'bits % 2 = 1')} AS feedback_retrieval_incorrect_rate, 0e0 AS feedback_compression_bad_rate, 0e0 AS feedback_architectural_loss_rate,
  {rnd("CAST(coalesce(sum(CAST(cost AS DECIMAL(28,12))) FILTER (kind = 'route'), 0) AS DOUBLE)", 6)} AS total_cost_usd,
  CAST(coalesce(sum(pt) FILTER (kind = 'route'), 0) AS DOUBLE) AS prompt_tokens, CAST(coalesce(sum(ct) FILTER (kind = 'route'), 0) AS DOUBLE) AS completion_tokens,
  CAST(coalesce(sum(pt + ct) FILTER (kind = 'route'), 0) AS DOUBLE) AS total_tokens"""
NOTED = """SELECT *, coalesce(nullif(array_to_string(
  CASE WHEN sample_size < 40 THEN ['Low sample size; evaluation confidence is limited.'] ELSE [] END
  || CASE WHEN stale_context_rate >= 30e-2 THEN ['High stale-context rate detected.'] ELSE [] END
  || CASE WHEN hallucination_rate >= 20e-2 THEN ['Potential hallucination pressure detected in high-confidence responses.'] ELSE [] END
  || CASE WHEN token_efficiency <= 40e-2 THEN ['Low token efficiency; context compression and ranking should be tuned.'] ELSE [] END
  || CASE WHEN feedback_incorrect_rate >= 25e-2 THEN ['User feedback indicates high incorrect-response rate.'] ELSE [] END
  || CASE WHEN feedback_xml_missing_rate >= 20e-2 THEN ['Frequent XML-missing reports detected; XML ranking should be boosted.'] ELSE [] END
  || CASE WHEN feedback_hallucination_rate >= 15e-2 THEN ['Frequent hallucination reports detected from daily usage feedback.'] ELSE [] END, ' '), ''),
  'Evaluation completed without critical degradation signals.') AS notes,
  CASE WHEN hallucination_rate >= 4e-1 OR stale_context_rate >= 6e-1 THEN 'critical' WHEN hallucination_rate >= 25e-2 OR stale_context_rate >= 35e-2 OR retrieval_precision <= 3e-1 THEN 'degraded' ELSE 'healthy' END AS gate FROM k"""
ORACLE_SQL["eval_kpis"] = f"WITH {TRACES}, k AS (SELECT {KPI} FROM traces) {NOTED}"
ORACLE_SQL["eval_by_project"] = f"""WITH {TRACES}, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq DESC) AS n FROM traces),
k AS (SELECT project, {KPI} FROM r WHERE n <= 300 GROUP BY project) {NOTED}"""

_E = "event_id"
FAILURES = """
wide AS (SELECT count(*) FILTER (event_id % 3 = 0 AND event_id % 6 <> 0) AS xml_missing, count(*) FILTER (event_id % 15 <= 1 AND event_id % 12 >= 5) AS wrong_module,
  0 AS wrong_generation, count(*) FILTER (event_id % 4 = 0) AS stale_summary, count(*) FILTER (event_id % 40 >= 25) AS dependency_noise,
  count(*) FILTER (event_id % 12 = 0) AS graph_underexpansion, count(*) FILTER (event_id % 15 >= 12) AS graph_overexpansion,
  count(*) FILTER (event_id * 17 % 3000 >= 1800 AND event_id % 12 <= 8) AS compression_loss, count(*) FILTER (event_id % 7 >= 4 AND event_id % 3 = 0) AS ranking_collision,
  count(*) FILTER (event_id % 12 = 0) AS semantic_misdirection FROM events),
failures AS (""" + " UNION ALL ".join(f"SELECT '{t}' AS failure_type, CAST({t} AS BIGINT) AS count FROM wide" for t in rules.FAILURE_TYPES) + ")"
FEEDBACK = """
feedback AS (SELECT doc_id AS seq, 'p' || doc_id % 5 AS project_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'partial' ELSE 'incorrect' END AS verdict,
  CASE WHEN quality = 0 THEN ['hallucination'] ELSE [] END || CASE WHEN toxic = 1 THEN ['context_bad'] ELSE [] END || CASE WHEN doc_id % 5 = 0 THEN ['xml_missing'] ELSE [] END AS issues FROM labels)"""
DIAGNOSIS = """
diagnosis AS (SELECT f.failure_type, CAST(f.count + CASE f.failure_type WHEN 'xml_missing' THEN (SELECT count(*) FROM feedback WHERE list_contains(issues, 'xml_missing'))
  WHEN 'semantic_misdirection' THEN (SELECT count(*) FROM feedback WHERE list_contains(issues, 'hallucination')) ELSE 0 END AS BIGINT) AS count FROM failures f)"""
ORACLE_SQL["failure_taxonomy"] = f"WITH {FAILURES} SELECT failure_type, count FROM failures"
ORACLE_SQL["diagnosis"] = f"WITH {FAILURES}, {FEEDBACK}, {DIAGNOSIS} SELECT failure_type, count FROM diagnosis"
_ADVICE = " || ".join(
    f"CASE WHEN (SELECT count FROM diagnosis WHERE failure_type = '{t}') > 0 THEN ['{a}'] ELSE [] END" for t, a in rules.RECOMMENDATIONS
)
ORACLE_SQL["recommendations"] = f"""WITH {FAILURES}, {FEEDBACK}, {DIAGNOSIS}, a AS (SELECT {_ADVICE} AS l)
SELECT CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS ord, unnest(l) AS recommendation FROM a"""
ORACLE_SQL["feedback_summary"] = f"""WITH {FEEDBACK}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq DESC) AS n FROM feedback)
SELECT project_id, count(*) AS total, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'incorrect') AS incorrect
FROM r WHERE n <= 500 GROUP BY project_id"""
ORACLE_SQL["top_issues"] = f"""WITH {FEEDBACK} SELECT issue, count(*) AS count FROM (SELECT unnest(issues) AS issue FROM (FROM feedback ORDER BY seq DESC LIMIT 500)) GROUP BY issue ORDER BY count DESC, issue LIMIT 8"""
ORACLE_SQL["usage_summary"] = """SELECT count(*) AS total_queries, count(*) AS successful_queries, CAST(0 AS BIGINT) AS failed_queries,
  count(*) FILTER (event_id % 3 = 0) AS xml_focused_queries, count(*) FILTER (event_id % 6 = 0) AS xml_focused_with_xml_selected, count(DISTINCT event_type) AS domain_count FROM events"""
ORACLE_SQL["reflection"] = f"""WITH {MEMORY}, {COPIES}, {DUPLICATES}, {FILES}, {FILES_BEFORE}, {FAILURES}, {FEEDBACK}, {DIAGNOSIS},
a AS (SELECT ({_ADVICE})[1:3] AS advice),
c AS (SELECT (SELECT count(*) FROM (FROM memory_dup ORDER BY seq DESC LIMIT 300)) AS scanned, (SELECT count(*) FROM duplicates) AS removed,
  (SELECT count(*) FROM (FROM memory_dup ORDER BY seq DESC LIMIT 300) WHERE confidence < 45e-2) AS low,
  (SELECT count(*) FILTER (f.hash IS DISTINCT FROM b.hash) FROM (SELECT project, path, hash FROM files) f FULL JOIN (SELECT project, path, hash FROM files_before) b USING (project, path)) AS drift,
  (SELECT count(*) FROM (FROM feedback ORDER BY seq DESC LIMIT 400)) AS total,
  (SELECT string_agg(issue || ':' || n, ', ' ORDER BY n DESC, issue) FROM (SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM (FROM feedback ORDER BY seq DESC LIMIT 400)) GROUP BY issue ORDER BY n DESC, issue LIMIT 4)) AS issues,
  (SELECT string_agg(failure_type || ':' || count, ', ' ORDER BY count DESC, failure_type) FROM (FROM diagnosis WHERE count > 0 ORDER BY count DESC, failure_type LIMIT 4)) AS fails)
SELECT scanned AS scanned_entries, removed AS duplicates_removed, low AS low_confidence_entries,
  array_to_string(CASE WHEN removed > 0 THEN ['Removed ' || removed || ' duplicate memory entries.'] ELSE [] END
   || CASE WHEN low > 0 THEN ['Found ' || low || ' low-confidence entries for review.'] ELSE [] END
   || CASE WHEN drift > 0 THEN ['Detected ' || drift || ' potential stale knowledge nodes; run /v1/knowledge/sync.'] ELSE [] END
   || CASE WHEN total > 0 THEN ['Analyzed ' || total || ' cognitive feedback entries.', 'Top feedback issues: ' || issues || '.'] ELSE [] END
   || ['Calibration failures: ' || fails || '.'] || list_transform(advice, lambda x: 'Calibration recommendation: ' || x), chr(10)) AS notes
FROM c, a"""

# --- routing -------------------------------------------------------------------------------------

_WORDS = "len(string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' '))"
ROUTE = f"""
rq AS (SELECT *, CASE WHEN conv_id % 17 = 0 THEN 'max' END AS tier_hint, conv_id % 2 = 0 AS has_retrieval, ['refactor', 'debug', 'testing', 'architecture'][conv_id % 4 + 1] AS intent,
  length(prompt) % 11 AS n_dependencies, turn % 3 AS n_risks, length(prompt) % 20 AS n_contexts FROM chat),
sn AS (SELECT request_id, count(*) AS n_snippets, sum({_WORDS.format(c='text')}) AS w FROM chat JOIN (SELECT conv_id, text FROM conversations WHERE role = 'assistant') USING (conv_id) GROUP BY request_id),
rt AS (SELECT rq.*, coalesce(n_snippets, 0) AS n_snippets, {_WORDS.format(c='prompt')} + coalesce(w, 0) AS tokens,
  least(1e0, 1e-1 + CASE WHEN length(prompt) > 800 THEN 5e-1 WHEN length(prompt) > 450 THEN 35e-2 WHEN length(prompt) > 220 THEN 2e-1 ELSE 0e0 END + least(45e-2, {count_of('lower(prompt)', rules.COMPLEXITY_MARKERS)} * 12e-2)) AS complexity
  FROM rq LEFT JOIN sn USING (request_id)),
st AS (SELECT *, CASE WHEN tier_hint IS NOT NULL THEN tier_hint || '~explicit tier hint' WHEN has_retrieval AND intent = 'architecture' THEN 'plus~intent architecture'
  WHEN has_retrieval AND intent = 'refactor' AND n_dependencies >= 8 THEN 'plus~high dependency refactor' WHEN has_retrieval AND intent = 'refactor' AND n_dependencies >= 3 THEN 'flash~moderate dependency refactor'
  WHEN has_retrieval AND intent = 'debug' AND n_risks > 0 THEN 'plus~debug with contextual risks' WHEN has_retrieval AND n_contexts >= 14 THEN 'plus~large context packet'
  WHEN complexity >= 8e-1 THEN 'plus~high prompt complexity' WHEN complexity >= 45e-2 THEN 'flash~moderate prompt complexity' WHEN n_snippets >= 6 THEN 'flash~rich local context'
  ELSE 'local~low complexity local-first' END AS d FROM rt),
tiers(tier_rank, tier, cost_floor, target, input_rate, output_rate) AS (VALUES {', '.join(f"({r}, '{t}', {c}e0, {g}e0, {i}e0, {o}e0)" for r, t, c, g, i, o in rules.TIERS)}),
costs AS (SELECT request_id, conv_id, tier, tier_rank, target, tokens, {rnd('greatest(cost_floor, tokens / 1000e0 * input_rate + greatest(120, floor(tokens * 75e-2)) / 1000e0 * output_rate)', 6)} AS estimated_cost_usd FROM rt, tiers)"""
ORACLE_SQL["route_tiers"] = f"WITH {CHAT}, {ROUTE} SELECT request_id, split_part(d, '~', 1) AS start_tier, split_part(d, '~', 2) AS start_reason, {rnd('complexity')} AS complexity FROM st"
ORACLE_SQL["route_cost"] = f"WITH {CHAT}, {ROUTE} SELECT request_id, tier, CAST(tokens AS BIGINT) AS tokens, estimated_cost_usd FROM costs"
ORACLE_SQL["served_tiers"] = f"""WITH {CHAT}, {ROUTE},
s AS (SELECT c.*, c.tier_rank - t0.tier_rank AS step, least(3, 3 - t0.tier_rank) AS last,
  CASE WHEN (c.conv_id + c.tier_rank) % 5 <> 0 THEN {rnd('c.tier_rank * 5e-2 + (c.conv_id % 30 + 60) / 100e0')} END AS confidence
  FROM costs c JOIN st USING (request_id) JOIN tiers t0 ON t0.tier = split_part(d, '~', 1) WHERE c.tier_rank >= t0.tier_rank),
w AS (SELECT *, max(CAST(tier <> 'local' AND estimated_cost_usd > 13e-3 AS INT)) OVER (PARTITION BY request_id ORDER BY step) AS stopped FROM s),
b AS (SELECT request_id, min(step) FILTER (stopped = 0 AND confidence IS NOT NULL AND (step >= last OR confidence >= target)) AS best, max(last) AS last FROM w GROUP BY request_id)
SELECT b.request_id, coalesce(w.tier, 'local') AS selected_tier, CAST(coalesce(best, b.last) AS BIGINT) AS escalation_depth, coalesce(w.estimated_cost_usd, 0e0) AS estimated_cost_usd, best IS NULL AS is_fallback
FROM b LEFT JOIN w ON w.request_id = b.request_id AND w.step = best"""
_TASK = "['chat', 'debugging', 'planning', 'unknown'][conv_id % 4 + 1]"
ORACLE_SQL["prompt_routing"] = f"""WITH {CHAT}, t AS (SELECT *, {_TASK} AS task,
  CASE conv_id % 3 WHEN 0 THEN 35e-4 WHEN 1 THEN 4e-4 ELSE 1e-3 END AS ir, CASE conv_id % 3 WHEN 0 THEN 7e-3 WHEN 1 THEN 8e-4 ELSE 2e-3 END AS orate FROM chat)
SELECT request_id, CASE WHEN conv_id % 5 = 0 THEN 'coding' WHEN conv_id % 7 = 0 THEN 'verifier' WHEN task = 'planning' THEN 'planning' ELSE 'coding' END AS role,
  {rnd('length(prompt) * 2 / 1000e0 * ir + (turn * 100 + 50) / 1000e0 * orate', 6)} AS cost,
  {rnd("greatest(25e-2, least(95e-2, 9e-1 - CASE WHEN length(prompt) > 280 THEN 15e-2 ELSE 0e0 END - CASE WHEN " + any_of('lower(prompt)', rules.DRAFT_MARKERS) + " THEN 2e-1 ELSE 0e0 END - CASE WHEN length(prompt) - length(replace(prompt, '?', '')) > 1 THEN 5e-2 ELSE 0e0 END))")} AS draft_confidence,
  sha256(CASE WHEN task = 'chat' THEN prompt ELSE 'TaskType: ' || task || chr(10) || 'Directive: ' || CASE task WHEN 'debugging' THEN '{rules.TASK_DIRECTIVES['debugging']}'
    WHEN 'planning' THEN '{rules.TASK_DIRECTIVES['planning']}' ELSE '{rules.TASK_DIRECTIVES['chat']}' END || chr(10) || chr(10) || 'UserRequest:' || chr(10) || prompt END) AS task_prompt_hash FROM t"""
ORACLE_SQL["parsed_answers"] = r"""
SELECT conv_id, turn, CAST(0 AS BIGINT) AS ord, 'patch_file' AS type, 'docs/c' || conv_id || '.md' AS target,
  substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 500) AS intent, 'low' AS risk, role AS rationale FROM conversations WHERE conv_id % 4 <> 3
UNION ALL SELECT conv_id, turn, 1, 'update_file', 'a' || turn || '.py', '', 'medium', 'model-assisted planning' FROM conversations WHERE conv_id % 4 <> 3"""

# --- bulk edits --------------------------------------------------------------------------------------

EDITS = f"""
plan AS (SELECT *, 'plan' || doc_id % 50 AS plan_id, 's' || doc_id AS step_id, CASE WHEN doc_id % 19 = 0 THEN 'delete_file' WHEN doc_id % 23 = 0 THEN 'create_file' ELSE 'patch_file' END AS type,
  CASE WHEN doc_id % 29 = 0 THEN '' WHEN doc_id % 31 = 0 THEN path || '.gone' ELSE path END AS target, doc_id % 29 <> 0 AS valid, doc_id % 31 <> 0 AND doc_id % 29 <> 0 AS present FROM files),
checks AS (SELECT *, (CASE WHEN NOT valid THEN ['error~invalid_target~Target path is invalid, absolute, or escapes workspace root.'] ELSE [] END
  || CASE WHEN valid AND (starts_with(target, 'src/src3/') OR starts_with(target, 'docs/src4/')) THEN ['error~blocked_target~Target path ' || target || ' is blocked by safety policy.'] ELSE [] END
  || CASE WHEN valid AND type = 'patch_file' AND NOT present THEN ['error~target_missing~Update/Patch target file does not exist.'] ELSE [] END
  || CASE WHEN valid AND present AND type = 'patch_file' AND strlen(content) > 20000 THEN ['error~file_too_large~Target exceeds max_file_bytes=20000.'] ELSE [] END
  || CASE WHEN valid AND type = 'create_file' THEN ['warning~empty_create_content~Create action has no content and will use generated placeholder.'] ELSE [] END
  || CASE WHEN valid AND type = 'delete_file' AND NOT present THEN ['warning~delete_target_missing~Delete target file does not exist.'] ELSE [] END) AS issues FROM plan),
patched AS (SELECT *, len(list_filter(issues, lambda i: starts_with(i, 'error'))) > 0 AS blocked, replace(content, 'the', 'THE') AS body1 FROM checks),
outcome AS (SELECT *, CASE WHEN contains(body1, 'an') THEN substr(body1, 1, instr(body1, 'an') - 1) || '<AN>' || substr(body1, instr(body1, 'an') + 2) ELSE body1 END AS body2 FROM patched),
results AS (SELECT *, CASE WHEN blocked THEN 'skipped~Blocked by validation policy.' WHEN type = 'create_file' AND present THEN 'skipped~Target already exists.' WHEN type = 'create_file' THEN 'applied~File created.'
  WHEN type = 'delete_file' AND NOT present THEN 'skipped~File already missing.' WHEN type = 'delete_file' THEN 'applied~File deleted.'
  WHEN body2 = content THEN 'failed~Execution failed: Patch patterns did not match file contents.' WHEN strlen(body2) > 20000 THEN 'failed~Execution failed: content exceeds max_file_bytes=20000' ELSE 'applied~File updated.' END AS o FROM outcome)"""
ORACLE_SQL["edit_validation"] = f"""WITH {FILES}, {EDITS}, i AS (SELECT plan_id, step_id, unnest(issues) AS x FROM checks)
SELECT plan_id, step_id, split_part(x, '~', 1) AS severity, split_part(x, '~', 2) AS code, split_part(x, '~', 3) AS message FROM i"""
ORACLE_SQL["bulk_edit"] = f"""WITH {FILES}, {EDITS}
SELECT step_id, split_part(o, '~', 1) AS status, split_part(o, '~', 2) AS message,
  CASE WHEN starts_with(o, 'applied') AND type = 'patch_file' THEN sha256(body2) WHEN starts_with(o, 'applied') AND type = 'create_file' THEN sha256('# Auto-generated' || chr(10) || '# Intent: tidy up' || chr(10)) END AS after_hash FROM results"""
ORACLE_SQL["edit_reports"] = f"""WITH {FILES}, {EDITS},
d AS (SELECT plan_id, max(CASE WHEN type = 'delete_file' THEN 4 WHEN ends_with(path, '.md') AND doc_id % 31 <> 0 THEN 1 ELSE 2 END) AS level FROM plan GROUP BY plan_id)
SELECT plan_id, count(*) FILTER (starts_with(o, 'applied')) AS applied, count(*) FILTER (starts_with(o, 'skipped')) AS skipped, count(*) FILTER (starts_with(o, 'failed')) AS failed,
  CASE level WHEN 4 THEN 'blocked' WHEN 2 THEN 'requires_approval' ELSE 'auto_execute' END AS state, CASE level WHEN 4 THEN 'critical' WHEN 2 THEN 'medium' ELSE 'low' END AS highest_risk, level = 1 AS execute_now,
  CASE level WHEN 4 THEN 'Critical-risk plan blocked by policy.' WHEN 2 THEN 'Medium-risk actions require approval by current policy.' ELSE 'Autopilot policy authorized execution for current risk profile.' END AS reason
FROM results JOIN d USING (plan_id) GROUP BY plan_id, level"""
ORACLE_SQL["edit_rollback"] = f"WITH {FILES} SELECT path AS doc_path, sha256(content) AS content_hash FROM files"
ORACLE_SQL["patch_dry_run"] = f"WITH {FILES}, {EDITS} SELECT step_id, present AND contains(content, 'onre') AS matches FROM plan WHERE type = 'patch_file'"
ORACLE_SQL["duplicate_plans"] = f"""WITH {CHAT}, p AS (SELECT conv_id % 10 AS run_id, conv_id * 100 + turn AS iteration, 'patch_file:' || prompt || ':' || project_id AS signature FROM chat)
SELECT run_id, iteration, signature, iteration > min(iteration) OVER (PARTITION BY run_id, signature) AS is_duplicate FROM p"""

# --- streams ----------------------------------------------------------------------------------------------

ORACLE_SQL["kpi_stream"] = f"""WITH {TRACES}, k AS (SELECT date_trunc('day', ts) AS d, {KPI} FROM traces GROUP BY 1)
SELECT * EXCLUDE (d), strftime(d, '%Y-%m-%d') AS day FROM k"""

# The next firing is the first weak event a cooldown after the last one; every other event looks at the firing before it.
ORACLE_SQL["cooldown_triggers"] = """WITH RECURSIVE
g AS MATERIALIZED (SELECT 'w' || user_id % 4 AS workspace_id, event_id AS seq, ts AS moment, event_type <> 'view' AS weak FROM events),
fire AS (SELECT workspace_id, min(struct_pack(moment := moment, seq := seq)) AS f FROM g WHERE weak GROUP BY workspace_id
  UNION ALL SELECT g.workspace_id, min(struct_pack(moment := g.moment, seq := g.seq)) FROM fire JOIN g ON g.workspace_id = fire.workspace_id
    AND g.weak AND g.moment >= fire.f.moment + INTERVAL 600 SECONDS GROUP BY g.workspace_id),
m AS (SELECT g.*, fire.f IS NOT NULL AS fired, max(fire.f.moment) OVER (PARTITION BY g.workspace_id ORDER BY g.moment, g.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM g LEFT JOIN fire ON fire.workspace_id = g.workspace_id AND fire.f.seq = g.seq)
SELECT workspace_id, seq, weak, fired, CASE WHEN fired THEN 'weak_context' WHEN moment < before + INTERVAL 600 SECONDS THEN 'cooldown_active' ELSE 'context_sufficient' END AS reason FROM m"""

ORACLE_SQL["embedding_cache"] = r"""WITH d AS (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS body, length(text) AS n FROM documents)
SELECT CAST(CASE WHEN body <> '' THEN 16 END AS BIGINT) AS dims, body <> '' AND body NOT IN (SELECT body FROM d WHERE n < 1000) AS is_new, count(*) AS texts FROM d GROUP BY ALL"""

_INCREMENT = r"""(regexp_matches(low, '\+\s*\d+(?:\.\d+)?')
  OR regexp_matches(low, '(?:aumenta|aumente|increase|add|somar|soma|incrementa|increment)\D{0,20}(?:em|by|\+)\s*\d+(?:\.\d+)?'))"""
_NAMED = r"lower(trim(replace(x, '\\', '/'), '/'))"
_RISK = f"""CASE WHEN {_NAMED} IN ({quoted(rules.HIGH_RISK_FILES)}) OR (starts_with({_NAMED}, 'app/') AND ends_with({_NAMED}, '.py')) THEN 'high'
  WHEN contains('/' || {_NAMED} || '/', '/tests/') OR regexp_extract({_NAMED}, '(?:^|/)[^/]+(\\.[^./]+)$', 1) IN ({quoted(rules.LOW_RISK_EXTENSIONS)}) THEN 'low' ELSE 'medium' END"""
ORACLE_SQL["edit_classes"] = f"""WITH a AS (SELECT 'b' || item_id AS request_id, item_id, text FROM benchmark UNION ALL SELECT 'p' || page_id, page_id, url || ' ' || html FROM pages),
p AS (SELECT request_id, item_id % 5 AS v,
  ['remove', 'update', 'create new file', 'raise rate to 1.5 in', 'add +2 in'][item_id % 5 + 1] || ' ./app/main.py, src/a.lua and src/a.lua, docs/n' || item_id % 7 || '.md ' || text AS prompt FROM a),
t AS (SELECT *, lower(prompt) AS low, list_filter(list_transform(regexp_extract_all(prompt, '([A-Za-z0-9_./\\\\-]+\\.[A-Za-z0-9]{{1,10}})', 1), lambda x: trim(regexp_replace(x, '^(\\./)+', ''), '/')), lambda x: x <> '') AS found FROM p)
SELECT request_id, CASE WHEN {any_of('low', rules.DELETE_HINTS)} THEN 'delete_file' WHEN {any_of('low', rules.PATCH_HINTS)} THEN 'patch_file'
  WHEN {any_of('low', rules.CREATE_HINTS)} OR ({any_of('low', ('file', 'arquivo'))} AND {any_of('low', rules.CREATE_WORDS)}) THEN 'create_file' ELSE 'update_file' END AS type,
  array_to_string(targets, '|') AS targets, {_INCREMENT} AS increment, array_to_string(list_transform(targets, lambda x: {_RISK}), '|') AS risks
FROM (SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i)[1:8] AS targets FROM t)"""
