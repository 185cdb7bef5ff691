"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL = {
    "op7_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        WINDOW same AS (PARTITION BY body)
    """,
}

# All windows that occur twice, marked from their first to their last token.
ORACLE_SQL["op5_substring_dedup"] = r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
    h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM s),
    d AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
    gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM d) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
           sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_sort(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(gone, p))), lambda p: ws[p]) END, ' ')) AS kept_sha256
    FROM w LEFT JOIN gone USING (doc_id)
"""

# The template's marks have 12 and 11 characters and a line feed follows the role.
ORACLE_SQL["op12_chat_format"] = r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
        UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
    ),
    marked AS (
        SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS escaped,
               replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') AS named
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(12 + length(named) + 1 + length(escaped) + 11) AS BIGINT) AS formatted_chars
    FROM marked GROUP BY conv_id
"""
