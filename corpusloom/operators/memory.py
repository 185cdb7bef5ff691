"""Memory and feedback rows: search, recency, compaction, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..session import raise_group_limit, stage
from .relevance import lexical_match


def newest_first() -> list[Column]:
    """Recency with the stored sequence as tie-breaker."""
    return [F.desc("updated_at"), F.desc("seq")]


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key in ``order``.

    The limit is pushed below the shuffle, so a hot key costs n rows per task.
    """
    if not keys:
        return df.orderBy(*order).limit(n)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def memory_recent(memory: DataFrame, project: str | None = None, user: str | None = None, limit: int = 200) -> DataFrame:
    """Newest memories of a scope; the limit is held to 1..1000."""
    rows = memory
    if project:
        rows = rows.filter(F.col("project_id") == project)
    if user:
        rows = rows.filter(F.col("user_id") == user)
    return last_n(rows, [], newest_first(), max(1, min(limit, 1000)))


def feedback_recent(
    feedback: DataFrame, project: str | None = None, user: str | None = None, limit: int = 200
) -> DataFrame:
    """Newest feedback of a scope; the limit is held to 1..5000."""
    rows = feedback
    if project:
        rows = rows.filter(F.col("project_id") == project)
    if user:
        rows = rows.filter(F.col("user_id") == user)
    return last_n(rows, [], [F.desc("seq")], max(1, min(limit, 5000)))


#: How many of the newest memories of a scope are searched at first, and how many next; the last search takes all the others.
DEPTHS = (1_000, 16_000)

_SCOPE = ["project_id", "user_id"]
_LEAN = [*_SCOPE, "id", "updated_at", "seq", "_row"]


def memory_search(requests: DataFrame, memory: DataFrame, limit: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """Newest memories of the request's project and user that hold one of its first six words.

    The newest ``limit`` of a union are the newest of each part's newest ``limit``, so every
    (scope, word) keeps ``limit`` rows before any request meets it, tasks of the matching among them; within a busy
    scope no request-memory pairs arise.  The newest memories of each scope are searched first: a request with a word that
    ``limit`` of them hold has its answer, as all others are older.  The words of other requests go on to older memories, in the
    end to all of them (``DEPTHS``).  Requests without words take the newest of their scope.  Until the last join
    rows are keys and times without contents.  ``carry``: columns of the requests that ride along.
    """
    limit = max(1, min(limit, 50))
    rows = stage(memory.withColumn("_row", F.monotonically_increasing_id()), "memories-searched")
    asked = stage(
        requests.select("request_id", *_SCOPE, F.array_distinct(text.query_words(F.col("prompt"), 6)).alias("words"))
        .dropna(subset=_SCOPE).withColumn("_ask", F.monotonically_increasing_id()),
        "memory-requests",
    )
    words = asked.select("request_id", "_ask", *_SCOPE, F.explode("words").alias("word"))

    depth, *deeper = DEPTHS
    newest = searched = _newest(rows, depth)
    wanted = words.select(*_SCOPE, "word").distinct()
    by_word = stage(_newest_holding(wanted, _of_scope(rows, searched), limit), "memories-by-word")
    for following in (*deeper, None):
        wanted = stage(_unanswered(words, by_word, _deep_scopes(searched, depth), limit), "words-unanswered")
        if wanted.isEmpty():
            break
        if following is None:
            older = rows.join(searched.select("_row"), "_row", "left_anti")
        else:
            before, depth = searched.select("_row"), following
            searched = _newest(rows, depth)
            older = _of_scope(rows, searched.join(before, "_row", "left_anti"))
        both = by_word.unionByName(_newest_holding(wanted, older, limit))
        by_word = stage(last_n(both, [*_SCOPE, "word"], newest_first(), limit), "memories-by-word")
    found = words.drop("_ask").join(by_word, [*_SCOPE, "word"]).drop("word").dropDuplicates(["request_id", "id"])

    wordless = asked.filter(F.size("words") == 0).drop("words", "_ask")
    by_scope = wordless.join(last_n(newest, _SCOPE, newest_first(), limit), _SCOPE)
    top = last_n(found.unionByName(by_scope.select(*found.columns)), ["request_id"], newest_first(), limit).select("request_id", "_row")
    if carry:
        top = top.join(requests.select("request_id", *carry), "request_id")
    return top.join(rows, "_row").drop("_row")


def _newest(rows: DataFrame, depth: int) -> DataFrame:
    """Keys and times of the newest ``depth`` memories of each scope."""
    raise_group_limit(rows.sparkSession, depth + 1)
    return stage(last_n(rows.select(*_LEAN).dropna(subset=_SCOPE), _SCOPE, newest_first(), depth), "memories-newest")


def _of_scope(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen rows, those of a scope in one task, which then keeps the best of a word once and not once a task."""
    return rows.join(chosen.select("_row"), "_row").repartition(*_SCOPE)


def _newest_holding(wanted: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` of ``rows`` that hold a word, for each (scope, word): one matcher row each."""
    scoped_words = wanted.select(
        F.to_json(F.struct(*_SCOPE, "word")).alias("request_id"), F.array("word").alias("terms"), F.concat_ws("\x01", *_SCOPE).alias("_scope"),
    )
    holding = lexical_match(
        scoped_words, rows.withColumn("_scope", F.concat_ws("\x01", *_SCOPE)), haystack=F.col("content"),
        scope="_scope", min_rel=0.0, keep=_LEAN, best=(limit, [("updated_at", "descending"), ("seq", "descending")]),
    ).withColumn("word", F.get_json_object("request_id", "$.word")).select(*_LEAN, "word")
    return last_n(holding, [*_SCOPE, "word"], newest_first(), limit)


def _deep_scopes(searched: DataFrame, depth: int) -> DataFrame:
    """Scopes that may have more memories than the ``depth`` searched."""
    return searched.groupBy(*_SCOPE).agg(F.count("*").alias("_n")).filter(F.col("_n") >= depth).drop("_n")


def _unanswered(words: DataFrame, by_word: DataFrame, scopes: DataFrame, limit: int) -> DataFrame:
    """The (scope, word) to look for in older memories of ``scopes``.

    A request with ``limit`` different memories by one word is answered, and a word with ``limit`` rows has its newest.
    """
    held = by_word.groupBy(*_SCOPE, "word").agg(F.count("*").alias("_rows"), F.size(F.collect_set("id")).alias("_ids"))
    of_request = words.join(held, [*_SCOPE, "word"], "left").groupBy("_ask", *_SCOPE).agg(
        F.max("_ids").alias("_most"), F.collect_set(F.when(F.coalesce("_rows", F.lit(0)) < limit, F.col("word"))).alias("_short")
    )
    left = of_request.filter(F.coalesce("_most", F.lit(0)) < limit).select(*_SCOPE, F.explode("_short").alias("word")).distinct()
    return left.join(scopes, _SCOPE, "left_semi")


def duplicate_memories(memory: DataFrame, limit: int = 500) -> DataFrame:
    """Rows to delete: among the newest ``limit`` per scope, all but the newest of equal text."""
    scope = ["project_id", "user_id"]
    recent = last_n(memory, scope, newest_first(), max(1, min(limit, 1000)))
    w = W.partitionBy(*scope, "_key").orderBy(*newest_first())
    return (
        recent.withColumn("_key", F.md5(text.squeeze(F.col("content"))))
        .withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > 1).drop("_key", "_n")
    )


def compact_memory(memory: DataFrame, limit: int = 500) -> DataFrame:
    """Memories without their duplicates."""
    return memory.join(duplicate_memories(memory, limit).select("id"), "id", "left_anti")


def memory_health(memory: DataFrame, *keys: str, limit: int = 300) -> DataFrame:
    """Scanned and low-confidence counts of the newest ``limit`` rows per scope."""
    recent = last_n(memory, list(keys), newest_first(), limit)
    return recent.groupBy(*keys).agg(
        F.count("*").alias("scanned_entries"),
        F.count_if(F.col("confidence") < 0.45).alias("low_confidence_entries"),
    )


def auto_memory(responses: DataFrame, now: Column, with_task_type: bool = False) -> DataFrame:
    """Memory rows remembered from answered requests (Q25)."""
    parts = [
        F.lit("Request: "), F.substr("prompt", F.lit(1), F.lit(600)),
        F.lit("\nResponse: "), F.substr("answer", F.lit(1), F.lit(1200)),
    ]
    tags = [F.lit("chat"), F.lit("auto")]
    if with_task_type:
        parts = [F.lit("TaskType: "), F.col("task_type"), F.lit("\n"), *parts]
        tags = [F.lit("task"), F.col("task_type"), F.lit("auto")]
    provenance = F.to_json(F.struct("trace_id", "selected_tier", "provider"))
    return responses.select(
        F.concat(F.lit("auto-"), "request_id").alias("id"),
        "project_id", "user_id", F.lit("episodic").alias("scope"),
        F.concat(*parts).alias("content"), F.array(*tags).alias("tags"),
        F.round(scoring.clip(F.col("confidence") - 0.05, 0.45, 0.90), 4).alias("confidence"),
        provenance.alias("provenance"), now.alias("created_at"), now.alias("updated_at"),
    )


def knowledge_search(requests: DataFrame, nodes: DataFrame, limit: int = 5) -> DataFrame:
    """Best knowledge nodes per request: word share times (.6 + .4 confidence).

    Tasks keep their best ids per request; whole nodes join for those that are left.
    """
    k = max(1, min(limit, 20))
    rows = stage(nodes.withColumn("_row", F.monotonically_increasing_id()), "knowledge-searched")
    haystack = F.concat_ws(
        " ", "title", "source_path", "summary", F.array_join("dependencies", " "), F.array_join("patterns", " ")
    )
    asked = requests.withColumn("_words", text.query_words(F.col("prompt")))
    sure = F.lit(0.6) + F.lit(0.4) * F.col("confidence")
    scored = lexical_match(
        asked, rows, haystack=haystack, terms="_words", min_rel=0.0, keep=["_row", "node_id", "confidence"], best=(k, "node_id"), weight=sure
    ).withColumn("score", F.col("relevance") * sure)
    w = W.partitionBy("request_id").orderBy(F.desc("score"), "node_id")
    # Staged, so that the planner knows how few rows it has.
    top = stage(scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("node_id", "confidence"), "knowledge-best")
    return rows.join(top, "_row").drop("_row")


def scope_knowledge(found: DataFrame, requests: DataFrame, artifact_root: str = ".artifacts", default: str = "default_workspace") -> DataFrame:
    """Knowledge rows a request may see: its own workspace tree, no noise paths.

    Requests of the default workspace see everything.
    """
    from ..functions.paths import is_noise_path

    prefix = F.lower(F.concat(F.lit(f"{artifact_root}/workspaces/"), "workspace_id", F.lit("/"), "project_id", F.lit("/")))
    asked = requests.select("request_id", "workspace_id", "project_id", "terms")
    path = F.translate("source_path", "\\", "/")
    own = (F.col("workspace_id") == default) | F.startswith(F.lower(path), prefix)
    return (
        found.join(asked, "request_id").filter(~is_noise_path(path, include_app=True) & own)
        .drop("workspace_id", "project_id")
    )
