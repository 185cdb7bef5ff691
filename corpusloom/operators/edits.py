"""Bulk text edits over a table of documents, with audit and undo."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules, text
from ..functions.paths import suffix_of

PATCHES = "array<struct<find:string,replace:string,replace_all:boolean,use_regex:boolean>>"


def normalize_target(target: Column) -> Column:
    """Relative path with forward slashes, or '' when absolute or escaping."""
    raw = text.strip(F.translate(text.strip(target), "\\", "/"))
    parts = F.filter(F.split(raw, "/"), lambda p: (p != "") & (p != "."))
    bad = (raw == "") | raw.rlike("^[A-Za-z]:") | raw.startswith("/") | F.array_contains(parts, "..")
    return F.when(bad, "").otherwise(F.array_join(parts, "/"))


def loose_path(value: Column) -> Column:
    """Path as the planner writes it: forward slashes, no leading ./ and no outer slashes."""
    return F.btrim(F.regexp_replace(text.strip(F.translate(value, "\\", "/")), r"^(\./)+", ""), F.lit("/"))


def edit_targets(requests: DataFrame, packets: DataFrame | None = None, max_actions: int = 8) -> DataFrame:
    """Ordered distinct targets per request: paths in the prompt, then chosen artifacts."""
    named = F.regexp_extract_all(text.strip(F.col("prompt")), F.lit(r"([A-Za-z0-9_./\\-]+\.[A-Za-z0-9]{1,10})"), F.lit(1))
    listed = requests.select("request_id", F.posexplode(named).alias("ord", "target")).withColumn("part", F.lit(0))
    if packets is not None:
        sources = F.filter(F.transform("selected", lambda s: s["source"]), lambda s: s.startswith("artifact:file:"))
        found = packets.select("request_id", F.posexplode(sources).alias("ord", "s")).select(
            "request_id", "ord", F.regexp_replace("s", "^artifact:file:", "").alias("target"), F.lit(1).alias("part")
        )
        listed = listed.unionByName(found)
    return distinct_targets(listed.withColumn("target", loose_path(F.col("target"))), max_actions)


def distinct_targets(listed: DataFrame, max_actions: int | None = None) -> DataFrame:
    """First occurrence of each target, renumbered, optionally capped."""
    first = listed.filter("target != ''").groupBy("request_id", "target").agg(
        F.min(F.struct("part", "ord")).alias("_at")
    )
    w = W.partitionBy("request_id").orderBy("_at")
    numbered = first.withColumn("position", F.row_number().over(w)).drop("_at")
    return numbered if max_actions is None else numbered.filter(F.col("position") <= max_actions)


def classify_type(prompt: Column) -> Column:
    """Edit type a prompt asks for."""
    low = F.lower(prompt)
    mentions_file = text.contains_any(low, ("file", "arquivo")) & text.contains_any(low, rules.CREATE_WORDS)
    return (
        F.when(text.contains_any(low, rules.DELETE_HINTS), "delete_file")
        .when(text.contains_any(low, rules.PATCH_HINTS), "patch_file")
        .when(text.contains_any(low, rules.CREATE_HINTS) | mentions_file, "create_file")
        .otherwise("update_file")
    )


def classify_risk(edit_type: Column, target: Column) -> Column:
    """Risk of an edit by type and target."""
    norm = F.lower(F.btrim(F.translate(target, "\\", "/"), F.lit("/")))
    return (
        F.when(edit_type == "delete_file", "critical")
        .when(norm.isin(*rules.HIGH_RISK_FILES), "high")
        .when(norm.startswith("app/") & norm.endswith(".py"), "high")
        .when(F.concat(F.lit("/"), norm, F.lit("/")).contains("/tests/"), "low")
        .when(suffix_of(norm).isin(*rules.LOW_RISK_EXTENSIONS), "low")
        .otherwise("medium")
    )


def validate_edits(
    edits: DataFrame, docs: DataFrame, *, blocked_prefixes: tuple[str, ...] = (), allow_high_risk: bool = False,
    allow_delete: bool = False, strict: bool = True, max_bytes: int = rules.MAX_FILE_BYTES,
) -> DataFrame:
    """Edits with normalized ``target``, ``issues`` and ``blocked``.

    ``docs`` has doc_path and size; only those two columns meet the edits.
    """
    rows = edits.withColumn("target", normalize_target(F.col("target"))).join(
        docs.select(F.col("doc_path").alias("target"), F.col("size").alias("_size")), "target", "left"
    )
    valid = F.col("target") != ""
    exists = F.col("_size").isNotNull()
    changes = F.col("type").isin("update_file", "patch_file")
    low = F.lower("target")
    blocked = F.lit(False)
    for prefix in (p.strip("/").lower() for p in blocked_prefixes):
        if prefix:
            blocked = blocked | (low == prefix) | low.startswith(prefix + "/")
    no_mutation = (F.coalesce(F.size("patches"), F.lit(0)) <= 0) & F.col("content").isNull()

    def issue(severity: str, code: str, message: Column | str) -> Column:
        return F.struct(
            F.lit(severity).alias("severity"), F.lit(code).alias("code"),
            (message if isinstance(message, Column) else F.lit(message)).alias("message"),
        )

    checks = [
        (~valid, issue("error", "invalid_target", "Target path is invalid, absolute, or escapes workspace root.")),
        (valid & blocked, issue("error", "blocked_target", F.concat(F.lit("Target path "), "target", F.lit(" is blocked by safety policy.")))),
    ]
    if not allow_delete:
        checks.append((valid & (F.col("type") == "delete_file"), issue("error", "delete_not_allowed", "Delete action is disabled by runtime settings.")))
    if not allow_high_risk:
        checks.append((valid & F.col("risk").isin("high", "critical"), issue("error", "high_risk_denied", "High risk action requires allow_high_risk=true.")))
    if strict:
        checks += [
            (valid & changes & ~exists, issue("error", "target_missing", "Update/Patch target file does not exist.")),
            (valid & changes & (F.col("_size") > max_bytes), issue("error", "file_too_large", f"Target exceeds max_file_bytes={max_bytes}.")),
            (valid & changes & no_mutation, issue("error", "missing_mutation", "Update/Patch action must include content or patches.")),
            (valid & (F.col("type") == "create_file") & F.col("content").isNull(), issue("warning", "empty_create_content", "Create action has no content and will use generated placeholder.")),
            (valid & (F.col("type") == "delete_file") & ~exists, issue("warning", "delete_target_missing", "Delete target file does not exist.")),
        ]
    issues = F.array_compact(F.array(*[F.when(cond, item) for cond, item in checks]))
    return (
        rows.withColumn("issues", issues)
        .withColumn("blocked", F.exists("issues", lambda i: i["severity"] == "error"))
        .drop("_size")
    )


def validation_issues(validated: DataFrame) -> DataFrame:
    """One row per issue."""
    return validated.select("plan_id", "step_id", F.inline("issues"))


def _replace_literal(body: Column, patch: Column) -> Column:
    at = F.position(patch["find"], body)
    first = F.concat(
        F.substr(body, F.lit(1), at - 1), patch["replace"], F.substr(body, at + F.length(patch["find"]))
    )
    return F.when(at == 0, body).when(patch["replace_all"], F.replace(body, patch["find"], patch["replace"])).otherwise(first)


_PATCHED = T.StructType(
    [T.StructField("content", T.StringType()), T.StructField("matched", T.BooleanType())]
)


@F.pandas_udf(_PATCHED)
def _patch_with_regex(bodies: pd.Series, patches: pd.Series) -> pd.DataFrame:
    """Patch lists holding regular expressions, in the dialect the patches are written in."""
    out = []
    for body, steps in zip(bodies, patches):
        matched, body_before = False, body
        for step in steps if body is not None and steps is not None else ():
            if step["use_regex"]:
                try:
                    body, n = re.subn(step["find"], step["replace"], body, count=0 if step["replace_all"] else 1)
                except (re.error, IndexError):  # a bad pattern fails this edit, not the job
                    body, matched = body_before, False
                    break
            else:
                n = int(step["find"] in body)
                body = body.replace(step["find"], step["replace"], -1 if step["replace_all"] else 1)
            matched = matched or n > 0
        out.append((body, matched))
    return pd.DataFrame(out, columns=["content", "matched"])


def patch_text(body: Column, patches: Column) -> Column:
    """Struct(content, matched) after applying the patches in order.

    Literal lists stay in the JVM; only texts with a regular-expression patch go through
    Arrow.
    """
    needs_regex = F.exists(patches, lambda p: p["use_regex"])
    start = F.struct(body.alias("content"), F.lit(False).alias("matched"))
    literal = F.aggregate(
        patches, start,
        lambda state, p: F.struct(
            _replace_literal(state["content"], p).alias("content"),
            (state["matched"] | F.contains(state["content"], p["find"])).alias("matched"),
        ),
    )
    by_regex = _patch_with_regex(F.when(needs_regex, body), F.when(needs_regex, patches))
    return F.when(needs_regex, by_regex).otherwise(literal)


def apply_edits(validated: DataFrame, docs: DataFrame, *, dry_run: bool = False, max_bytes: int = rules.MAX_FILE_BYTES) -> DataFrame:
    """Result of every edit: status, message, text before and after.

    One edit per target; several edits of one document come as one list of patches.  ``docs``
    has doc_path and content.  Only documents that are a target are joined.
    """
    rows = validated.join(
        docs.select(F.col("doc_path").alias("target"), F.col("content").alias("before")), "target", "left"
    )
    exists = F.col("before").isNotNull()
    changes = F.col("type").isin("update_file", "patch_file")
    has_patches = F.coalesce(F.size("patches"), F.lit(0)) > 0
    patched = F.when(changes & exists & F.col("content").isNull() & has_patches, patch_text(F.col("before"), F.col("patches")))
    placeholder = F.concat(F.lit("# Auto-generated\n# Intent: "), F.substr("intent", F.lit(1), F.lit(200)), F.lit("\n"))
    rows = rows.withColumn("_p", patched).withColumn(
        "after",
        F.when(F.col("type") == "create_file", F.coalesce("content", placeholder))
        .when(changes, F.coalesce("content", F.col("_p.content"))),
    )
    too_large = F.octet_length("after") > max_bytes
    outcome = (
        F.when(F.col("blocked"), F.struct(F.lit("skipped").alias("s"), F.lit("Blocked by validation policy.").alias("m")))
        .when(F.lit(dry_run), F.struct(F.lit("planned").alias("s"), F.lit("Dry run only. No file changes were applied.").alias("m")))
        .when((F.col("type") == "create_file") & exists, _outcome("skipped", "Target already exists."))
        .when(changes & ~exists, _outcome("failed", "Target file does not exist."))
        .when(changes & F.col("content").isNull() & ~has_patches, _outcome("failed", "No content or patches were provided."))
        .when(changes & F.col("content").isNull() & ~F.col("_p.matched"), _outcome("failed", "Execution failed: Patch patterns did not match file contents."))
        .when(changes & (F.col("after") == F.col("before")), _outcome("skipped", "Patch did not change file contents."))
        .when((F.col("type") != "delete_file") & too_large, _outcome("failed", f"Execution failed: content exceeds max_file_bytes={max_bytes}"))
        .when((F.col("type") == "delete_file") & ~exists, _outcome("skipped", "File already missing."))
        .when(F.col("type") == "create_file", _outcome("applied", "File created."))
        .when(F.col("type") == "delete_file", _outcome("applied", "File deleted."))
        .otherwise(_outcome("applied", "File updated."))
    )
    operation = F.when(F.col("type") == "create_file", "create").when(F.col("type") == "delete_file", "delete").otherwise("update")
    return (
        rows.withColumn("_o", outcome).withColumns({"status": F.col("_o.s"), "message": F.col("_o.m")})
        .withColumn("op", F.when(F.col("status") == "applied", operation)).drop("_o", "_p")
    )


def _outcome(status: str, message: str) -> Column:
    return F.struct(F.lit(status).alias("s"), F.lit(message).alias("m"))


def stop_after_failure(results: DataFrame, auto_rollback: bool = False) -> DataFrame:
    """Steps after a plan's first raised failure do not run; optionally its changes roll back (E5)."""
    raised = (F.col("status") == "failed") & F.col("message").startswith("Execution failed")
    first = results.groupBy("plan_id").agg(F.min(F.when(raised, F.col("ord"))).alias("_first"))
    kept = results.join(first, "plan_id").filter(F.col("_first").isNull() | (F.col("ord") <= F.col("_first")))
    if auto_rollback:
        undone = F.col("_first").isNotNull() & (F.col("status") == "applied")
        kept = kept.withColumn("message", F.when(undone, "Rolled back due to execution failure in the plan.").otherwise(F.col("message"))).withColumn(
            "status", F.when(undone, "rolled_back").otherwise(F.col("status"))
        )
    return kept.drop("_first")


def edit_audit(results: DataFrame) -> DataFrame:
    """Before-image rows of the applied edits (E5)."""
    return results.filter(F.col("status") == "applied").select("plan_id", "step_id", "ord", "op", "target", "before", "after")


def edit_report(results: DataFrame) -> DataFrame:
    """Counts per plan and status (E5)."""
    return results.groupBy("plan_id").agg(
        F.count_if(F.col("status") == "applied").alias("applied"),
        F.count_if(F.col("status").isin("skipped", "planned")).alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def edited_documents(docs: DataFrame, audit: DataFrame) -> DataFrame:
    """Documents after the applied edits: last after-image wins, deletions drop out."""
    last = audit.groupBy(F.col("target").alias("doc_path")).agg(F.max_by(F.struct("op", "after"), "ord").alias("_l"))
    return (
        docs.join(last, "doc_path", "full")
        .filter(F.col("_l").isNull() | (F.col("_l.op") != "delete"))
        .withColumn("content", F.coalesce("_l.after", "content")).drop("_l")
    )


def rollback_edits(docs: DataFrame, audit: DataFrame) -> DataFrame:
    """Documents restored to their first before-image; created ones removed."""
    first = audit.groupBy(F.col("target").alias("doc_path")).agg(F.min_by(F.struct("op", "before"), "ord").alias("_f"))
    return (
        docs.join(first, "doc_path", "full")
        .filter(F.col("_f").isNull() | (F.col("_f.op") != "create"))
        .withColumn("content", F.coalesce("_f.before", "content")).drop("_f")
    )


def decide(
    steps: DataFrame, *, mode: str = "autopilot", block_critical: bool = True, allow_high_risk: bool = False,
    auto_medium: bool = False, auto_low: bool = True,
) -> DataFrame:
    """Execution decision per plan.

    ``steps`` has plan_id, type, risk, content, patches; a plan without steps has one row
    whose type is null.
    """
    levels = F.create_map(*[F.lit(x) for pair in rules.RISK_LEVELS.items() for x in pair])
    unwritten = (
        F.col("type").isin("update_file", "patch_file") & F.col("content").isNull()
        & (F.coalesce(F.size("patches"), F.lit(0)) <= 0)
    )
    plans = steps.groupBy("plan_id").agg(
        F.count("type").alias("n"), F.coalesce(F.max(F.try_element_at(levels, F.col("risk"))), F.lit(1)).alias("level"),
        F.bool_or(F.coalesce(unwritten, F.lit(False))).alias("unwritten"),
    )
    level = F.col("level")
    approval, blocked = "requires_approval", "blocked"
    critical = (
        _outcome(blocked, "Critical-risk plan blocked by policy.") if block_critical
        else _outcome(approval, "Critical-risk plan requires explicit human approval.")
    )
    high = (
        _outcome(approval, "High-risk actions require explicit confirmation.") if allow_high_risk
        else _outcome(blocked, "High-risk actions blocked unless allow_high_risk=true.")
    )
    decision = (
        F.when(F.col("n") == 0, _outcome(blocked, "Planner produced no actions."))
        .when(F.col("unwritten"), _outcome(approval, "Planned mutations require explicit diff/content authoring before execution."))
        .when(level == 4, critical)
        .when(F.lit(mode == "manual"), _outcome(approval, "Manual mode requires explicit approval before execution."))
        .when(level == 3, high)
        .when((level == 2) & F.lit(not auto_medium), _outcome(approval, "Medium-risk actions require approval by current policy."))
        .when((level == 1) & F.lit(not auto_low), _outcome(approval, "Low-risk auto-execution disabled by policy."))
        .otherwise(_outcome("auto_execute", "Autopilot policy authorized execution for current risk profile."))
    )
    names = F.create_map(*[F.lit(x) for name, rank in rules.RISK_LEVELS.items() for x in (rank, name)])
    return plans.withColumn("_d", decision).select(
        "plan_id", F.col("_d.s").alias("state"), F.element_at(names, level).alias("highest_risk"),
        (F.col("_d.s") == "auto_execute").alias("execute_now"), F.col("_d.m").alias("reason"),
    )


def patches_match(edits: DataFrame, docs: DataFrame) -> DataFrame:
    """Edits with ``matches``: whether content or any patch would take effect."""
    rows = edits.withColumn("target", normalize_target(F.col("target"))).join(
        docs.select(F.col("doc_path").alias("target"), F.col("content").alias("_body")), "target", "left"
    )
    hit = F.exists("patches", lambda p: ~p["use_regex"] & F.contains(F.col("_body"), p["find"]))
    needs_regex = F.exists("patches", lambda p: p["use_regex"])
    by_regex = _any_regex_hit(F.when(needs_regex, F.col("_body")), F.when(needs_regex, F.col("patches")))
    found = F.coalesce(hit, F.lit(False)) | F.coalesce(by_regex, F.lit(False))
    return rows.withColumn("matches", F.col("content").isNotNull() | (F.col("_body").isNotNull() & found)).drop("_body")


@F.pandas_udf(T.BooleanType())
def _any_regex_hit(bodies: pd.Series, patches: pd.Series) -> pd.Series:
    def hit(body, steps) -> bool:
        for step in steps if body is not None and steps is not None else ():
            if not step["use_regex"]:
                continue
            try:
                if re.search(step["find"], body):
                    return True
            except re.error:
                continue
        return False

    return pd.Series([hit(b, s) for b, s in zip(bodies, patches)], dtype="boolean")


def duplicate_plans(plans: DataFrame) -> DataFrame:
    """Plan rows with signature and whether it was seen earlier in the run.

    ``plans`` has run_id, iteration and steps, an array of (type, target, intent).
    """
    signature = F.array_join(
        F.transform("steps", lambda s: F.concat_ws(":", s["type"], s["target"], F.substr(s["intent"], F.lit(1), F.lit(120)))), "|"
    )
    signed = plans.withColumn("signature", signature)
    first = signed.groupBy("run_id", "signature").agg(F.min("iteration").alias("_first"))
    return signed.join(first, ["run_id", "signature"]).withColumn(
        "is_duplicate", F.col("iteration") > F.col("_first")
    ).drop("_first")


def prioritize_targets(targets: DataFrame, rules_table: list[tuple[str, int]], prompt_applies: Column) -> DataFrame:
    """Only the best-ranked target where the prompt applies and some rule fires, else all.

    ``rules_table`` lists (pattern over the lower-cased path, priority); the first match counts.
    """
    low = F.lower(F.translate("target", "\\", "/"))
    priority = None
    for pattern, value in rules_table:
        cond = low.rlike(pattern)
        priority = F.when(cond, value) if priority is None else priority.when(cond, value)
    ranked = targets.withColumn("priority", F.when(prompt_applies, priority.otherwise(0)).otherwise(0))
    best = ranked.groupBy("request_id").agg(
        F.max("priority").alias("_top"), F.max_by("position", F.struct("priority", -F.col("position"))).alias("_at")
    )
    return ranked.join(best, "request_id").filter(
        (F.col("_top") <= 0) | (F.col("position") == F.col("_at"))
    ).drop("_top", "_at")


def parse_rate(prompt: Column) -> Column:
    """Number a prompt sets a rate to, as written, else null."""
    low = F.lower(prompt)
    number = r"(\d+(?:\.\d+)?)"
    explicit = F.regexp_extract(low, rf"(?:rate|taxa|parametro|par[âa]metro)\D{{0,20}}(?:para|to|=)\s*{number}", 1)
    generic = F.regexp_extract(low, rf"(?:para|to|=)\s*{number}", 1)
    numbers = F.regexp_extract_all(low, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    last = F.when(F.size(numbers) > 0, F.element_at(numbers, -1))
    return F.coalesce(F.when(explicit != "", explicit), F.when(generic != "", generic), last)


def is_increment(prompt: Column) -> Column:
    """Whether a prompt asks to add to a value."""
    low = F.lower(prompt)
    verbs = r"(?:aumenta|aumente|increase|add|somar|soma|incrementa|increment)\D{0,20}(?:em|by|\+)\s*\d+(?:\.\d+)?"
    return low.rlike(r"\+\s*\d+(?:\.\d+)?") | low.rlike(verbs)
