"""Quality rates, failure taxonomies, feedback summaries, reflection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.routing import quality_gate
from .memory import last_n, newest_first

RETRIEVAL, ROUTE, FEEDBACK = "retrieval.assembly", "route.decision", "cognitive.feedback"


def kpi_parts() -> dict[str, Column]:
    """The sums that the quality report is made of, over trace rows; parts of disjoint rows merge by adding."""
    p = lambda name: F.col(f"payload.{name}")
    retrieval, route, feedback = (F.col("event_type") == k for k in (RETRIEVAL, ROUTE, FEEDBACK))
    score = F.coalesce(p("retrieval.avg_context_score"), F.lit(0.0))
    contexts = F.coalesce(p("retrieval.context_count"), F.lit(0))
    dropped = F.coalesce(p("retrieval.dropped_by_budget"), F.lit(0))
    max_chars = F.coalesce(p("retrieval.max_chars"), F.lit(0))
    confidence = F.coalesce(p("confidence"), F.lit(0.0))
    utilization = F.when(max_chars > 0, F.coalesce(p("retrieval.used_chars"), F.lit(0)) / max_chars).otherwise(0.0)
    drop_rate = dropped / F.greatest(F.lit(1), dropped + contexts)
    efficiency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), utilization * (F.lit(1.0) - drop_rate)))
    verdict = F.lower(text.strip(F.coalesce(p("verdict"), F.lit(""))))

    def hits(kind: Column, hit: Column) -> Column:
        return F.count_if(kind & F.coalesce(hit, F.lit(False)))

    def total(kind: Column, value: Column, nothing: Column) -> Column:
        return F.coalesce(F.sum(F.when(kind, F.coalesce(value, nothing))), nothing)

    def has_issue(issue: str) -> Column:
        return F.exists(p("issues"), lambda i: F.lower(text.strip(i)) == issue)

    none, zero = F.lit(0), F.lit(0.0)
    return {
        "sample_size": F.count("*"),
        "retrieval_samples": F.count_if(retrieval),
        "route_samples": F.count_if(route),
        "feedback_samples": F.count_if(feedback),
        "retrieval_precision": total(retrieval, score, zero),
        "hallucination_rate": hits(route, (confidence >= 0.82) & ((score < 0.25) | (contexts == 0))),
        "stale_context_rate": hits(retrieval, F.exists(p("risks"), lambda r: F.lower(r).contains("stale"))),
        "architectural_consistency": hits(
            retrieval, (F.coalesce(p("dependencies_count"), none) == 0) | (F.coalesce(F.size(p("relevant_systems")), none) > 0)
        ),
        "token_efficiency": total(route, efficiency, zero),
        "reasoning_success": hits(route, (confidence >= 0.75) & ~F.lower(F.coalesce(p("reason"), F.lit(""))).contains("fallback-local")),
        **{f"feedback_{v}_rate": hits(feedback, verdict == v) for v in rules.VERDICTS},
        **{f"feedback_{i}_rate": hits(feedback, has_issue(i)) for i in rules.KPI_ISSUES},
        "total_cost_usd": total(route, p("usage.cost_usd").cast("decimal(28,12)"), none.cast("decimal(28,12)")),
        **{name: total(route, p(f"usage.{name}"), none) for name in ("prompt_tokens", "completion_tokens", "total_tokens")},
    }


def kpi_report(part: Callable[[str], Column]) -> list[Column]:
    """The quality report from its parts, whatever they were added up from; 0 for a kind without events."""

    def share(metric: str, kind: str) -> Column:
        return F.round(F.coalesce(part(metric) / F.nullif(part(f"{kind}_samples"), F.lit(0)), F.lit(0.0)), 4).alias(metric)

    return [
        *[part(name).alias(name) for name in ("sample_size", "retrieval_samples", "route_samples")],
        share("retrieval_precision", "retrieval"), share("hallucination_rate", "route"), share("stale_context_rate", "retrieval"),
        share("architectural_consistency", "retrieval"), share("token_efficiency", "route"), share("reasoning_success", "route"),
        *[share(f"feedback_{name}_rate", "feedback") for name in (*rules.VERDICTS, *rules.KPI_ISSUES)],
        F.round(part("total_cost_usd").cast("double"), 6).alias("total_cost_usd"),
        *[part(name).cast("double").alias(name) for name in ("prompt_tokens", "completion_tokens", "total_tokens")],
    ]


def kpi_columns() -> list[Column]:
    """Aggregates of the quality report over trace rows, in one pass."""
    return kpi_report(kpi_parts().__getitem__)


def merged_kpis(parts: DataFrame, *keys: str) -> DataFrame:
    """Reports from rows of parts, added up per key."""
    summed = parts.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in kpi_parts()])
    return summed.select(*keys, *kpi_report(F.col))


def scoped_traces(traces: DataFrame, project: str | None = None, user: str | None = None) -> DataFrame:
    """Trace rows with a payload, of one project and user if given."""
    rows = traces.filter("payload is not null")
    if project is not None:
        rows = rows.filter(F.col("payload.project_id") == project)
    if user is not None:
        rows = rows.filter(F.col("payload.user_id") == user)
    return rows


def evaluate(
    traces: DataFrame, *keys: str, limit: int = 300, project: str | None = None, user: str | None = None
) -> DataFrame:
    """Quality report over the last ``limit`` scoped traces; all of them when 0.

    With ``keys`` (columns, such as project_id) one report per key.
    """
    rows = scoped_traces(traces, project, user)
    if limit > 0:
        rows = last_n(rows, list(keys), [F.desc("seq")], limit)
    report = rows.groupBy(*keys).agg(*kpi_columns())
    return report.withColumn("notes", evaluation_notes()).withColumn(
        "gate", quality_gate(F.col("hallucination_rate"), F.col("stale_context_rate"), F.col("retrieval_precision"))
    )


def evaluation_notes() -> Column:
    """Findings by thresholds."""
    notes = text.labels_where(
        (F.col("sample_size") < 40, "Low sample size; evaluation confidence is limited."),
        (F.col("stale_context_rate") >= 0.30, "High stale-context rate detected."),
        (F.col("hallucination_rate") >= 0.20, "Potential hallucination pressure detected in high-confidence responses."),
        (F.col("token_efficiency") <= 0.40, "Low token efficiency; context compression and ranking should be tuned."),
        (F.col("feedback_incorrect_rate") >= 0.25, "User feedback indicates high incorrect-response rate."),
        (F.col("feedback_xml_missing_rate") >= 0.20, "Frequent XML-missing reports detected; XML ranking should be boosted."),
        (F.col("feedback_hallucination_rate") >= 0.15, "Frequent hallucination reports detected from daily usage feedback."),
    )
    clean = F.array(F.lit("Evaluation completed without critical degradation signals."))
    return F.when(F.size(notes) == 0, clean).otherwise(notes)


def failure_conditions() -> dict[str, Column]:
    """When a usage record counts towards a failure type."""
    selected = F.coalesce("selected_count", F.lit(0))
    dropped = F.coalesce("compression.dropped_count", F.lit(0))
    systems = F.coalesce(F.size("relevant_systems"), F.lit(0))
    noisy = F.size(F.filter("dependencies", lambda d: F.lower(d).startswith("classic-")))
    talk = F.size(F.filter(F.slice("top_sources", 1, 6), lambda s: F.lower(s).contains("talkactions")))
    return {
        "xml_missing": F.col("xml_focus") & ~F.col("xml_selected"),
        "wrong_module": (systems <= 1) & (selected >= 5),
        "wrong_generation": F.lit(False),
        "stale_summary": F.exists("risks", lambda r: F.lower(r).contains("stale")),
        "dependency_noise": noisy >= 25,
        "graph_underexpansion": selected == 0,
        "graph_overexpansion": systems >= 12,
        "compression_loss": (dropped >= 1800) & (selected <= 8),
        "ranking_collision": (talk >= 4) & F.col("xml_focus"),
        "semantic_misdirection": selected == 0,
    }


def failure_counts(usage: DataFrame) -> DataFrame:
    """(failure_type, count) over usage records, zeros included."""
    conditions = failure_conditions()
    wide = usage.agg(*[F.count_if(F.coalesce(conditions[t], F.lit(False))).alias(t) for t in rules.FAILURE_TYPES])
    return wide.unpivot([], list(rules.FAILURE_TYPES), "failure_type", "count")


def issue_counts(feedback: DataFrame, *keys: str) -> DataFrame:
    """(issue, count) over feedback rows."""
    return feedback.select(*keys, F.explode("issues").alias("issue")).groupBy(*keys, "issue").agg(
        F.count("*").alias("count")
    )


def diagnose(failures: DataFrame, feedback: DataFrame) -> DataFrame:
    """Failure counts with the mapped feedback issues added."""
    table = F.create_map(*[F.lit(x) for pair in rules.ISSUE_TO_FAILURE.items() for x in pair])
    mapped = issue_counts(feedback).select(
        F.try_element_at(table, F.col("issue")).alias("failure_type"), "count"
    ).filter("failure_type is not null")
    return failures.unionByName(mapped).groupBy("failure_type").agg(F.sum("count").alias("count"))


def recommendations(diagnosis: DataFrame) -> DataFrame:
    """Recommendations for the failure types that occur, in order."""
    fired = diagnosis.agg(
        text.labels_where(
            *[(F.max(F.when(F.col("failure_type") == t, F.col("count"))) > 0, advice) for t, advice in rules.RECOMMENDATIONS]
        ).alias("advice")
    )
    chosen = F.when(F.size("advice") == 0, F.array(F.lit(rules.NO_RECOMMENDATION))).otherwise(F.col("advice"))
    return fired.select(F.posexplode(chosen).alias("ord", "recommendation"))


def feedback_summary(feedback: DataFrame, *keys: str, limit: int = 500) -> DataFrame:
    """Totals and verdict counts, zeros included, of the newest ``limit`` per scope (A10)."""
    recent = last_n(feedback, list(keys), [F.desc("seq")], max(1, min(limit, 5000)))
    return recent.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in rules.VERDICTS],
    )


def top_counts(counts: DataFrame, k: int, name: str) -> DataFrame:
    """First ``k`` by count, then name (T5)."""
    return counts.orderBy(F.desc("count"), name).limit(k)


def top_issues(feedback: DataFrame, k: int = 8, limit: int = 500) -> DataFrame:
    """Most frequent issues of the newest ``limit`` feedback rows (A10, T5)."""
    recent = last_n(feedback, [], [F.desc("seq")], max(1, min(limit, 5000)))
    return top_counts(issue_counts(recent), k, "issue")


def usage_summary(usage: DataFrame) -> DataFrame:
    """Totals of a workload run (A11).  Domains are counted here and listed by usage_domains."""
    domains = usage.groupBy("domain").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status_code") == 200).alias("ok"),
        F.count_if("xml_focus").alias("xml"),
        F.count_if(F.col("xml_focus") & F.col("xml_selected")).alias("xml_hit"),
    )
    total, ok = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("ok"), F.lit(0))
    return domains.agg(
        total.alias("total_queries"),
        ok.alias("successful_queries"),
        F.greatest(F.lit(0).cast("long"), total - ok).alias("failed_queries"),
        F.coalesce(F.sum("xml"), F.lit(0)).alias("xml_focused_queries"),
        F.coalesce(F.sum("xml_hit"), F.lit(0)).alias("xml_focused_with_xml_selected"),
        F.count("*").alias("domain_count"),
    )


def usage_domains(usage: DataFrame) -> DataFrame:
    return usage.select("domain").distinct().orderBy("domain")


def usage_records(packets: DataFrame, requests: DataFrame) -> DataFrame:
    """Usage rows of a retrieval run, as the daily workload stores them (K8)."""
    sources = F.transform("selected", lambda s: s["source"])
    return packets.join(requests.select("request_id", "prompt", "xml_focus"), "request_id").select(
        "request_id", "prompt", F.lit(200).alias("status_code"), "selected_count",
        F.slice(sources, 1, 12).alias("top_sources"),
        F.struct("selected_count", "dropped_count", "max_chars", "used_chars").alias("compression"),
        "xml_focus", F.exists(sources, lambda s: F.lower(s).endswith(".xml")).alias("xml_selected"),
        *[c for c in ("risks", "relevant_systems", "dependencies") if c in packets.columns],
    )


def reflection_notes(
    memory: DataFrame, removed: DataFrame, drift: DataFrame | None, feedback: DataFrame | None, diagnosis: DataFrame | None
) -> DataFrame:
    """One row with the counts and notes of a reflection cycle.

    Every input is reduced to one row or a short top list before it is combined.
    """
    def listed(top: DataFrame, name: str, column: str) -> DataFrame:
        item = F.struct((-F.col("count")).alias("n"), F.col(name).alias("name"))
        rendered = F.transform(
            F.array_sort(F.collect_list(item)), lambda i: F.concat_ws(":", i["name"], (-i["n"]).cast("string"))
        )
        return top.agg(F.array_join(rendered, ", ").alias(column))

    facts = [
        last_n(memory, [], newest_first(), 300).agg(
            F.count("*").alias("scanned_entries"),
            F.count_if(F.col("confidence") < 0.45).alias("low_confidence_entries"),
        ),
        removed.agg(F.count("*").alias("duplicates_removed")),
    ]
    if drift is not None:
        facts.append(drift.agg(F.coalesce(F.sum("drift"), F.lit(0)).alias("drift")))
    if feedback is not None:
        recent = last_n(feedback, [], [F.desc("seq")], 400)
        facts.append(recent.agg(F.count("*").alias("feedback_total")))
        facts.append(listed(top_counts(issue_counts(recent), 4, "issue"), "issue", "issues"))
    if diagnosis is not None:
        seen = diagnosis.filter(F.col("count") > 0)
        facts.append(listed(top_counts(seen, 4, "failure_type"), "failure_type", "failures"))
        advice = F.array_sort(F.collect_list(F.struct("ord", "recommendation")))
        facts.append(
            recommendations(diagnosis).filter("ord < 3")
            .agg(F.transform(advice, lambda r: r["recommendation"]).alias("advice"))
        )
    # Each fact is one row with columns of its own; stacking them needs no join.
    stacked = facts[0]
    for fact in facts[1:]:
        stacked = stacked.unionByName(fact, allowMissingColumns=True)
    one = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    defaults = {
        "drift": F.lit(0), "feedback_total": F.lit(0), "issues": F.lit(""), "failures": F.lit(""),
        "advice": F.array().cast("array<string>"),
    }
    one = one.withColumns(
        {name: F.coalesce(name, default) if name in one.columns else default for name, default in defaults.items()}
    )

    def count_note(before: str, column: str, after: str) -> Column:
        return F.concat(F.lit(before), F.col(column).cast("string"), F.lit(after))

    notes = F.concat(
        text.labels_where(
            (F.col("duplicates_removed") > 0, count_note("Removed ", "duplicates_removed", " duplicate memory entries.")),
            (F.col("low_confidence_entries") > 0, count_note("Found ", "low_confidence_entries", " low-confidence entries for review.")),
            (F.col("drift") > 0, count_note("Detected ", "drift", " potential stale knowledge nodes; run /v1/knowledge/sync.")),
            (F.col("feedback_total") > 0, count_note("Analyzed ", "feedback_total", " cognitive feedback entries.")),
            ((F.col("feedback_total") > 0) & (F.col("issues") != ""), F.concat(F.lit("Top feedback issues: "), "issues", F.lit("."))),
            (F.col("failures") != "", F.concat(F.lit("Calibration failures: "), "failures", F.lit("."))),
        ),
        F.transform("advice", lambda a: F.concat(F.lit("Calibration recommendation: "), a)),
    )
    quiet = F.array(F.lit("No anomalies detected in this cycle."))
    return one.withColumn("notes", F.when(F.size(notes) == 0, quiet).otherwise(notes)).select(
        "scanned_entries", "duplicates_removed", "low_confidence_entries", "notes"
    )


def reflection_memory(report: DataFrame, now: Column, task_id: str, project: str = "global", user: str = "system") -> DataFrame:
    """Memory row that records a reflection cycle."""
    body = F.array_join(F.transform("notes", lambda n: F.concat(F.lit("- "), n)), "\n")
    return report.select(
        F.lit(f"reflection-{task_id}").alias("id"), F.lit(project).alias("project_id"), F.lit(user).alias("user_id"),
        F.lit("project").alias("scope"), F.concat(F.lit("Reflection summary\n"), body).alias("content"),
        F.array(F.lit("reflection"), F.lit("summary")).alias("tags"), F.lit(0.72).alias("confidence"),
        F.to_json(F.struct(F.lit(task_id).alias("task_id"), "scanned_entries")).alias("provenance"),
        now.alias("created_at"), now.alias("updated_at"),
    )
