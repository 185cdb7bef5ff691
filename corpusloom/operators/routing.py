"""Requests against tiers, prices and observed responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import routing, rules, text


def tier_table(spark: SparkSession, tiers=rules.TIERS) -> DataFrame:
    """The fixed tier list as a frame."""
    return spark.createDataFrame(
        list(tiers),
        "tier_rank int, tier string, cost_floor double, confidence_target double, input_rate double, output_rate double",
    )


def lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join to a dimension; the optimiser broadcasts it if it is small."""
    return df.join(dim, key, "left")


def request_tokens(requests: DataFrame, snippets: DataFrame, key: str = "request_id") -> DataFrame:
    """Words of the prompt and of its context snippets, and the snippet count (Q20).

    ``key`` is what requests and snippets have in common.  Requests that share their snippets, as the turns of a conversation do, share a
    key: words are added up once per key and no request meets a snippet.
    """
    per_key = snippets.groupBy(key).agg(
        F.sum(text.word_count(F.col("content"))).alias("_words"), F.count("*").alias("n_snippets")
    )
    return (
        requests.join(per_key, key, "left")
        .withColumn("tokens", text.word_count(F.col("prompt")) + F.coalesce("_words", F.lit(0)))
        .withColumn("n_snippets", F.coalesce("n_snippets", F.lit(0))).drop("_words")
    )


def estimate_cost(requests: DataFrame, snippets: DataFrame, tiers: DataFrame, key: str = "request_id") -> DataFrame:
    """Estimated cost of every request at every tier (Q20)."""
    ladder = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(tiers.columns, r)]) for r in tiers.collect()])
    return (
        request_tokens(requests, snippets, key).withColumn("t", F.explode(ladder)).select("*", "t.*").drop("t")
        .withColumn(
            "estimated_cost_usd",
            routing.request_cost(F.col("tokens"), F.col("cost_floor"), F.col("input_rate"), F.col("output_rate")),
        )
    )


def start_tiers(requests: DataFrame) -> DataFrame:
    """Requests with start_tier and start_reason (Q17, Q18).

    Expects prompt, tier_hint, has_retrieval, intent, n_dependencies, n_risks, n_contexts
    and n_snippets.
    """
    decision = routing.start_tier(
        F.col("prompt"), tier_hint=F.col("tier_hint"), has_retrieval=F.col("has_retrieval"), intent=F.col("intent"),
        n_dependencies=F.col("n_dependencies"), n_risks=F.col("n_risks"), n_contexts=F.col("n_contexts"),
        n_snippets=F.col("n_snippets"),
    )
    return (
        requests.withColumn("_d", decision)
        .withColumn("start_tier", F.col("_d.tier")).withColumn("start_reason", F.col("_d.reason")).drop("_d")
    )


def served_tier(
    requests: DataFrame, costs: DataFrame, responses: DataFrame, *, budget: float = rules.REQUEST_BUDGET_USD,
    depth: int = rules.MAX_ESCALATION_DEPTH,
) -> DataFrame:
    """Tier that serves each request, from logged response confidences per tier (Q21).

    ``requests`` has request_id and start_tier; ``costs`` is :func:`estimate_cost`;
    ``responses`` has request_id, tier and confidence, and a missing row means that the tier
    was unavailable.  Tiers are tried upwards from the start, at most ``depth`` steps; a tier
    over budget ends the climb; a confidence under the tier's target moves on unless it is
    the last step.  Without a serving tier the local fallback answers.
    """
    start = requests.select("request_id", "start_tier")
    ladder = costs.select("request_id", "tier", "tier_rank", "estimated_cost_usd", "confidence_target")
    first = ladder.join(start, "request_id").groupBy("request_id").agg(
        F.max(F.when(F.col("tier") == F.col("start_tier"), F.col("tier_rank"))).alias("_from"),
        F.max("tier_rank").alias("_top"),
    )
    steps = (
        ladder.join(first, "request_id").filter(F.col("tier_rank") >= F.col("_from"))
        .withColumn("step", F.col("tier_rank") - F.col("_from"))
        .withColumn("last", F.least(F.lit(depth), F.col("_top") - F.col("_from")))
        .filter(F.col("step") <= F.col("last"))
        .join(responses.select("request_id", "tier", "confidence"), ["request_id", "tier"], "left")
    )
    over = (F.col("tier") != "local") & (F.col("estimated_cost_usd") > budget)
    climb = W.partitionBy("request_id").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = steps.withColumn("_stopped", F.max(over.cast("int")).over(climb) == 1)
    serves = (
        ~F.col("_stopped") & F.col("confidence").isNotNull()
        & ((F.col("step") >= F.col("last")) | (F.col("confidence") >= F.col("confidence_target")))
    )
    best = reached.groupBy("request_id").agg(
        F.min_by(F.struct("tier", "step", "confidence", "estimated_cost_usd"), F.when(serves, F.col("step"))).alias("s"),
        F.bool_or("_stopped").alias("budget_stop"),
        F.max("last").alias("_last"),
    )
    served = F.col("s").isNotNull()
    return best.select(
        "request_id",
        F.when(served, F.col("s.tier")).otherwise("local").alias("selected_tier"),
        F.when(served, F.col("s.step")).otherwise(F.col("_last")).cast("int").alias("escalation_depth"),
        F.when(served, F.col("s.estimated_cost_usd")).otherwise(0.0).alias("estimated_cost_usd"),
        F.col("s.confidence").alias("confidence"),
        (~served).alias("is_fallback"),
        "budget_stop",
    )


def parse_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Edit steps found in free model text, one row per step, defaults filled (Q26)."""
    action = lambda field: F.try_variant_get("_a", f"$.{field}", "string")
    objects = answers.withColumn("_o", text.json_object(F.col(column)))
    listed = objects.select(
        "*", F.posexplode(F.try_variant_get("_o", "$.actions", "array<variant>")).alias("ord", "_a")
    )
    edit_type, risk = F.lower(action("type")), F.lower(action("risk"))
    target = F.btrim(F.regexp_replace(F.translate(text.strip(action("target")), "\\", "/"), r"^(\./)+", ""), F.lit("/"))
    return (
        listed.select(
            *[c for c in answers.columns if c != column], "ord",
            F.when(edit_type.isin(*rules.EDIT_TYPES), edit_type).otherwise("update_file").alias("type"),
            target.alias("target"),
            F.substr(text.strip(F.coalesce(action("intent"), F.lit(""))), F.lit(1), F.lit(500)).alias("intent"),
            F.when(risk.isin(*rules.RISK_LEVELS), risk).otherwise("medium").alias("risk"),
            F.coalesce(action("rationale"), F.lit("model-assisted planning")).alias("rationale"),
            action("content").alias("content"),
            F.try_variant_get(
                "_a", "$.patches", "array<struct<find:string,replace:string,replace_all:boolean,use_regex:boolean>>"
            ).alias("patches"),
        )
        .filter(F.coalesce(F.col("target"), F.lit("")) != "")
    )
