"""Domain tables derived from the generic test tables, always from every row.

The rules only rename, compute and combine columns; FIXTURES.md lists the shapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, scoring, text
from ..operators.files import describe_files, extract_files
from ..sources.tables import read_table

NOW = "2024-02-01 00:00:00"


def now():
    return F.to_timestamp(F.lit(NOW))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as source files of one project per language."""
    doc = F.col("doc_id")
    name = F.concat(F.lit("/doc_"), doc.cast("string"))
    path = (
        F.when(doc % 4 == 0, F.concat(F.lit("data/"), "source", name, F.lit(".xml")))
        .when(doc % 4 == 1, F.concat(F.lit("data/scripts/"), "source", name, F.lit(".lua")))
        .when(doc % 4 == 2, F.concat(F.lit("src/"), "source", name, F.lit(".py")))
        .otherwise(F.concat(F.lit("docs/"), "source", name, F.lit(".md")))
    )
    docs = read_table(spark, sf, "documents")
    return describe_files(
        docs.select(
            "doc_id",
            F.col("lang").alias("project"),
            path.alias("path"),
            F.col("text").alias("content"),
            F.sha2("text", 256).alias("hash"),
            F.col("n_chars").alias("size"),
            F.expr(f"timestamp'{NOW}' - make_interval(0, 0, 0, cast(doc_id % 130 as int), 0, 0, 0)").alias("modified_at"),
        )
    )


def files_before(spark: SparkSession, sf: str) -> DataFrame:
    """An earlier state of the same files: some absent, some renamed, some different."""
    doc = F.col("doc_id")
    return (
        files(spark, sf)
        .filter(doc % 13 != 7)
        .withColumn("path", F.when(doc % 17 == 3, F.regexp_replace("path", "/doc_", "/old_")).otherwise(F.col("path")))
        .withColumn("hash", F.when(doc % 11 == 5, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.col("hash")))
    )


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts to retrieve from: whole document texts with extracted dependencies."""
    return extract_files(files(spark, sf)).withColumn("confidence", F.lit(None).cast("double"))


_SUFFIXES = (
    "", " actions.xml register opcode", " shader material loot drop", " npc spell quest tools",
    " how does doc_4.xml bind the script at startup", " refactor the security architecture",
)


def requests(spark: SparkSession, sf: str, plain: bool = False) -> DataFrame:
    """Benchmark items as prompts; unless ``plain``, ended by one of six focus phrases."""
    item = F.col("item_id")
    phrase = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (item % len(_SUFFIXES) + 1).cast("int"))
    workspace = F.element_at(
        F.array(F.lit("mmo_workspace"), F.lit("unity_workspace"), F.lit("plain")), (item % 3 + 1).cast("int")
    )
    rows = read_table(spark, sf, "benchmark").select(
        item.cast("string").alias("request_id"),
        workspace.alias("workspace_id"),
        F.concat(F.lit("p"), (item % 5).cast("string")).alias("project_id"),
        F.concat(F.lit("u"), (item % 7).cast("string")).alias("user_id"),
        (F.col("text") if plain else F.concat("text", phrase)).alias("prompt"),
    )
    return prepare_requests(rows)


def prepare_requests(rows: DataFrame) -> DataFrame:
    """Terms, intent, prompt features and calibration boosts of (request_id, workspace_id, prompt)."""
    prompt = F.col("prompt")
    with_terms = rows.withColumns(
        {"terms": text.intent_terms(prompt), "intent": scoring.detect_intent(prompt)}
    )
    return scoring.with_profile(scoring.with_prompt_features(with_terms))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations")


def chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as requests."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return turns(spark, sf).filter("role = 'user'").select(
        F.concat_ws("-", conv.cast("string"), turn.cast("string")).alias("request_id"),
        "conv_id", "turn",
        F.concat(F.lit("p"), (conv % 5).cast("string")).alias("project_id"),
        F.concat(F.lit("u"), (conv % 7).cast("string")).alias("user_id"),
        F.col("text").alias("prompt"),
    )


def memory(spark: SparkSession, sf: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    seq = conv * 1000 + turn
    return turns(spark, sf).select(
        F.concat(F.lit("m"), conv.cast("string"), F.lit("-"), turn.cast("string")).alias("id"),
        F.concat(F.lit("p"), (conv % 5).cast("string")).alias("project_id"),
        F.concat(F.lit("u"), (conv % 7).cast("string")).alias("user_id"),
        F.when(F.col("role") == "user", "episodic").otherwise("project").alias("scope"),
        F.col("text").alias("content"),
        ((F.lit(40) + (conv * 7 + turn * 13) % 60) / F.lit(100.0)).alias("confidence"),
        seq.alias("seq"),
        F.timestamp_seconds(F.lit(1704067200) + seq).alias("updated_at"),
    )


def memory_with_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Memories plus a differently spaced copy of every third one."""
    base = memory(spark, sf)
    copies = base.filter(F.col("seq") % 3 == 0).withColumns(
        {
            "id": F.concat("id", F.lit("-c")),
            "content": F.concat(F.lit("  "), F.regexp_replace("content", " ", "  ")),
            "seq": F.col("seq") + 500,
            "updated_at": F.timestamp_seconds(F.lit(1704067200) + F.col("seq") + 500),
        }
    )
    return base.unionByName(copies)


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """Events as trace rows with the nested payload of the trace log."""
    e = F.col("event_id")
    issues = F.array_compact(
        F.array(
            F.when(e % 8 >= 4, "hallucination"), F.when(e % 4 >= 2, "xml_missing"),
            F.when(e % 2 == 1, "retrieval_incorrect"),
        )
    )
    verdict = F.element_at(F.array(F.lit("correct"), F.lit("partial"), F.lit("incorrect")), (e % 3 + 1).cast("int"))
    kind = F.col("event_type")
    is_route = kind.isin("purchase", "signup")
    is_feedback = kind == "error"
    payload = F.struct(
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.when(e % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("core"))).alias("relevant_systems"),
        (e % 4).cast("int").alias("dependencies_count"),
        F.when(e % 4 == 0, F.array(F.lit("2 selected contexts may be Stale (low freshness score).")))
        .otherwise(F.array().cast("array<string>")).alias("risks"),
        F.when(e % 9 == 0, "fallback-local: budget").otherwise("confidence gate passed").alias("reason"),
        ((F.lit(50) + e % 50) / F.lit(100.0)).alias("confidence"),
        F.struct(
            (e % 200).cast("int").alias("prompt_tokens"), (e % 300).cast("int").alias("completion_tokens"),
            (e % 200 + e % 300).cast("int").alias("total_tokens"), (F.col("value") / F.lit(100000.0)).alias("cost_usd"),
        ).alias("usage"),
        F.struct(
            ((e % 100) / F.lit(100.0)).alias("avg_context_score"), (e % 7).cast("int").alias("context_count"),
            (e % 11).cast("int").alias("dropped_by_budget"), (e * 37 % 3501).cast("int").alias("used_chars"),
            F.lit(3500).alias("max_chars"),
        ).alias("retrieval"),
        F.when(is_feedback, verdict).alias("verdict"),
        F.when(is_feedback, issues).alias("issues"),
    )
    return read_table(spark, sf, "events").select(
        F.concat(F.lit("r"), e.cast("string")).alias("request_id"),
        F.when(is_route, "route.decision").when(is_feedback, "cognitive.feedback").otherwise("retrieval.assembly").alias("event_type"),
        F.col("ts").cast("timestamp").alias("created_at"),
        e.alias("seq"),
        payload.alias("payload"),
    )


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    quality, toxic, doc = F.col("quality"), F.col("toxic"), F.col("doc_id")
    issues = F.array_compact(
        F.array(
            F.when(quality == 0, "hallucination"), F.when(toxic == 1, "context_bad"),
            F.when(doc % 5 == 0, "xml_missing"),
        )
    )
    return read_table(spark, sf, "labels").select(
        F.concat(F.lit("f"), doc.cast("string")).alias("id"),
        F.concat(F.lit("p"), (doc % 5).cast("string")).alias("project_id"),
        F.concat(F.lit("u"), (doc % 7).cast("string")).alias("user_id"),
        F.when((quality == 1) & (toxic == 0), "correct").when(quality == 1, "partial").otherwise("incorrect").alias("verdict"),
        issues.alias("issues"),
        doc.alias("seq"),
    )


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Events as usage records of the daily workload."""
    e = F.col("event_id")

    def repeated(word: str, n) -> F.Column:
        return F.array_repeat(F.lit(word), n.cast("int"))

    return read_table(spark, sf, "events").select(
        e.alias("seq"),
        F.col("event_type").alias("domain"),
        F.lit(200).alias("status_code"),
        (e % 12).cast("int").alias("selected_count"),
        (e % 3 == 0).alias("xml_focus"),
        (e % 6 == 0).alias("xml_selected"),
        repeated("system", e % 15).alias("relevant_systems"),
        repeated("Classic-marker", e % 40).alias("dependencies"),
        repeated("data/talkactions/a.xml", e % 7).alias("top_sources"),
        F.when(e % 4 == 0, F.array(F.lit("stale context"))).otherwise(F.array().cast("array<string>")).alias("risks"),
        F.struct((e * 17 % 3000).cast("int").alias("dropped_count")).alias("compression"),
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Hyperlinks of the pages: host of the page, link target."""
    host = F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)
    targets = F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))
    return read_table(spark, sf, "pages").select(
        "page_id", host.alias("source"), F.explode(targets).alias("target")
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
