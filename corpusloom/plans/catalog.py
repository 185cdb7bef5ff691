"""Registered queries: each runs operators over whole test tables.

Results use flat columns (arrays joined to text, explicit types), so that they compare with
the SQL in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, routing, scoring, text
from ..operators import candidates as cand
from ..operators import diff, edits, embeddings, files, graph, hierarchy, memory, packet, quality
from ..operators import routing as route
from ..operators.packing import pack_budget, selected_rows
from ..operators.relevance import lexical_match
from ..session import stage
from ..sources.tables import read_table
from . import adapters as ad
from .retrieve import DOC_COLUMNS, artifact_pairs, retrieve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(array: str | Column, sep: str = "|") -> Column:
    return F.array_join(array, sep)


def big(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")


# --- files ---------------------------------------------------------------------------------


@query
def corpus_scan_profile(spark, sf):
    """Size, count and smallest hash per project, language and module."""
    return ad.files(spark, sf).groupBy("project", "language", "module", "folder").agg(
        F.count("*").alias("files"), F.sum("size").cast("long").alias("chars"), F.min("hash").alias("first_hash")
    )


@query
def path_classes(spark, sf):
    """Path predicates per file and per page URL."""
    url_path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1), "^/", "")
    listed = ad.files(spark, sf).select("path").unionByName(read_table(spark, sf, "pages").select(url_path.alias("path")))
    return listed.distinct().select(
        "path",
        paths.is_noise_path(F.col("path"), include_app=True).alias("noise"),
        paths.is_domain_source(F.col("path")).alias("domain"),
        paths.suffix_of(F.col("path")).alias("suffix"),
    )


@query
def workspace_ids(spark, sf):
    """Scoped ids built from supplier and nation names, and split again."""
    rows = read_table(spark, sf, "supplier").select(
        F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("w"), F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("p")
    )
    scoped = rows.withColumn("scoped", paths.scoped_id(F.col("w"), F.col("p")))
    return scoped.withColumn("s", paths.split_scoped(F.col("scoped"))).select(
        "w", "scoped", F.col("s.workspace").alias("workspace"), F.col("s.project").alias("project")
    )


@query
def project_profiles(spark, sf):
    """Engine and type per project; marker files derived from the documents' ids."""
    listing = ad.files(spark, sf)
    marker = (
        F.when((F.col("project") == "en") & (F.col("doc_id") % 2 == 0), "Assets/scene.txt")
        .when(F.col("project") == "en", "ProjectSettings/version.txt")
        .when(F.col("project") == "fr", "game.uproject")
        .when(F.col("project") == "de", "package.json")
        .otherwise("pyproject.toml")
    )
    both = listing.select("project", "path").unionByName(listing.select("project", marker.alias("path")))
    return files.project_profiles(both)


@query
def file_markers(spark, sf):
    """Number of files per dependency or marker."""
    return files.marker_counts(ad.files(spark, sf))


@query
def page_xml_markers(spark, sf):
    """Tag, attribute and script markers of the pages, links read as action bindings."""
    from ..functions.extract import xml_markers

    markup = F.replace("html", F.lit("<a href="), F.lit('<Action ItemId="1" script='))
    return read_table(spark, sf, "pages").select("page_id", F.explode(xml_markers(markup)).alias("marker"))


@query
def file_summaries(spark, sf):
    """Purpose and digest of the summary document of every file."""
    return files.summarize_files(ad.files(spark, sf)).select(
        "doc_id", "purpose", F.size("symbols").alias("symbols").cast("long"), F.sha2("summary", 256).alias("summary_hash")
    )


@query
def file_confidence_risk(spark, sf):
    """Knowledge parse of every file."""
    return files.parse_knowledge_files(ad.files(spark, sf)).select(
        "doc_id", big("line_count").alias("line_count"), joined("symbols").alias("symbols"), joined("dependencies").alias("dependencies"),
        joined("patterns").alias("patterns"), "confidence", "risk_level", F.sha2("summary", 256).alias("summary_hash"),
    )


@query
def text_chunks(spark, sf):
    """Q27: every chunk of every document."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return files.chunk_rows(docs, "text").select("doc_id", big("chunk_no").alias("chunk_no"), F.md5("chunk").alias("chunk_hash"))


# --- hierarchy ---------------------------------------------------------------------------------


@query
def folder_rollup(spark, sf):
    """A1: files and dependencies per folder."""
    return hierarchy.folder_summary(ad.corpus(spark, sf)).select(
        "project", "folder", big("file_count").alias("file_count"), joined("dependencies").alias("dependencies")
    )


@query
def folder_documents(spark, sf):
    """A1: the folder documents line by line."""
    return hierarchy.folder_summary_lines(ad.corpus(spark, sf)).select("project", "folder", big("section").alias("section"), "item", "line")


@query
def project_rollup(spark, sf):
    """A2: files, modules and dependencies per project."""
    return hierarchy.project_summary(ad.corpus(spark, sf)).select(
        "project", big("file_count").alias("file_count"), big("module_count").alias("module_count"), joined("dependencies").alias("dependencies")
    )


@query
def merkle_hashes(spark, sf):
    """A4, A5: Merkle hash of every folder, module, project and global node."""
    return hierarchy.merkle_hash(ad.files(spark, sf).select("project", "path", "hash")).select(
        "project", "node_id", "level", "parent_id", "source_hash"
    )


def knowledge_leaves(spark, sf):
    return hierarchy.file_nodes(files.parse_knowledge_files(ad.files(spark, sf)))


@query
def hierarchy_rollup(spark, sf):
    """A3-A5: rolled-up inner nodes."""
    return hierarchy.rollup_nodes(knowledge_leaves(spark, sf)).select(
        "project", "node_id", "level", "confidence", "risk_level", big("child_count").alias("child_count"),
        big("file_count").alias("file_count"), joined("patterns").alias("patterns"), "source_hash",
        F.sha2("summary", 256).alias("summary_hash"),
    )


@query
def coverage_gaps(spark, sf):
    """Expected extensions missing per project, and the keyword ratio."""
    listed = ad.files(spark, sf)
    wanted = F.array(*map(F.lit, (".xml", ".lua", ".py", ".md", ".ts", ".shader")))
    expected = listed.select("project").distinct().select("project", F.explode(wanted).alias("extension"))
    gaps = hierarchy.coverage_check(listed, expected)
    hits = hierarchy.keyword_hits(listed, ["scripts", "src1/", "doc_7", "absent"])
    return gaps.join(hits, "project").select("project", "extension", F.round("hit_ratio", 4).alias("hit_ratio"))


# --- snapshots -------------------------------------------------------------------------------------


def _changes(spark, sf):
    return diff.snapshot_diff(ad.files(spark, sf), ad.files_before(spark, sf))


@query
def snapshot_changes(spark, sf):
    """Created, modified, deleted and renamed files."""
    return diff.resolve_changes(_changes(spark, sf)).select(
        "project", "path", "event_type", "previous_path", "previous_hash", "current_hash"
    )


@query
def rename_pairs(spark, sf):
    """J6 where many files share a hash: a hash of the length of the text."""
    def coarse(df):
        return df.withColumn("hash", F.md5(F.length("content").cast("string")))

    before = coarse(ad.files_before(spark, sf))
    return diff.pair_renames(diff.snapshot_diff(coarse(ad.files(spark, sf)), before)).select(
        "project", "hash", "path", "previous_path"
    )


@query
def change_report(spark, sf):
    """Change counts per project."""
    return diff.change_counts(diff.resolve_changes(_changes(spark, sf)), "project")


@query
def removed_files(spark, sf):
    """Files of the earlier snapshot that are gone."""
    return diff.removed_rows(ad.files_before(spark, sf), ad.files(spark, sf)).select("project", "path", "hash")


@query
def impacted_folders(spark, sf):
    """Folders of changed or removed files."""
    return diff.impacted_folders(diff.resolve_changes(_changes(spark, sf)))


@query
def ingestion_reports(spark, sf):
    """Incremental ingestion counts per project."""
    return diff.ingestion_report(ad.files(spark, sf), ad.files_before(spark, sf)).select(
        "project", *[big(c).alias(c) for c in ("scanned_files", "changed_files", "removed_files", "generated_file_summaries", "generated_folder_summaries")]
    )


def _node_tables(spark, sf):
    now = ad.files(spark, sf).select("project", F.concat(F.lit("file:"), "path").alias("node_id"), F.col("hash").alias("source_hash"))
    before = ad.files_before(spark, sf).select(
        "project", F.concat(F.lit("file:"), "path").alias("node_id"), F.col("hash").alias("source_hash"),
        (F.col("doc_id") % 5 + 1).alias("generation"),
    )
    return now, before


def _level_tables(spark, sf):
    """Files and all nodes above them, now and before."""
    now, before = _node_tables(spark, sf)
    inner = [
        hierarchy.merkle_hash(listed.select("project", "path", "hash")).select("project", "node_id", "source_hash")
        for listed in (ad.files(spark, sf), ad.files_before(spark, sf))
    ]
    return now.unionByName(inner[0]), before.unionByName(inner[1].withColumn("generation", (F.length("node_id") % 5 + 1).cast("long")))


@query
def generation_bumps(spark, sf):
    """Generation of every node of every level after a sync."""
    return diff.bump_generation(*_level_tables(spark, sf), "project").select("project", "node_id", "changed", "generation")


@query
def knowledge_drift(spark, sf):
    """Drifted nodes of every level per project."""
    return diff.drift_count(*_level_tables(spark, sf), "project")


# --- requests ------------------------------------------------------------------------------------------


@query
def prompt_terms(spark, sf):
    """Q2: search terms per prompt, from benchmark items and user turns."""
    prompts = ad.requests(spark, sf).select("request_id", "prompt").unionByName(
        ad.chat_requests(spark, sf).select(F.concat(F.lit("c"), "request_id").alias("request_id"), "prompt")
    )
    return prompts.select("request_id", F.explode(text.intent_terms(F.col("prompt"))).alias("term"))


@query
def prompt_profiles(spark, sf):
    """Q1, Q6, Q12: intent, focus flags and calibration boosts."""
    return ad.requests(spark, sf).select(
        "request_id", "intent", "xml_focus", "loot_focus", joined(F.array_sort("p_xml_terms")).alias("xml_terms"), "profile_name",
        *[F.round(f"{b}_boost", 4).alias(f"{b}_boost") for b in ("xml", "scripts", "assets", "src", "shader", "networking")],
    )


@query
def lexical_topk(spark, sf):
    """The ten most relevant documents per prompt, whole texts."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    pairs = lexical_match(ad.requests(spark, sf, plain=True), docs, haystack=F.col("text"), keep=["doc_id"], best=(10, "doc_id"))
    from pyspark.sql import Window as W

    w = W.partitionBy("request_id").orderBy(F.desc("relevance"), "doc_id")
    return pairs.withColumn("rank", big(F.row_number().over(w))).filter("rank <= 10").select(
        "request_id", "doc_id", big("hits").alias("hits"), F.round("relevance", 6).alias("relevance"), "rank"
    )


def _scored(spark, sf, plain=False):
    docs = cand.artifact_documents(ad.corpus(spark, sf), ad.now())
    return cand.score_artifacts(artifact_pairs(ad.requests(spark, sf, plain), docs))


@query
def candidate_ranking(spark, sf):
    """The twenty best scored artifacts per prompt."""
    return cand.rank_candidates(_scored(spark, sf), 20).select(
        "request_id", "source", F.round("relevance", 6).alias("relevance"), "freshness", F.round("importance", 4).alias("importance"),
        "final_score", "is_hot", big("n_deps").alias("n_deps"), big("flags").alias("flags"), big("rank").alias("rank"),
    )


@query
def candidate_dedup(spark, sf):
    """Candidates left per prompt after content de-duplication."""
    best = cand.dedup_candidates(_scored(spark, sf), keep=("source", "final_score"))
    return best.groupBy("request_id").agg(
        F.count("*").alias("candidates"), F.round(F.sum(F.col("final_score").cast("decimal(10,4)")).cast("double"), 4).alias("score_sum"),
        F.min("source").alias("first_source"),
    )


def packed_items(run):
    """Chosen items of every packet with its totals."""
    items = selected_rows(run.packets).select(
        "request_id", big("rank").alias("rank"), "source", big("chars").alias("chars"), F.sha2("content", 256).alias("content_hash")
    )
    return items.join(
        run.packets.select("request_id", big("selected_count").alias("selected_count"), "dropped_count", big("used_chars").alias("used_chars")),
        "request_id",
    )


@query
def context_pack(spark, sf):
    """Chosen items of every packet for the plain prompts."""
    return packed_items(retrieve(ad.requests(spark, sf, plain=True), ad.corpus(spark, sf), ad.now(), lists=False))


def _full_run(spark, sf):
    requests = ad.requests(spark, sf)
    memories = memory.memory_search(requests, ad.memory(spark, sf), 10)
    run = retrieve(
        requests, ad.corpus(spark, sf), ad.now(), memory_found=memories.join(requests.select("request_id", "terms"), "request_id")
    )
    return requests, run


@query
def context_packets(spark, sf):
    """The flagship: memories, artifacts and fallbacks packed for every prompt."""
    requests, run = _full_run(spark, sf)
    packets = packet.weak_context(packet.risk_notes(run.packets, requests))
    items = selected_rows(run.packets)
    systems = packet.sanitize_systems(packet.systems_from_sources(items), "request_id")
    deps = packet.sanitize_dependencies(packet.candidate_dependencies(run.scored, run.documents), "request_id", is_clean=True)
    none = F.array().cast("array<string>")
    full = (
        packets.join(packet.retrieval_metrics(run.packets).select("request_id", "avg_context_score", "hot_context_count"), "request_id")
        .join(systems, "request_id", "left").join(deps, "request_id", "left")
        .join(packet.recent_changes(run.scored), "request_id", "left")
    )
    return full.select(
        "request_id", big("selected_count").alias("selected_count"), "dropped_count", big("used_chars").alias("used_chars"),
        joined(F.transform("selected", lambda s: s["source"])).alias("sources"),
        joined("risks", "; ").alias("risks"), joined("reasons").alias("weak_reasons"), "weak", "avg_context_score",
        big("hot_context_count").alias("hot_context_count"), joined(F.coalesce("relevant_systems", none)).alias("systems"),
        joined(F.coalesce("dependencies", none)).alias("dependencies"), joined(F.coalesce("recent_changes", none)).alias("recent_changes"),
    )


@query
def packet_evidence(spark, sf):
    """Q29, K1, K8: evidence JSON and usage flags per prompt."""
    requests, run = _full_run(spark, sf)
    noted = packet.risk_notes(run.packets, requests)
    systems = packet.sanitize_systems(packet.systems_from_sources(selected_rows(run.packets)), "request_id")
    deps = packet.sanitize_dependencies(packet.candidate_dependencies(run.scored, run.documents), "request_id", is_clean=True)
    none = F.array().cast("array<string>")
    ready = (
        noted.join(systems, "request_id", "left").join(deps, "request_id", "left").join(requests.select("request_id", "intent"), "request_id")
        .withColumn("relevant_systems", F.coalesce("relevant_systems", none)).withColumn("dependencies", F.coalesce("dependencies", none))
    )
    used = quality.usage_records(ready, requests).select("request_id", "xml_focus", "xml_selected")
    return packet.evidence_summary(ready).join(used, "request_id")


@query
def risk_counts(spark, sf):
    """Q16, Q28, Q30: risks, weak reasons and metrics of the plain prompts' packets."""
    requests = ad.requests(spark, sf, plain=True)
    run = retrieve(requests, ad.corpus(spark, sf), ad.now(), lists=False)
    noted = packet.weak_context(packet.risk_notes(run.packets, requests))
    return noted.join(packet.retrieval_metrics(run.packets).drop("used_chars", "max_chars"), "request_id").select(
        "request_id", joined("risks", "; ").alias("risks"), joined("reasons").alias("reasons"), "weak", "avg_context_score",
        big("hot_context_count").alias("hot_context_count"),
    )


@query
def packet_lists(spark, sf):
    """Clean dependencies and recent changes of what every plain prompt matches."""
    requests = ad.requests(spark, sf, plain=True)
    # Dependencies are found once.  The pairs are not staged: they compress so well that a task would read far more of them than it can hold.
    docs = stage(cand.artifact_documents(ad.corpus(spark, sf), ad.now()).select("haystack", "dependencies", *DOC_COLUMNS), "documents")
    scored = cand.score_artifacts(artifact_pairs(requests, docs))
    deps = packet.sanitize_dependencies(packet.candidate_dependencies(scored, docs), "request_id", is_clean=True)
    none = F.array().cast("array<string>")
    return requests.select("request_id").join(deps, "request_id", "left").join(packet.recent_changes(scored), "request_id", "left").select(
        "request_id", joined(F.coalesce("dependencies", none)).alias("dependencies"), joined(F.coalesce("recent_changes", none)).alias("recent_changes")
    )


@query
def packet_systems(spark, sf):
    """Q14, Q15: systems named by every file per project, and by every page path per page group."""
    sources = ad.files(spark, sf).select(F.col("project").alias("request_id"), F.concat(F.lit("artifact:file:"), "path").alias("source"))
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    named = read_table(spark, sf, "pages").select(
        F.concat(F.lit("page"), F.col("page_id") % 10).alias("request_id"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" file:"), path)).otherwise(path).alias("system")
    )
    systems = packet.sanitize_systems(packet.systems_from_sources(sources).unionByName(named), "request_id")
    return systems.select("request_id", joined("relevant_systems").alias("systems"))


@query
def fallback_context(spark, sf):
    """Best domain files for nation names no file mentions."""
    rows = read_table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("request_id"),
        F.element_at(F.array(F.lit("mmo_workspace"), F.lit("unity_workspace")), (F.col("n_nationkey") % 2 + 1).cast("int")).alias("workspace_id"),
        F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, " doc_8.xml").when(F.col("n_nationkey") % 3 == 1, " onuse").otherwise("")).alias("prompt"),
    )
    requests = ad.prepare_requests(rows)
    docs = cand.artifact_documents(ad.corpus(spark, sf), ad.now())
    matched = cand.score_artifacts(artifact_pairs(requests, docs))
    return cand.fallback_candidates(requests, docs, matched).select(
        "request_id", "source", F.round("importance", 4).alias("importance"), "freshness", big("n_deps").alias("n_deps"), "final_score"
    )


@query
def hybrid_score(spark, sf):
    """Ten best documents after semantic re-scoring of the lexical top 40."""
    vectors = ad.vectors(spark, sf)
    asked = vectors.select(F.col("vec_id").cast("string").alias("request_id"), F.col("vector").alias("request_vector"))
    docs = ad.files(spark, sf).join(vectors, F.col("doc_id") == F.col("vec_id")).select(
        F.concat(F.lit("artifact:file:"), "path").alias("source"), "vector"
    )
    scored = cand.apply_semantic_scores(_scored(spark, sf, plain=True), asked, docs)
    return cand.rank_candidates(scored, 10).select("request_id", "source", "semantic", "final_score", big("rank").alias("rank"))


@query
def assist_shortlists(spark, sf):
    """T4: artifact shortlists offered to a retrieval assistant."""
    return cand.assist_shortlist(_scored(spark, sf)).select("request_id", "source", big("place").alias("place"))


@query
def hinted_scores(spark, sf):
    """Q32: scores after priority hints; each prompt names one file and two terms."""
    texts = cand.artifact_documents(ad.corpus(spark, sf), ad.now())
    texts = stage(texts.select("haystack", "content", "dependencies", *DOC_COLUMNS), "documents")
    scored = cand.score_artifacts(artifact_pairs(ad.requests(spark, sf, plain=True), texts))
    hints = read_table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("request_id"),
        F.array(F.concat(F.lit("src/src1/doc_"), (F.col("item_id") * 4 + 2).cast("string"), F.lit(".py"))).alias("priority_sources"),
        F.array(F.lit(" The "), F.lit("zzzz")).alias("include_terms"),
    )
    return cand.rank_candidates(cand.apply_hints(scored, hints, texts), 10).select(
        "request_id", "source", F.round("relevance", 6).alias("relevance"), "final_score", big("rank").alias("rank")
    )


# --- memory and knowledge ------------------------------------------------------------------------------


@query
def memory_search(spark, sf):
    """Newest memories per user turn sharing a word, within project and user."""
    return memory.memory_search(ad.chat_requests(spark, sf), ad.memory(spark, sf)).select("request_id", "id", big("seq").alias("seq"))


@query
def memory_compaction(spark, sf):
    """Memories deleted as duplicates."""
    return memory.duplicate_memories(ad.memory_with_copies(spark, sf)).select("id", "project_id", "user_id")


@query
def memory_compacted(spark, sf):
    """What remains per scope after compaction."""
    return memory.compact_memory(ad.memory_with_copies(spark, sf)).groupBy("project_id", "user_id").agg(
        F.count("*").alias("entries"), F.min("id").alias("first_id")
    )


@query
def memory_health(spark, sf):
    """Low-confidence memories per project among the newest 300."""
    return memory.memory_health(ad.memory(spark, sf), "project_id")


@query
def memory_recent(spark, sf):
    """Newest memories of one project."""
    return memory.memory_recent(ad.memory(spark, sf), project="p1", limit=50).select("id", "user_id", "confidence")


@query
def auto_memories(spark, sf):
    """Q25: memory rows of answered user turns."""
    answers = ad.turns(spark, sf).filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = ad.chat_requests(spark, sf).join(answers, ["conv_id", "turn"]).withColumns(
        {
            "confidence": (F.col("conv_id") % 100) / F.lit(100.0), "trace_id": F.concat(F.lit("t"), "request_id"),
            "selected_tier": F.lit("flash"), "provider": F.lit("remote"), "task_type": F.lit("debugging"),
        }
    )
    return memory.auto_memory(rows, ad.now(), with_task_type=True).select(
        "id", "project_id", "user_id", "scope", F.sha2("content", 256).alias("content_hash"), joined("tags").alias("tags"), "confidence", "provenance"
    )


def _knowledge_found(spark, sf):
    nodes = ad.corpus(spark, sf).select(
        F.concat(F.lit("file:"), "path").alias("node_id"), F.regexp_extract("path", "[^/]*$", 0).alias("title"),
        F.col("path").alias("source_path"), F.col("content").alias("summary"), "dependencies",
        F.array(F.lit("async")).alias("patterns"), (F.col("doc_id") % 50 / F.lit(50.0)).alias("confidence"),
    )
    return memory.knowledge_search(ad.requests(spark, sf), nodes)


@query
def knowledge_search(spark, sf):
    """Best knowledge nodes per prompt, whole texts as summaries."""
    return _knowledge_found(spark, sf).select("request_id", "node_id", F.round("score", 6).alias("score"), big("rank").alias("rank"))


_SCORES = ("request_id", "source", "freshness", "final_score", "is_hot")


def _shown_scores(scored):
    return scored.select(
        *_SCORES, F.round("relevance", 6).alias("relevance"), F.round("confidence", 4).alias("confidence"), F.round("importance", 4).alias("importance"),
        big("n_deps").alias("n_deps"), big("size").alias("size"),
    )


@query
def knowledge_scores(spark, sf):
    """Q8, Q9: the knowledge nodes found for every prompt as scored candidates."""
    found = _knowledge_found(spark, sf).withColumn("level", F.lit("file")).drop("terms")
    return _shown_scores(cand.knowledge_candidates(found.join(ad.requests(spark, sf).select("request_id", "terms"), "request_id")))


@query
def memory_scores(spark, sf):
    """Q8, Q9: the memories found for every user turn as scored candidates."""
    asked = ad.chat_requests(spark, sf).withColumn("terms", text.intent_terms(F.col("prompt")))
    return _shown_scores(cand.memory_candidates(memory.memory_search(asked, ad.memory(spark, sf), carry=("terms",)), ad.now()))


@query
def knowledge_scope(spark, sf):
    """Knowledge rows inside each request's own workspace tree."""
    requests = ad.requests(spark, sf)
    # The pages are dealt out to all prompts in turn, under one of three trees.
    prompts = read_table(spark, sf, "benchmark").agg(F.count("*").alias("n_prompts"))
    tree = F.element_at(F.array(F.lit(".artifacts/workspaces/mmo_workspace/p1/"), F.lit(".artifacts/workspaces/plain/p2/"), F.lit("app/")), (F.col("page_id") % 3 + 1).cast("int"))
    found = read_table(spark, sf, "pages").crossJoin(F.broadcast(prompts)).select(  # one row
        (F.col("page_id") % F.col("n_prompts")).cast("string").alias("request_id"), F.concat(tree, "page_id").alias("source_path")
    )
    return memory.scope_knowledge(found, requests).select("request_id", "source_path")


# --- graph --------------------------------------------------------------------------------------------------


def _link_edges(spark, sf):
    kind = F.when(F.col("page_id") % 2 == 0, graph.MAP).otherwise(graph.EDGE)
    return ad.links(spark, sf).select(
        "source", "target", kind.alias("kind"), F.when(F.col("page_id") % 3 == 0, " ").otherwise("links").alias("relation")
    ).distinct()


def _link_requests(spark, sf):
    """Whole link targets, and nation and region names, as prompts."""
    names = (
        read_table(spark, sf, "nation").select(F.col("n_name").alias("name"))
        .unionByName(read_table(spark, sf, "region").select(F.col("r_name").alias("name")))
        .unionByName(ad.links(spark, sf).select(F.col("target").alias("name")).distinct())
    )
    return names.select(F.col("name").alias("request_id"), text.intent_terms(F.col("name")).alias("terms"))


@query
def relationship_graph(spark, sf):
    """Edges of the relationship graph by relation, and node kinds."""
    # Read three times: what the patterns found is kept, so that they run once over the texts.
    meta = stage(ad.corpus(spark, sf).select("project", "path", "module", "dependencies"), "graph-meta")
    nodes, edges = graph.relationship_graph(meta)
    return (
        graph.relation_histogram(edges).select(F.col("relation").alias("what"), F.col("edges").alias("n"))
        .unionByName(nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.col("kind").alias("what"), "n"))
        .unionByName(graph.dependency_edges(meta).agg(F.count("*").alias("n")).select(F.lit("map").alias("what"), "n"))
    )


@query
def normalized_links(spark, sf):
    """Edge rows after normalisation, by relation."""
    return graph.normalize_edges(_link_edges(spark, sf)).groupBy("relation", "kind").agg(F.count("*").alias("edges"))


@query
def graph_seeds(spark, sf):
    """Seed nodes per link prompt."""
    return graph.seed_nodes(_link_edges(spark, sf), _link_requests(spark, sf))


@query
def graph_expand(spark, sf):
    """Nodes within two steps, at most 80 per prompt, with system and class."""
    edges = _link_edges(spark, sf)
    seeds = graph.seed_nodes(edges, _link_requests(spark, sf))
    return graph.classify_nodes(graph.expand(edges, seeds)).select(
        "request_id", "node", big("depth").alias("depth"), "system", "is_dependency"
    )


@query
def visited_relations(spark, sf):
    """Relations of the edges touching the visited nodes."""
    edges = _link_edges(spark, sf)
    visited = graph.expand(edges, graph.seed_nodes(edges, _link_requests(spark, sf)))
    return graph.relation_histogram(graph.normalize_edges(edges), visited)


# --- quality ---------------------------------------------------------------------------------------------------

_KPI_DOUBLES = (
    "retrieval_precision", "hallucination_rate", "stale_context_rate", "architectural_consistency", "token_efficiency", "reasoning_success",
    "feedback_correct_rate", "feedback_partial_rate", "feedback_incorrect_rate", "feedback_hallucination_rate", "feedback_xml_missing_rate",
    "feedback_retrieval_incorrect_rate", "feedback_compression_bad_rate", "feedback_architectural_loss_rate",
    "total_cost_usd", "prompt_tokens", "completion_tokens", "total_tokens",
)


def _report(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "sample_size", "retrieval_samples", "route_samples", *_KPI_DOUBLES, joined("notes", " ").alias("notes"), "gate")


@query
def eval_kpis(spark, sf):
    """Quality report over all traces."""
    return _report(quality.evaluate(ad.traces(spark, sf), limit=0))


@query
def eval_by_project(spark, sf):
    """Quality report over the last 300 traces of each project."""
    rows = ad.traces(spark, sf).withColumn("project", F.col("payload.project_id"))
    return _report(quality.evaluate(rows, "project", limit=300), "project")


@query
def failure_taxonomy(spark, sf):
    """Usage records per failure type."""
    return quality.failure_counts(ad.usage(spark, sf))


@query
def diagnosis(spark, sf):
    """Failure counts with feedback issues added."""
    return quality.diagnose(quality.failure_counts(ad.usage(spark, sf)), ad.feedback(spark, sf))


@query
def recommendations(spark, sf):
    """Advice for the failures that occur."""
    found = quality.diagnose(quality.failure_counts(ad.usage(spark, sf)), ad.feedback(spark, sf))
    return quality.recommendations(found).select(big("ord").alias("ord"), "recommendation")


@query
def feedback_summary(spark, sf):
    """A10: verdicts of the newest 500 feedback rows per project."""
    return quality.feedback_summary(ad.feedback(spark, sf), "project_id")


@query
def top_issues(spark, sf):
    """A10, T5: most frequent feedback issues."""
    return quality.top_issues(ad.feedback(spark, sf))


@query
def usage_summary(spark, sf):
    """Totals of the usage records."""
    return quality.usage_summary(ad.usage(spark, sf))


@query
def reflection(spark, sf):
    """Counts and notes of one reflection cycle over all inputs."""
    memories = ad.memory_with_copies(spark, sf)
    found = quality.diagnose(quality.failure_counts(ad.usage(spark, sf)), ad.feedback(spark, sf))
    report = quality.reflection_notes(
        memories, memory.duplicate_memories(memories), diff.drift_count(*_node_tables(spark, sf), "project"), ad.feedback(spark, sf), found
    )
    return report.select("scanned_entries", "duplicates_removed", "low_confidence_entries", joined("notes", chr(10)).alias("notes"))


# --- routing -------------------------------------------------------------------------------------------------------


def _route_requests(spark, sf):
    """User turns with what routing looks at; assistant turns of a conversation are its snippets."""
    t = F.col("turn")
    requests = ad.chat_requests(spark, sf).withColumns(
        {
            "tier_hint": F.when(F.col("conv_id") % 17 == 0, "max"),
            "has_retrieval": F.col("conv_id") % 2 == 0,
            "intent": F.element_at(F.array(*map(F.lit, ("refactor", "debug", "testing", "architecture"))), (F.col("conv_id") % 4 + 1).cast("int")),
            "n_dependencies": F.length("prompt") % 11, "n_risks": t % 3, "n_contexts": F.length("prompt") % 20,
        }
    )
    answers = ad.turns(spark, sf).filter("role = 'assistant'").select("conv_id", F.col("text").alias("content"))
    return requests, answers


@query
def route_tiers(spark, sf):
    """Q17, Q18: starting tier and reason of every user turn."""
    requests, snippets = _route_requests(spark, sf)
    return route.start_tiers(route.request_tokens(requests, snippets, "conv_id")).select(
        "request_id", "start_tier", "start_reason", F.round(routing.complexity(F.col("prompt")), 4).alias("complexity")
    )


@query
def route_cost(spark, sf):
    """Estimated cost of every user turn at every tier."""
    requests, snippets = _route_requests(spark, sf)
    return route.estimate_cost(requests, snippets, route.tier_table(spark), "conv_id").select(
        "request_id", "tier", big("tokens").alias("tokens"), "estimated_cost_usd"
    )


@query
def served_tiers(spark, sf):
    """Q21: tier that serves every user turn, given logged confidences."""
    requests, snippets = _route_requests(spark, sf)
    costs = route.estimate_cost(requests, snippets, route.tier_table(spark), "conv_id")
    starts = route.start_tiers(route.request_tokens(requests, snippets, "conv_id"))
    # One logged response per turn and tier, some tiers unavailable.
    confidence = F.col("tier_rank") * F.lit(0.05) + (F.col("conv_id") % 30 + F.lit(60)) / F.lit(100.0)
    responses = costs.filter((F.col("conv_id") + F.col("tier_rank")) % 5 != 0).select(
        "request_id", "tier", F.round(confidence, 4).alias("confidence")
    )
    return route.served_tier(starts, costs, responses, budget=0.013).select(
        "request_id", "selected_tier", big("escalation_depth").alias("escalation_depth"), "estimated_cost_usd", "is_fallback"
    )


@query
def prompt_routing(spark, sf):
    """Q19, Q22-Q24: role, response cost, draft confidence and task prompt per user turn."""
    conv, t = F.col("conv_id"), F.col("turn")
    model = F.element_at(F.array(*map(F.lit, ("qwen-max-latest", "Qwen-Flash", "other"))), (conv % 3 + 1).cast("int"))
    task = F.element_at(F.array(*map(F.lit, ("chat", "debugging", "planning", "unknown"))), (conv % 4 + 1).cast("int"))
    explicit = F.when(conv % 5 == 0, " Coding ").when(conv % 5 == 1, "nonsense")
    return ad.chat_requests(spark, sf).select(
        "request_id",
        routing.model_role(explicit, conv % 7 == 0, task, F.lit("debug")).alias("role"),
        routing.response_cost(model, F.length("prompt") * 2, t * 100 + 50).alias("cost"),
        F.round(routing.draft_confidence(F.col("prompt")), 4).alias("draft_confidence"),
        F.sha2(routing.task_prompt(task, F.col("prompt")), 256).alias("task_prompt_hash"),
    )


@query
def parsed_answers(spark, sf):
    """Q26: edit steps read out of free model answers; every turn's own words are the intent of one."""
    none = F.lit(None).cast("string")

    def step(target, kind, risk, intent, rationale):
        return F.struct(target.alias("target"), kind.alias("type"), risk.alias("risk"), intent.alias("intent"), rationale.alias("rationale"))

    steps = F.array(
        step(F.concat(F.lit("./docs/c"), F.col("conv_id").cast("string"), F.lit(".md")), F.lit("PATCH_file"), F.lit("Low"), F.concat(F.lit(" "), "text"), F.col("role")),
        step(F.concat(F.lit("a"), F.col("turn").cast("string"), F.lit(".py")), none, F.lit("odd"), none, none),
        step(F.lit(" "), none, none, none, none),
    )
    body = F.to_json(F.struct(steps.alias("actions")))
    kind = F.col("conv_id") % 4
    answers = ad.turns(spark, sf).select(
        "conv_id", "turn",
        F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Here you go: "), body, F.lit(" done")))
        .when(kind == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.col("text")).alias("answer"),
    )
    return route.parse_answers(answers).select("conv_id", "turn", big("ord").alias("ord"), "type", "target", "intent", "risk", "rationale")


# --- bulk edits --------------------------------------------------------------------------------------------------------


def _patch(find: str, replace: str, replace_all: bool, use_regex: Column | bool = False) -> Column:
    return F.struct(
        F.lit(find).alias("find"), F.lit(replace).alias("replace"), F.lit(replace_all).alias("replace_all"),
        (use_regex if isinstance(use_regex, Column) else F.lit(use_regex)).alias("use_regex"),
    )


def _edit_plan(spark, sf):
    """One edit per document: literal patches, other operations by document number."""
    doc = F.col("doc_id")
    patches = F.array(_patch("the", "THE", True), _patch("an", "<AN>", False))
    kind = F.when(doc % 19 == 0, "delete_file").when(doc % 23 == 0, "create_file").otherwise("patch_file")
    target = F.when(doc % 29 == 0, F.concat(F.lit("../"), "path")).when(doc % 31 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.concat(F.lit("./"), "path"))
    return ad.files(spark, sf).select(
        F.concat(F.lit("plan"), (doc % 50).cast("string")).alias("plan_id"), F.concat(F.lit("s"), doc.cast("string")).alias("step_id"), doc.alias("ord"),
        kind.alias("type"), target.alias("target"), F.lit("tidy up").alias("intent"), edits.classify_risk(kind, target).alias("risk"),
        F.lit(None).cast("string").alias("content"), F.when(kind == "patch_file", patches).alias("patches"),
    )


def _edit_docs(spark, sf):
    return ad.files(spark, sf).select(F.col("path").alias("doc_path"), "content", F.octet_length("content").alias("size"))


def _validated(spark, sf):
    return edits.validate_edits(
        _edit_plan(spark, sf), _edit_docs(spark, sf), blocked_prefixes=("src/src3", "/docs/src4/"), allow_high_risk=True, allow_delete=True, max_bytes=20_000
    )


def _edit_prompts(spark, sf):
    """Items and whole pages as prompts that name files and numbers."""
    rows = read_table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("request_id"), "item_id", "text").unionByName(
        read_table(spark, sf, "pages").select(
            F.concat(F.lit("p"), "page_id").alias("request_id"), F.col("page_id").alias("item_id"), F.concat_ws(" ", "url", "html").alias("text")
        )
    )
    verb = F.element_at(F.array(*map(F.lit, ("remove", "update", "create new file", "raise rate to 1.5 in", "add +2 in"))), (F.col("item_id") % 5 + 1).cast("int"))
    named = F.concat(F.lit("./app/main.py, src/a.lua and src/a.lua, docs/n"), F.col("item_id") % 7, F.lit(".md"))
    return rows.select("request_id", F.concat_ws(" ", verb, named, "text").alias("prompt"))


@query
def edit_classes(spark, sf):
    """Type, targets and rate of prompts that name pages and numbers."""
    prompts = _edit_prompts(spark, sf)
    targets = edits.edit_targets(prompts).groupBy("request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "target"))), lambda t: t["target"]), "|").alias("targets")
    )
    return prompts.join(targets, "request_id").select(
        "request_id", edits.classify_type(F.col("prompt")).alias("type"), "targets", edits.is_increment(F.col("prompt")).alias("increment"),
        joined(F.transform(F.split("targets", "[|]"), lambda t: edits.classify_risk(F.lit("patch_file"), t))).alias("risks"),
    )


@query
def edit_validation(spark, sf):
    """Validation issues of one edit per document."""
    return edits.validation_issues(_validated(spark, sf))


@query
def bulk_edit(spark, sf):
    """Outcome and digest of one edit per document."""
    done = edits.apply_edits(_validated(spark, sf), _edit_docs(spark, sf))
    return done.select("step_id", "status", "message", F.when(F.col("status") == "applied", F.sha2("after", 256)).alias("after_hash"))


@query
def edit_reports(spark, sf):
    """Counts per plan, and the execution decision."""
    done = edits.edit_report(edits.apply_edits(_validated(spark, sf), _edit_docs(spark, sf)))
    return done.join(edits.decide(_edit_plan(spark, sf), allow_high_risk=True), "plan_id")


@query
def edit_rollback(spark, sf):
    """Documents after undoing the applied edits, which equal the originals."""
    docs = _edit_docs(spark, sf)
    audit = edits.edit_audit(edits.apply_edits(_validated(spark, sf), docs))
    changed = edits.edited_documents(docs, audit)
    restored = edits.rollback_edits(changed, audit)
    return restored.select("doc_path", F.sha2("content", 256).alias("content_hash"))


@query
def patch_dry_run(spark, sf):
    """Whether any patch, literal or regular expression, would match."""
    plan = _edit_plan(spark, sf).filter("type = 'patch_file'").withColumn(
        "patches", F.array(_patch("onre", "", False, F.col("ord") % 2 == 0))
    )
    return edits.patches_match(plan, _edit_docs(spark, sf)).select("step_id", "matches")


@query
def duplicate_plans(spark, sf):
    """User turns as plan iterations, repeated when the whole prompt repeats."""
    t = F.col("turn")
    steps = F.array(F.struct(F.lit("patch_file").alias("type"), F.col("prompt").alias("target"), F.col("project_id").alias("intent")))
    plans = ad.chat_requests(spark, sf).select((F.col("conv_id") % 10).alias("run_id"), (F.col("conv_id") * 100 + t).alias("iteration"), steps.alias("steps"))
    return edits.duplicate_plans(plans).select("run_id", "iteration", "signature", "is_duplicate")


# --- state and streams ---------------------------------------------------------------------------------------------------


def _gate_events(spark, sf):
    return read_table(spark, sf, "events").select(
        F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("workspace_id"), F.col("event_id").alias("seq"),
        F.col("ts").alias("at"), (F.col("event_type") != "view").alias("weak"),
    )


@query
def cooldown_triggers(spark, sf):
    """Which weak-context events fire a rebuild, at most one per 600 s and workspace."""
    from ..streaming.cooldown import cooldown_trigger

    return cooldown_trigger(_gate_events(spark, sf), 600).select("workspace_id", "seq", "weak", "fired", "reason")


@query
def kpi_stream(spark, sf):
    """Traces written as JSON lines, streamed into daily KPIs, read back."""
    from ..session import scratch
    from ..sources.sinks import write_traces
    from ..streaming.traces import land_kpis, read_kpis, stream_traces

    base = scratch(spark, "kpi-stream")
    write_traces(ad.traces(spark, sf).drop("seq"), f"{base}/traces")
    job = (
        stream_traces(spark, f"{base}/traces").writeStream.foreachBatch(land_kpis(f"{base}/kpis"))
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return read_kpis(spark, f"{base}/kpis").withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")


@query
def embedding_cache(spark, sf):
    """Prompts and documents embedded once each, known texts from the cache."""
    docs = read_table(spark, sf, "documents").select(F.col("text").alias("content"))
    embed = embeddings.hashing_embedder(16)
    known = embeddings.embed_texts(
        embeddings.cache_misses(docs.filter(F.length("content") < 1000), spark.createDataFrame([], "cache_key string, embedding array<float>"), "hashing"), embed, "hashing"
    )
    found, fresh = embeddings.embed_with_cache(docs, known, embed)
    return found.select(F.size("embedding").alias("dims").cast("long"), "cache_key").join(
        fresh.select("cache_key", F.lit(True).alias("is_new")), "cache_key", "left"
    ).groupBy("dims", F.coalesce("is_new", F.lit(False)).alias("is_new")).agg(F.count("*").alias("texts"))
