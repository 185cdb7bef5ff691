"""Files, traces, workloads and state as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, rules, text

TRACE_SCHEMA = """
request_id string, trace_id string, event_type string, created_at timestamp,
payload struct<project_id:string, user_id:string, query:string, user_intent:string, relevant_systems:array<string>,
  dependencies_count:int, risks:array<string>, reason:string, confidence:double,
  usage:struct<prompt_tokens:int, completion_tokens:int, total_tokens:int, cost_usd:double>,
  retrieval:struct<avg_context_score:double, context_count:int, hot_context_count:int, dropped_by_budget:int, used_chars:int, max_chars:int>,
  verdict:string, issues:array<string>, notes:string>
"""
USAGE_SCHEMA = """
domain string, prompt string, status_code int, selected_count int, xml_focus boolean, xml_selected boolean,
relevant_systems array<string>, dependencies array<string>, top_sources array<string>, risks array<string>,
compression struct<selected_count:int, dropped_count:int, max_chars:int, used_chars:int>
"""


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Unfiltered listing (project, path, size, modified_at) of project folders under ``root``.

    Contents are not read: the scan prunes the binary column.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = F.regexp_extract("path", r"^[a-z]+:/*(/.*)$", 1)
    below = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/"))
    relative = F.regexp_replace(prefix, "^" + _quoted(below) + "/", "")
    return found.select(
        F.substring_index(relative, "/", 1).alias("project"),
        F.regexp_replace(relative, "^[^/]*/", "").alias("path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content",
    )


#: Bytes of contents in one batch; a larger file makes a batch of its own.
BATCH_BYTES = 1 << 25


def walk_files(spark: SparkSession, root: str) -> DataFrame | None:
    """The same listing with ``file``, the name to read, in place of contents; None where pyarrow does not know the file system.

    Tasks walk one entry of ``root`` each, a folder at a time, so the driver holds no file names but those right below ``root``.
    Names that Spark's file sources pass over are passed over, and empty files too.
    """
    try:
        system, base = _file_system(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None
    schema = "project string, path string, size long, modified_at timestamp, file string"
    seeds = [(x.path,) for x in system.get_file_info(pafs.FileSelector(base)) if _shown(x.base_name)]
    if not seeds:
        return spark.createDataFrame([], schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _ = _file_system(root)
        left = [x for batch in batches for x in found.get_file_info(batch.column(0).to_pylist())]
        while left:
            folders = [x for x in left if x.type == pafs.FileType.Directory]
            files = [x for x in left if x.type == pafs.FileType.File and x.size]
            for at in range(0, len(files), 10_000):
                part = files[at : at + 10_000]
                names = [x.path[len(base) :].lstrip("/") for x in part]
                columns = [
                    pa.array([name.split("/", 1)[0] for name in names]), pa.array([name.split("/", 1)[-1] for name in names]), pa.array([x.size for x in part], pa.int64()),
                    pa.array([x.mtime_ns // 1_000_000 * 1000 for x in part], pa.timestamp("us", "UTC")), pa.array([x.path for x in part]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["project", "path", "size", "modified_at", "file"])
            left = folders[1:] + [x for x in found.get_file_info(pafs.FileSelector(folders[0].path)) if _shown(x.base_name)] if folders else []

    return spark.createDataFrame(seeds, "file string").repartition(len(seeds)).mapInArrow(walk, schema)


def with_contents(listed: DataFrame, root: str) -> DataFrame:
    """Rows of :func:`walk_files` with the bytes of each file, read where they are needed; dealt out evenly, as folders differ in size."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(root)
        for batch in batches:
            first, size, contents = 0, 0, []
            for n, name in enumerate(batch.column("file").to_pylist()):
                with system.open_input_file(name) as file:
                    contents.append(file.read())
                size += len(contents[-1])
                if size >= BATCH_BYTES or n + 1 == batch.num_rows:
                    kept = batch.slice(first, n + 1 - first)
                    yield pa.RecordBatch.from_arrays([*(kept.column(x) for x in ("project", "path", "size", "modified_at")), pa.array(contents, pa.binary())], names=["project", "path", "size", "modified_at", "content"])
                    first, size, contents = n + 1, 0, []

    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts).mapInArrow(read, "project string, path string, size long, modified_at timestamp, content binary")


def _file_system(root: str) -> tuple[pafs.FileSystem, str]:
    system, base = pafs.FileSystem.from_uri(root if ":/" in root else f"file://{root}")
    return system, base.rstrip("/")


def _shown(name: str) -> bool:
    """Whether Spark's file sources list a name."""
    hidden = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return not hidden or name.startswith(("_common_metadata", "_metadata"))


def _quoted(literal: str) -> str:
    return r"\Q" + literal + r"\E"


def normalize_extensions(extensions: list[str] | None, default=rules.KNOWLEDGE_EXTENSIONS) -> tuple[str, ...]:
    """Lower-cased extensions with a dot; the default when none remain."""
    cleaned = [e.strip().lower() for e in extensions or [] if e.strip()]
    return tuple(e if e.startswith(".") else f".{e}" for e in cleaned) or tuple(default)


def scan_corpus(
    spark: SparkSession, root: str, *, variant: str = "ingest", extensions: list[str] | None = None,
    max_bytes: int = rules.MAX_FILE_BYTES, excluded: tuple[str, ...] = rules.EXCLUDED_DIRS,
    output_dirs: tuple[str, ...] = (".artifacts",),
) -> DataFrame:
    """Source files of every project folder under ``root``.

    ``ingest`` hashes bytes and allows larger XML and Lua files; ``knowledge`` hashes the
    decoded text, has a flat size cap and takes other extensions.  Files are chosen by name and size
    before any is opened.  A file system that pyarrow does not know is read by Spark's file source.
    """
    base = rules.SCAN_EXTENSIONS if variant == "ingest" else rules.KNOWLEDGE_EXTENSIONS
    wanted = normalize_extensions(extensions, base)
    suffix = paths.suffix_of(F.col("path"))
    cap = F.lit(max_bytes)
    if variant == "ingest":
        cap = F.when(suffix.isin(*rules.LARGE_FILE_EXTENSIONS), max(max_bytes, rules.LARGE_FILE_BYTES)).otherwise(cap)
    hidden = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, (*excluded, *output_dirs))))
    largest = max(max_bytes, rules.LARGE_FILE_BYTES) if variant == "ingest" else max_bytes
    # The plain bound reaches the file source; the cap by suffix is applied to what it lists.
    walked = walk_files(spark, root)
    listed = list_files(spark, root) if walked is None else walked
    kept = listed.filter(F.col("size") <= largest).filter(suffix.isin(*wanted) & ~hidden & (F.col("size") <= cap))
    if walked is not None:
        kept = with_contents(kept, root)
    decoded = text.decode_text(F.col("content"))
    digest = paths.content_hash(F.col("content") if variant == "ingest" else decoded)
    return kept.select(
        "project", "path", digest.alias("hash"), "size", "modified_at", decoded.alias("content"),
        paths.language_of(F.col("path")).alias("language"), paths.module_of(F.col("path")).alias("module"),
        paths.folder_of(F.col("path")).alias("folder"),
    )


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace rows of JSON lines; malformed lines and non-objects are skipped (S3)."""
    return (
        spark.read.schema(f"{TRACE_SCHEMA}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
        .filter("_corrupt is null and (event_type is not null or payload is not null or request_id is not null)").drop("_corrupt")
    )


def recent_traces(lines: DataFrame, n: int = 20) -> DataFrame:
    """Last ``n`` (1..200) of (seq, value) lines; unreadable ones drop out after the cut."""
    tail = lines.orderBy(F.desc("seq")).limit(max(1, min(n, 200)))
    return tail.filter(F.try_parse_json("value").isNotNull())


def latest_usage(spark: SparkSession, directory: str) -> DataFrame:
    """Records of the lexicographically last cognitive-usage-*.jsonl, a file or a folder of parts."""
    rows = spark.read.schema(USAGE_SCHEMA)
    listed = rows.json(f"{directory}/cognitive-usage-*.jsonl").inputFiles()  # names only
    names = {re.search(r"cognitive-usage-[^/]*\.jsonl", name)[0] for name in listed}
    return rows.json(f"{directory}/{max(names)}") if names else spark.createDataFrame([], USAGE_SCHEMA)


def load_graph(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Edge rows of graph JSON documents, one a file or one a line: dependency map and relationship list."""
    schema = "dependencies map<string,array<string>>, edges array<struct<source:string,target:string,relation:string>>"
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path)
    from_map = raw.select(F.explode("dependencies").alias("source", "targets")).select(
        "source", F.explode("targets").alias("target"), F.lit("map").alias("kind"), F.lit(None).cast("string").alias("relation")
    )
    listed = raw.select(F.inline("edges")).select("source", "target", F.lit("edge").alias("kind"), "relation")
    from ..operators.graph import normalize_edges

    return normalize_edges(listed).unionByName(from_map.filter(F.trim("target") != ""))


def pair_summaries(meta: DataFrame, summaries: DataFrame) -> DataFrame:
    """Metadata rows with their summary text; a title where it is missing."""
    texts = summaries.select("path", F.col("content").alias("_summary"))
    title = F.concat(F.lit("# "), paths.stem_of(F.col("path")), F.lit("\n"))
    return meta.join(texts, "path", "left").withColumn(
        "content", F.when(F.coalesce("_summary", F.lit("")) == "", title).otherwise(F.col("_summary"))
    ).drop("_summary")


def read_workload(spark: SparkSession, path: str, default_workspace: str = paths.DEFAULT_WORKSPACE, lines: bool = False) -> DataFrame:
    """Workload prompts of JSON documents, one a file or one a line, with defaults; rows without project or prompt are skipped."""
    schema = "queries array<struct<workspace_id:string,project_id:string,user_id:string,domain:string,prompt:string>>"
    return (
        spark.read.schema(schema).option("multiLine", not lines).json(path)
        .select(F.posexplode("queries").alias("index", "q"))
        .select(
            (F.col("index") + 1).alias("index"), F.coalesce("q.workspace_id", F.lit(default_workspace)).alias("workspace_id"),
            F.coalesce("q.project_id", F.lit("")).alias("project_id"), F.coalesce("q.user_id", F.lit("cognitive-usage")).alias("user_id"),
            F.coalesce("q.domain", F.lit("general")).alias("domain"), text.strip(F.coalesce("q.prompt", F.lit(""))).alias("prompt"),
        )
        .filter("project_id <> '' and prompt <> ''")
    )


def recent_reports(reports: DataFrame, order: Column, n: int = 20) -> DataFrame:
    """Last ``n`` (1..100) report rows."""
    return reports.orderBy(order).limit(max(1, min(n, 100)))


def resolve_project(table: DataFrame, workspace: str, project: str) -> DataFrame:
    """Rows of one workspace and project; prunes partitions of a table laid out by them."""
    return table.filter((F.col("workspace_id") == workspace) & (F.col("project_id") == project))


def tenant_rows(table: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of the workspaces and projects that requests come from.

    Of a table laid out by them only these partitions are read: the distinct tenants prune it while the query runs.  A request
    without a project has no tenant.
    """
    # Written by length: a comparison with '' is inferred for the table too, and then counts as pruned.
    tenants = requests.filter("length(workspace_id) > 0 and length(project_id) > 0").select("workspace_id", "project_id").distinct()
    return table.join(tenants, ["workspace_id", "project_id"], "left_semi")
