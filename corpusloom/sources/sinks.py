"""Writers: append-only logs, snapshot versions, partitioned artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def route_events(decisions: DataFrame, trace_id: Column, now: Column) -> DataFrame:
    """Trace rows of routing decisions (K1)."""
    payload = F.struct("project_id", "user_id", "selected_tier", "reason", "confidence", "usage", "retrieval")
    return decisions.select(
        trace_id.alias("trace_id"), "request_id", F.lit("route.decision").alias("event_type"), now.alias("created_at"), payload.alias("payload")
    )


def retrieval_events(packets: DataFrame, trace_id: Column, now: Column) -> DataFrame:
    """Trace rows of assembled packets; the query is cut to 240 characters (K1)."""
    payload = F.struct(
        "project_id", "user_id", F.substr("prompt", F.lit(1), F.lit(240)).alias("query"), F.col("intent").alias("user_intent"),
        "relevant_systems", F.size("dependencies").alias("dependencies_count"), "risks", "retrieval",
    )
    return packets.select(
        trace_id.alias("trace_id"), "request_id", F.lit("retrieval.assembly").alias("event_type"), now.alias("created_at"), payload.alias("payload")
    )


def feedback_events(feedback: DataFrame, trace_id: Column, now: Column) -> DataFrame:
    """Trace rows of feedback; query cut to 240 characters, notes to 500 (K1)."""
    payload = F.struct(
        "workspace_id", "project_id", "user_id", F.substr("query", F.lit(1), F.lit(240)).alias("query"), "request_id", "verdict", "issues",
        F.substr("notes", F.lit(1), F.lit(500)).alias("notes"),
    )
    return feedback.select(
        trace_id.alias("trace_id"), F.coalesce("request_id", F.lit("feedback-only")).alias("request_id"),
        F.lit("cognitive.feedback").alias("event_type"), now.alias("created_at"), payload.alias("payload"),
    )


def write_traces(events: DataFrame, path: str) -> None:
    """Append trace rows as JSON lines (K1)."""
    events.write.mode("append").json(path)


def append_rows(df: DataFrame, path: str, stamp: str | None = None, now: Column | None = None) -> None:
    """Append memory, feedback or report rows, optionally stamping a time column (K2, K3, K7)."""
    rows = df.withColumn(stamp, now) if stamp else df
    rows.write.mode("append").parquet(path)


def write_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replace only the partitions present in ``df`` (K4)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_files(df: DataFrame, root: str) -> None:
    """One file per (path, content) row below ``root``, written by the tasks; a repeated task writes the same again (K4)."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    def write(batches):
        system, base = pafs.FileSystem.from_uri(root if ":/" in root else f"file://{root}")
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                target = f"{base}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(target) as out:
                    out.write(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    df.select("path", "content").mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """Write a new version next to the earlier ones, which stay readable (K4, K5, K6)."""
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")


def commit_snapshot(df: DataFrame, path: str, version: int) -> None:
    """Write a version that becomes visible as a whole; what a failed attempt at it left is replaced (K6)."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def snapshot_versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions under ``path``, ascending."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in fs.listStatus(root)]
    done = [n for p, n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=", 1)[1]) for n in done)


def read_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """Newest complete version, or an empty frame of ``schema``."""
    versions = snapshot_versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/version={versions[-1]}")


def write_artifacts(meta: DataFrame, path: str, version: int) -> None:
    """File metadata with summaries by project, edges, folder documents, state (K4)."""
    from ..operators import graph, hierarchy

    write_partitions(meta, f"{path}/metadata", "project")
    nodes, edges = graph.relationship_graph(meta)
    write_partitions(edges.unionByName(graph.dependency_edges(meta)), f"{path}/edges", "project")
    write_partitions(nodes, f"{path}/nodes", "project")
    lines = hierarchy.folder_summary_lines(meta)
    write_partitions(lines.sortWithinPartitions("project", "folder", "section", "item"), f"{path}/folders", "project")
    write_partitions(hierarchy.project_summary(meta), f"{path}/projects", "project")
    write_snapshot(meta.select("project", "path", "hash", "dependencies", "folder"), f"{path}/state", version)


def write_knowledge(nodes: DataFrame, previous: DataFrame, path: str, version: int) -> None:
    """Knowledge snapshot; unchanged nodes keep their document path (K5)."""
    old = previous.select("project", "node_id", F.col("document_path").alias("_old"))
    fresh = F.concat_ws("/", F.col("level"), F.regexp_replace("node_id", ":", "/"), F.lit("README.md"))
    kept = nodes.join(old, ["project", "node_id"], "left").withColumn(
        "document_path", F.when(~F.col("changed"), F.coalesce("_old", fresh)).otherwise(fresh)
    ).drop("_old")
    write_snapshot(kept, path, version)


def write_usage(usage: DataFrame, path: str, stamp: str) -> DataFrame:
    """Usage records of a run as JSON lines; returns the one-row summary (K8)."""
    from ..operators.quality import usage_summary

    usage.write.mode("errorifexists").json(f"{path}/cognitive-usage-{stamp}.jsonl")
    return usage_summary(usage)


def read_snapshot_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All parquet under ``path``, or an empty frame when there is none yet."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def read_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A partitioned table whose partition columns have the types of ``schema``, or an empty frame when there is none yet."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return spark.read.schema(schema).parquet(path) if fs.exists(root) else spark.createDataFrame([], schema)
