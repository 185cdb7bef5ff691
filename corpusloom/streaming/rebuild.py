"""Incremental rebuild of the knowledge of projects, from changed files up to the root.

The state lies in three tables, ``nodes``, ``edges`` and ``folders``, partitioned by project, top-level module and epoch.  A full
listing is compared with the file hashes of the last commit.  Changed files mark their module and all their ancestors as dirty.  Only
changed files are parsed, only dirty nodes are hashed again (their clean children bring the hashes they had), and only the partitions of
modules with a change are written, beside their old ones.  Module, project and global nodes have a partition of their own, so a
project's root never needs the files of its clean modules.

A commit is a small table that names the epoch of every partition.  It is written last: a run that dies leaves no trace that a reader sees,
and its repetition starts from the same commit and overwrites, partition by partition, what the first attempt wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import folder_of, module_of
from ..operators import diff, files, graph, hierarchy
from ..session import stage
from ..sources import sinks

#: The partition of module, project and global nodes; no path has such a module.
TOP = "/"
_AT = "project string, module string, epoch long"
SCHEMAS = {
    "nodes": "node_id string, level string, title string, source_path string, parent_id string, source_hash string, confidence double, "
    "generation long, risk_level string, summary string, dependencies array<string>, patterns array<string>, links array<string>, " + _AT,
    "edges": "source string, target string, kind string, relation string, " + _AT,
    "folders": "folder string, section int, item string, line string, " + _AT,
}
_COMMIT = "project string, module string, epoch long"


def commit_path(root: str) -> str:
    return f"{root}/commits"


def read_state(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table of the last commit; the join with the commit prunes partitions."""
    whole = sinks.read_tree(spark, f"{root}/{table}", SCHEMAS[table])
    return whole.join(sinks.read_snapshot(spark, commit_path(root), _COMMIT), ["project", "module", "epoch"], "left_semi")


def _write(frame: DataFrame, root: str, table: str, epoch: int) -> None:
    """Copy on write: the epoch's own partitions, replaced if an earlier attempt left them."""
    columns = [field.split()[0] for field in SCHEMAS[table].split(", ")]
    sinks.write_partitions(frame.withColumn("epoch", F.lit(epoch).cast("long")).select(*columns), f"{root}/{table}", "project", "module", "epoch")


def _fresh_leaves(batch: DataFrame) -> DataFrame:
    """File nodes with what the knowledge parse and the dependency scan find, each text read once."""
    scanned = files.extract_files(batch).withColumnRenamed("dependencies", "links").drop("symbols")
    return hierarchy.file_nodes(files.parse_knowledge_files(scanned))


_LEAF = (
    "project", "node_id", "level", "title", "source_path", "parent_id", "source_hash", "confidence", "risk_level", "summary", "dependencies", "patterns", "links",
)


def dirty_ids(changed: DataFrame) -> DataFrame:
    """(project, node_id): every inner node above a changed or removed path."""
    return hierarchy.ancestors(changed.select("project", F.col("path").alias("source_path"))).select(
        "project", F.col("ancestor_id").alias("node_id")
    ).distinct()


def delta_rollup(leaves: DataFrame, before: DataFrame, dirty: DataFrame, touched: DataFrame) -> DataFrame:
    """Inner nodes of the ``touched`` (project, module) and of their projects; dirty ones hashed anew.

    ``leaves`` are all files of these modules and ``before`` the inner nodes as they were: their folders, and all modules of their projects.
    A clean node keeps its hash, and stands as a leaf below a dirty parent.
    """
    keys = ["project", "node_id"]
    here = hierarchy.build_hierarchy(leaves.select("project", F.col("source_path").alias("path"))).filter("level IN ('folder', 'module')")
    above = hierarchy.build_hierarchy(touched.select("project", F.lit("").alias("path")).distinct()).filter("level IN ('project', 'global')")
    listed = stage(here.unionByName(above), "listed")
    stale = stage(listed.join(dirty, keys, "left_semi"), "stale")
    carried = ["source_hash", "confidence"]
    kept = listed.filter("level = 'folder'").join(stale, keys, "left_anti").join(before.select(*keys, *carried), keys)
    other = before.filter("level = 'module'").join(touched.withColumnRenamed("module", "source_path"), ["project", "source_path"], "left_anti").withColumn("depth", F.lit(0))
    clean = stage(kept.select(*listed.columns, *carried).unionByName(other.select(*listed.columns, *carried)), "clean")
    columns = ["project", "node_id", "parent_id", *carried]
    below = leaves.select(*columns).unionByName(clean.select(*columns)).join(
        stale.select("project", F.col("node_id").alias("parent_id")), ["project", "parent_id"], "left_semi"
    )
    hashed = hierarchy.rollup_levels(below, stale)
    shown = [*listed.columns, *carried]
    return hashed.select(*shown).unionByName(clean.select(*shown))


def incremental_rebuild(root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: full listings in, the state brought up to date.

    A batch is the current state of its projects: (project, path, hash, content, language); projects that it does not name stay as they
    are.  An epoch that is committed does nothing.  Resolved changes are logged under ``events``.
    """

    def rebuild(batch: DataFrame, epoch: int) -> None:
        spark, keys = batch.sparkSession, ["project", "path"]
        if epoch in sinks.snapshot_versions(spark, commit_path(root)):
            return
        commit = sinks.read_snapshot(spark, commit_path(root), _COMMIT)
        state = read_state(spark, root, "nodes")
        listing = stage(batch.select(*keys, "hash"), "listing")
        named = listing.select("project").distinct()
        known = state.filter("level = 'file'").select("project", F.col("source_path").alias("path"), F.col("source_hash").alias("hash"), "generation")
        known = stage(known.join(named, "project", "left_semi"), "known")
        changed = stage(diff.snapshot_diff(listing, known).withColumn("module", module_of(F.col("path"))), "changed")
        resolved = diff.resolve_changes(changed.drop("module"))
        resolved.write.mode("overwrite").parquet(f"{root}/events/epoch={epoch}")

        if changed.isEmpty():
            sinks.commit_snapshot(commit, commit_path(root), epoch)
            return
        touched = stage(changed.select("project", "module").distinct(), "touched")
        inside = state.join(touched, ["project", "module"], "left_semi")
        fresh = _fresh_leaves(batch.join(changed.filter("event_type <> 'deleted'").select(*keys), keys, "left_semi"))
        old = inside.filter("level = 'file'").join(changed.select("project", F.col("path").alias("source_path")), ["project", "source_path"], "left_anti")
        before = known.select("project", F.col("path").alias("source_path"), F.col("generation").alias("_before"))
        bumped = fresh.select(*_LEAF).join(before, ["project", "source_path"], "left").withColumn(
            "generation", F.coalesce(F.col("_before"), F.lit(0)).cast("long") + 1
        ).drop("_before")
        leaves = stage(
            old.select(*_LEAF, "generation").unionByName(bumped).withColumn("module", module_of(F.col("source_path"))),
            "file-nodes",
        )

        projects = touched.select("project").distinct()
        tops = state.filter(F.col("module") == TOP).join(projects, "project", "left_semi")
        inner_before = stage(
            inside.filter("level = 'folder'").unionByName(tops).select("project", "node_id", "level", "title", "source_path", "parent_id", "source_hash", "confidence", "generation"),
            "inner-before",
        )
        rolled = delta_rollup(leaves, inner_before, dirty_ids(changed), touched)
        inner = diff.bump_generation(rolled, inner_before, "project").drop("changed", "depth").withColumn(
            "module", F.when(F.col("level") == "folder", module_of(F.concat("source_path", F.lit("/")))).otherwise(TOP)
        )
        _write(leaves.unionByName(inner, allowMissingColumns=True), root, "nodes", epoch)

        meta = leaves.select("project", "module", F.col("source_path").alias("path"), folder_of(F.col("source_path")).alias("folder"), F.col("links").alias("dependencies"))
        edges = graph.dependency_edges(meta).unionByName(graph.relationship_edges(meta))
        # A source is a path or a file node; either names its module.
        at = F.when(F.col("kind") == graph.EDGE, F.substring(F.col("source"), F.lit(6), F.length("source"))).otherwise(F.col("source"))
        _write(edges.withColumn("module", module_of(at)), root, "edges", epoch)

        impacted = changed.select("project", folder_of(F.col("path")).alias("folder")).distinct()
        lines = hierarchy.folder_summary_lines(meta.join(impacted, ["project", "folder"], "left_semi"))
        lines = lines.withColumn("module", module_of(F.concat("folder", F.when(F.col("folder") == "", "").otherwise("/"))))
        kept = read_state(spark, root, "folders").join(touched, ["project", "module"], "left_semi").join(impacted, ["project", "folder"], "left_anti")
        _write(lines.unionByName(kept.drop("epoch")), root, "folders", epoch)

        now = leaves.select("project", "module").distinct().unionByName(projects.withColumn("module", F.lit(TOP)))
        replaced = touched.unionByName(projects.withColumn("module", F.lit(TOP)))
        rows = commit.join(replaced, ["project", "module"], "left_anti").unionByName(now.withColumn("epoch", F.lit(epoch).cast("long")))
        sinks.commit_snapshot(rows, commit_path(root), epoch)

    return rebuild
