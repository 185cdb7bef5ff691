"""Files rolled up a folder, module, project and global hierarchy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.extract import bullet_lines
from ..session import ship_package, stage

LEVEL_RANK = {"file": 0, "folder": 1, "module": 2, "project": 3, "global": 4}
GLOBAL_ID = "global:default"


def file_nodes(parsed: DataFrame) -> DataFrame:
    """Leaf nodes of (project, path, hash, ...) rows."""
    path = F.col("path")
    return parsed.select(
        "project",
        F.concat(F.lit("file:"), path).alias("node_id"),
        F.lit("file").alias("level"),
        F.regexp_extract(path, r"[^/]*$", 0).alias("title"),
        path.alias("source_path"),
        F.when(path.contains("/"), F.concat(F.lit("folder:"), F.regexp_replace(path, r"/[^/]*$", "")))
        .otherwise("module:root").alias("parent_id"),
        F.col("hash").alias("source_hash"),
        *[c for c in ("confidence", "risk_level", "summary", "dependencies", "patterns", "symbols", "line_count", "links") if c in parsed.columns],
    )


def build_hierarchy(files: DataFrame) -> DataFrame:
    """Folder chain, module, project and global nodes of (project, path) rows (A5).

    Column ``height`` orders the bottom-up rounds: a node's children are all lower.
    """
    folders = files.select("project", F.regexp_extract("path", r"^(.*)/", 1).alias("folder")).distinct()
    parts = F.split("folder", "/")
    chain = (
        folders.filter("folder != ''")
        .select("project", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, 1, n))).alias("p"))
        .distinct()
    )
    folder_nodes = chain.select(
        "project",
        F.concat(F.lit("folder:"), F.array_join("p", "/")).alias("node_id"),
        F.lit("folder").alias("level"),
        F.concat(F.lit("Folder "), F.array_join("p", "/")).alias("title"),
        F.array_join("p", "/").alias("source_path"),
        F.when(F.size("p") == 1, F.concat(F.lit("module:"), F.get("p", F.lit(0))))
        .otherwise(F.concat(F.lit("folder:"), F.array_join(F.slice("p", 1, F.size("p") - 1), "/"))).alias("parent_id"),
        F.size("p").alias("depth"),
    )
    module = F.when(F.col("folder") == "", "root").otherwise(F.substring_index("folder", "/", 1))
    modules = folders.select("project", module.alias("m")).distinct().select(
        "project", F.concat(F.lit("module:"), "m").alias("node_id"), F.lit("module").alias("level"),
        F.concat(F.lit("Module "), "m").alias("title"), F.col("m").alias("source_path"),
        F.concat(F.lit("project:"), "project").alias("parent_id"), F.lit(0).alias("depth"),
    )
    projects = folders.select("project").distinct().select(
        "project", F.concat(F.lit("project:"), "project").alias("node_id"), F.lit("project").alias("level"),
        F.concat("project", F.lit(" Knowledge")).alias("title"), F.lit("/").alias("source_path"),
        F.lit(GLOBAL_ID).alias("parent_id"), F.lit(-1).alias("depth"),
    )
    top = projects.select(
        "project", F.lit(GLOBAL_ID).alias("node_id"), F.lit("global").alias("level"),
        F.lit("Global Project Memory").alias("title"), F.lit("global").alias("source_path"),
        F.lit(None).cast("string").alias("parent_id"), F.lit(-2).alias("depth"),
    )
    return folder_nodes.unionByName(modules).unionByName(projects).unionByName(top)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per parent and batch of sorted children: 'id:hash|id:hash...' and the id it begins with."""
    for batch in batches:
        done = [
            (*key, rows["node_id"].iloc[0], "|".join(rows["node_id"] + ":" + rows["source_hash"]))
            for key, rows in batch.groupby(["project", "parent_id"], sort=False)
        ]
        yield pd.DataFrame(done, columns=["project", "parent_id", "first", "piece"])


def _feed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the pieces of each run of equal (project, parent), in input order; state is one open digest."""
    columns = ["project", "node_id", "source_hash"]
    open_key, digest = None, None
    for batch in batches:
        done: list[tuple[str, str, str]] = []
        for project, parent, piece in zip(batch["project"], batch["parent_id"], batch["piece"]):
            if (project, parent) == open_key:
                digest.update(b"|" + piece.encode("utf-8"))
                continue
            if open_key is not None:
                done.append((*open_key, digest.hexdigest()))
            open_key, digest = (project, parent), hashlib.sha256(piece.encode("utf-8"))
        yield pd.DataFrame(done, columns=columns)
    if open_key is not None:
        yield pd.DataFrame([(*open_key, digest.hexdigest())], columns=columns)


def child_pieces(children: DataFrame) -> DataFrame:
    """Children in id order, joined into pieces of a batch each.

    Ranges over (project, parent, id) split a parent that holds a third of all files among tasks, and each sorts its own range.
    """
    ship_package(children.sparkSession)
    order = ["project", "parent_id", "node_id"]
    ranged = children.select(*order, "source_hash").repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInPandas(_pieces, "project string, parent_id string, first string, piece string")


def _hash_parents(children: DataFrame) -> DataFrame:
    """One digest per parent over its children in id order.

    The digest is sequential by definition.  Its last pass sorts and feeds pieces, a thousandth of the rows.
    """
    pieces = child_pieces(children).repartition("project", "parent_id").sortWithinPartitions("project", "parent_id", "first")
    return pieces.mapInPandas(_feed, "project string, node_id string, source_hash string")


def rollup_levels(leaves: DataFrame, inner: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Merkle hash, confidence and child count of every inner node, bottom up (A3, A4).

    ``leaves`` are files, or any nodes whose hash and confidence stand.
    One round per level: deepest folders first, then modules, projects and the global node.
    Each round is staged, which keeps the plan flat and survives lost executors.
    """
    inner = stage(inner, "hierarchy")
    if max_depth is None:
        max_depth = inner.agg(F.coalesce(F.max("depth"), F.lit(-2))).first()[0]  # an empty table has one empty round
    carried = ["project", "node_id", "parent_id", "source_hash", "confidence"]
    parent = F.col("parent_id")
    slashes = F.length(parent) - F.length(F.replace(parent, F.lit("/"), F.lit("")))
    parent_depth = (
        F.when(parent.startswith("folder:"), slashes + 1).when(parent.startswith("module:"), 0).when(parent.startswith("project:"), -1).otherwise(-2)
    )
    below = stage(leaves.select(*carried, parent_depth.alias("parent_depth")), "leaves")
    rolled = above = None
    for depth in range(max_depth, -3, -1):
        # Children of a level: the files lying directly in it and the whole level beneath.
        kids = below.filter(F.col("parent_depth") == depth).select(*carried)
        kids = kids if above is None else kids.unionByName(above)
        level = inner.filter(F.col("depth") == depth)
        mean = F.sum(F.col("confidence").cast("decimal(20,4)")).cast("double") / F.count("*")
        totals = kids.groupBy("project", F.col("parent_id").alias("node_id")).agg(
            F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.40), mean)), 2).alias("confidence"),
            F.count("*").alias("child_count"),
        )
        done = stage(
            level.join(_hash_parents(kids), ["project", "node_id"], "left")
            .join(totals, ["project", "node_id"], "left")
            .withColumn("source_hash", F.coalesce("source_hash", F.sha2("node_id", 256)))
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.40)))
            .withColumn("child_count", F.coalesce("child_count", F.lit(0))),
            f"level-{depth + 2}",
        )
        rolled = done if rolled is None else rolled.unionByName(done)
        above = done.select(*carried)
    return rolled


def merkle_hash(files: DataFrame) -> DataFrame:
    """Inner nodes of (project, path, hash[, confidence]) rows with their Merkle hash (A4)."""
    rows = files if "confidence" in files.columns else files.withColumn("confidence", F.lit(0.6))
    return rollup_levels(file_nodes(rows), build_hierarchy(rows))


def ancestors(leaves: DataFrame) -> DataFrame:
    """(project, node_id, ancestor_id) of each leaf: all folders, module, project, global."""
    parts = F.split("source_path", "/")
    n_folders = F.size(parts) - 1
    folders = F.when(
        n_folders >= 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(n_folders, F.lit(1))),
            lambda n: F.concat(F.lit("folder:"), F.array_join(F.slice(parts, 1, n), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    module = F.concat(F.lit("module:"), F.when(n_folders >= 1, parts[0]).otherwise("root"))
    above = F.concat(folders, F.array(module, F.concat(F.lit("project:"), "project"), F.lit(GLOBAL_ID)))
    return leaves.withColumn("ancestor_id", F.explode(above))


def inherited_labels(leaves: DataFrame, column: str) -> DataFrame:
    """Distinct (project, node_id, label) an inner node inherits from its files (A3).

    Long form: a project may use more labels than one row should hold.
    """
    return (
        leaves.select("project", "source_path", F.explode(column).alias("label"))
        .transform(lambda d: ancestors(d))
        .select("project", F.col("ancestor_id").alias("node_id"), "label").distinct()
    )


def _first_k(df: DataFrame, order: str, k: int) -> DataFrame:
    w = W.partitionBy("project", "node_id").orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)


def file_versions(leaves: DataFrame, k: int = 300) -> DataFrame:
    """First ``k`` file versions of every inner node in path order, and the number of all its files (A3).

    Cutting at each level equals cutting once, since a cut keeps the smallest paths.
    """
    rows = ancestors(leaves.select("project", "source_path", "source_hash")).select(
        "project", F.col("ancestor_id").alias("node_id"), "source_path", "source_hash"
    )
    counts = rows.groupBy("project", "node_id").agg(F.count_distinct("source_path").cast("int").alias("file_count"))
    first = _first_k(rows, "source_path", k).groupBy("project", "node_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("source_path").alias("path"), F.col("source_hash").alias("hash"))))
        .alias("file_versions")
    )
    return counts.join(first, ["project", "node_id"])


def rollup_nodes(leaves: DataFrame) -> DataFrame:
    """Inner nodes with hash, confidence, versions, risk, counts and summary (A3-A5)."""
    inner = rollup_levels(leaves, build_hierarchy(leaves.select("project", F.col("source_path").alias("path"))))
    versions = file_versions(leaves)
    child_titles = _first_k(
        leaves.select("project", "parent_id", "node_id", "title")
        .unionByName(inner.select("project", "parent_id", "node_id", "title"))
        .select("project", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"), "title"),
        "child", 8,
    ).groupBy("project", "node_id").agg(F.array_sort(F.collect_list(F.struct("child", "title"))).alias("_kids"))

    def first_labels(column: str, k: int, name: str) -> DataFrame:
        return _first_k(inherited_labels(leaves, column), "label", k).groupBy("project", "node_id").agg(
            F.array_sort(F.collect_list("label")).alias(name)
        )

    none = F.array().cast("array<string>")
    joined = (
        inner.join(versions, ["project", "node_id"], "left")
        .join(child_titles, ["project", "node_id"], "left")
        .join(first_labels("dependencies", 10, "top_dependencies"), ["project", "node_id"], "left")
        .join(first_labels("patterns", 6, "patterns"), ["project", "node_id"], "left")
        .withColumn("top_dependencies", F.coalesce("top_dependencies", none))
        .withColumn("patterns", F.coalesce("patterns", none))
        .withColumn("file_count", F.coalesce("file_count", F.lit(0)))
        .withColumn("_titles", F.coalesce(F.transform("_kids", lambda k: k["title"]), none))
    )

    def section(title: str, column: str):
        return F.when(F.size(column) == 0, none).otherwise(
            F.concat(F.array(F.lit(title)), bullet_lines(F.col(column)))
        )

    summary = F.array_join(
        F.concat(
            F.array(
                F.concat(F.lit("Aggregated "), "level", F.lit(" knowledge.")),
                F.concat(F.lit("Child nodes: "), F.col("child_count").cast("string")),
            ),
            section("Core Components:", "_titles"),
            section("Dependencies:", "top_dependencies"),
            section("Architecture Patterns:", "patterns"),
        ),
        "\n",
    )
    risk = F.when(F.col("file_count") >= 25, "high").when(F.col("file_count") >= 8, "medium").otherwise("low")
    return joined.withColumn("risk_level", risk).withColumn("summary", summary).drop("_kids", "_titles")


def knowledge_tree(nodes: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """Nodes in project, level, path, id order; with ``drift`` (project, drift) the stale total of the project on each row.

    Nodes whose level is unknown are skipped.
    """
    ranks = F.create_map(*[F.lit(x) for pair in LEVEL_RANK.items() for x in pair])
    rows = nodes.withColumn("level_rank", F.try_element_at(ranks, F.col("level"))).filter("level_rank is not null")
    if drift is not None:
        rows = rows.join(drift.select("project", F.col("drift").alias("_stale")), "project", "left")
        rows = rows.withColumn("stale", F.coalesce("_stale", F.lit(0))).drop("_stale")
    return rows.orderBy("project", "level_rank", "source_path", "node_id")


def render_nodes(nodes: DataFrame) -> DataFrame:
    """Document text of every node."""
    none = F.array().cast("array<string>")
    deps = F.col("dependencies") if "dependencies" in nodes.columns else F.coalesce("top_dependencies", none)
    patterns = F.coalesce("patterns", none)
    body = F.when(F.trim(F.coalesce("summary", F.lit(""))) == "", "No summary available.").otherwise(F.trim("summary"))
    metadata = F.to_json(
        F.struct("node_id", "level", "title", "source_path", "source_hash", F.round("confidence", 2).alias("confidence"),
                 "generation", "risk_level", "parent_id", "summary"),
        {"pretty": "true"},
    )
    lines = F.concat(
        F.array(
            F.concat(F.lit("# "), "title"), F.lit(""),
            F.concat(F.lit("Level: "), "level"),
            F.concat(F.lit("Source: "), "source_path"),
            F.concat(F.lit("Confidence: "), F.format_number("confidence", 2)),
            F.concat(F.lit("Generation: "), F.col("generation").cast("string")),
            F.lit(""), F.lit("## Summary"), body, F.lit(""), F.lit("## Dependencies"),
        ),
        bullet_lines(deps),
        F.array(F.lit(""), F.lit("## Patterns")),
        bullet_lines(patterns),
        F.array(F.lit(""), F.lit("## Structured Metadata"), F.lit("```json"), metadata, F.lit("```")),
    )
    return nodes.withColumn("document", F.concat(F.array_join(lines, "\n"), F.lit("\n")))


# --- folder and project summaries --------------------------------------------------------


def folder_dependencies(meta: DataFrame, k: int = 20) -> DataFrame:
    """First ``k`` distinct dependencies of each folder, sorted (A1)."""
    rows = meta.select("project", F.col("folder").alias("node_id"), F.explode("dependencies").alias("dependency"))
    first = _first_k(rows.distinct(), "dependency", k)
    return first.groupBy("project", F.col("node_id").alias("folder")).agg(
        F.array_sort(F.collect_list("dependency")).alias("dependencies")
    )


def folder_summary(meta: DataFrame) -> DataFrame:
    """Per folder: file count and dependencies (A1).

    The file list itself stays long (:func:`folder_summary_lines`): a folder may hold more
    paths than one row should.
    """
    counts = meta.groupBy("project", "folder").agg(F.count("*").alias("file_count"))
    none = F.array().cast("array<string>")
    return counts.join(folder_dependencies(meta), ["project", "folder"], "left").withColumn(
        "dependencies", F.coalesce("dependencies", none)
    )


def folder_summary_lines(meta: DataFrame) -> DataFrame:
    """The folder documents, one row per line; order by (section, item)."""
    title = F.when(F.col("folder") == "", "root").otherwise(F.col("folder"))
    heads = meta.select("project", "folder").distinct().select(
        "project", "folder",
        F.inline(F.array(
            *[
                F.struct(F.lit(at).alias("section"), F.lit("").alias("item"), line.alias("line"))
                for at, line in (
                    (0, F.concat(F.lit("# "), title)), (1, F.lit("")), (2, F.lit("## Files")),
                    (4, F.lit("")), (5, F.lit("## Dependencies")),
                )
            ]
        )),
    )
    listed = meta.select(
        "project", "folder", F.lit(3).alias("section"), F.col("path").alias("item"),
        F.concat(F.lit("- "), "path").alias("line"),
    )
    deps = folder_summary(meta).select(
        "project", "folder", F.lit(6).alias("section"),
        F.explode(F.when(F.size("dependencies") == 0, F.array(F.lit("none"))).otherwise(F.col("dependencies"))).alias("item"),
    ).withColumn("line", F.concat(F.lit("- "), "item"))
    return heads.unionByName(listed).unionByName(deps)


def project_summary(meta: DataFrame, k: int = 30) -> DataFrame:
    """Per project: files, modules and the first ``k`` dependencies (A2)."""
    modules = meta.groupBy("project", "module").agg(F.count("*").alias("n"))
    counts = modules.groupBy("project").agg(F.sum("n").alias("file_count"), F.count("*").alias("module_count"))
    first = _first_k(
        meta.select("project", F.col("project").alias("node_id"), F.explode("dependencies").alias("dependency")).distinct(),
        "dependency", k,
    )
    deps = first.groupBy("project").agg(F.array_sort(F.collect_list("dependency")).alias("dependencies"))
    none = F.array().cast("array<string>")
    return counts.join(deps, "project", "left").withColumn("dependencies", F.coalesce("dependencies", none))


def coverage_check(files: DataFrame, expected: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """Expected extensions a project lacks, in long form."""
    from ..functions.paths import suffix_of

    present = files.select("project", suffix_of(F.col("path")).alias("extension")).distinct()
    return expected.join(present, ["project", "extension"], "left_anti")


def keyword_hits(files: DataFrame, keywords: list[str]) -> DataFrame:
    """Share of a fixed keyword list found in any path of the project."""
    low = F.lower(F.col("path"))
    found = [F.max(low.contains(k.lower()).cast("int")) for k in keywords]
    total = found[0]
    for extra in found[1:]:
        total = total + extra
    return files.groupBy("project").agg((total / F.lit(float(len(keywords)))).alias("hit_ratio"))
