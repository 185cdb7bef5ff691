"""Dependency graphs: edges, seeds, bounded expansion, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import raise_group_limit, stage
from .relevance import lexical_match

MAP, EDGE = "map", "edge"  # an entry of the dependency map, or of the relationship list


def dependency_edges(meta: DataFrame) -> DataFrame:
    """(source path, target dependency) of every file (G1)."""
    return meta.select(
        "project", F.col("path").alias("source"), F.explode("dependencies").alias("target"),
        F.lit(MAP).alias("kind"), F.lit(None).cast("string").alias("relation"),
    )


def relationship_edges(meta: DataFrame) -> DataFrame:
    """file-module and file-symbol edges with their relation."""
    file_id = F.concat(F.lit("file:"), "path")
    to_module = meta.select(
        "project", file_id.alias("source"), F.concat(F.lit("module:"), "module").alias("target"),
        F.lit(EDGE).alias("kind"), F.lit("related_to").alias("relation"),
    )
    low = F.lower("d")
    to_symbol = meta.select("project", file_id.alias("source"), F.explode("dependencies").alias("d")).filter(
        F.trim("d") != ""
    ).select(
        "project", "source", F.concat(F.lit("symbol:"), "d").alias("target"), F.lit(EDGE).alias("kind"),
        F.when(low.contains("event") | low.contains("emit"), "emits").otherwise("uses").alias("relation"),
    )
    return to_module.unionByName(to_symbol)


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct nodes (id, kind, label) of relationship edges."""
    ids = edges.filter(F.col("kind") == EDGE).select("project", F.explode(F.array("source", "target")).alias("id")).distinct()
    return ids.select(
        "project", "id", F.substring_index("id", ":", 1).alias("kind"), F.regexp_replace("id", "^[^:]*:", "").alias("label")
    )


def relationship_graph(meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the relationship graph."""
    edges = relationship_edges(meta)
    return graph_nodes(edges), edges


def normalize_edges(edges: DataFrame) -> DataFrame:
    """Drop blank ends; a missing relation becomes 'related_to' (S8)."""
    source, target = F.trim("source"), F.trim("target")
    relation = F.when(F.trim(F.coalesce("relation", F.lit(""))) == "", "related_to").otherwise(F.trim("relation"))
    return edges.withColumns({"source": source, "target": target, "relation": relation}).filter(
        (F.col("source") != "") & (F.col("target") != "")
    )


def _neighbours(edges: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` smallest distinct neighbours of every node, in both directions."""
    both = edges.select(*keys, F.col("source").alias("node"), F.col("target").alias("neighbour")).unionByName(
        edges.select(*keys, F.col("target").alias("node"), F.col("source").alias("neighbour"))
    ).distinct()
    w = W.partitionBy(*keys, "node").orderBy("neighbour")
    return both.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def touching_edges(edges: DataFrame, visited: DataFrame, *keys: str) -> DataFrame:
    """Distinct (request, edge) with an end among the request's visited nodes."""
    nodes = visited.select("request_id", *keys, F.col("node"))
    columns = [c for c in edges.columns]
    by_source = edges.join(nodes.withColumnRenamed("node", "source"), [*keys, "source"])
    by_target = edges.join(nodes.withColumnRenamed("node", "target"), [*keys, "target"])
    wanted = ["request_id", *columns]
    return by_source.select(*wanted).unionByName(by_target.select(*wanted)).distinct()


def relation_histogram(edges: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """Edge counts per relation; per request when visited nodes are given."""
    listed = edges.filter(F.col("kind") == EDGE) if "kind" in edges.columns else edges
    if visited is None:
        return listed.groupBy("relation").agg(F.count("*").alias("edges"))
    return touching_edges(listed, visited).groupBy("request_id", "relation").agg(F.count("*").alias("edges"))


def seed_nodes(edges: DataFrame, requests: DataFrame, fallback: int = 3) -> DataFrame:
    """(request_id, node) to start from.

    A matching target seeds both ends.  A matching source seeds itself, and in the
    relationship list its target too.  A request matching nothing starts from the
    ``fallback`` smallest sources of the dependency map.  Terms meet distinct node names,
    never request-node pairs.
    """
    names = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    hits = lexical_match(requests, names, haystack=F.col("node"), min_rel=0.0).select(
        "request_id", "node"
    )
    ends = edges.select("source", "target", "kind").distinct()
    by_target = ends.join(hits.withColumnRenamed("node", "target"), "target").select("request_id", "source", "target")
    by_source = ends.filter(F.col("kind") == EDGE).join(hits.withColumnRenamed("node", "source"), "source").select(
        "request_id", "source", "target"
    )
    pairs = by_target.unionByName(by_source).select("request_id", F.explode(F.array("source", "target")).alias("node"))
    map_sources = ends.filter(F.col("kind") == MAP).select(F.col("source").alias("node")).distinct()
    seeded = pairs.unionByName(hits.join(map_sources, "node", "left_semi").select("request_id", "node")).distinct()
    if not fallback:
        return seeded
    first = [r["node"] for r in map_sources.orderBy("node").limit(fallback).collect()]
    idle = requests.select("request_id").join(seeded.select("request_id").distinct(), "request_id", "left_anti")
    start = F.array(*map(F.lit, first)) if first else F.array().cast("array<string>")
    return seeded.unionByName(idle.select("request_id", F.explode(start).alias("node")))


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2, max_nodes: int = 80) -> DataFrame:
    """Nodes reached within ``depth`` steps, at most ``max_nodes`` per request.

    Breadth first: nodes in queue order, neighbours in name order.  A node can add at most
    ``max_nodes`` neighbours and at most that many are already visited, so the smallest
    2 * max_nodes neighbours of a hub are all that can matter.  Every step is staged, since
    the next one reads it several times.  Seeds beyond the cap are
    all kept and nothing is added to them.
    """
    raise_group_limit(edges.sparkSession, 2 * max_nodes)
    near = stage(_neighbours(edges, [], 2 * max_nodes), "neighbours")
    # Requests at or over the cap keep their seeds and take no further part.
    order = W.partitionBy("request_id").orderBy("node")
    seeds = stage(seeds.select("request_id", "node").distinct(), "seeds")
    counts = seeds.groupBy("request_id").agg(F.count("*").alias("seeds"))
    open_seeds = seeds.join(counts.filter(F.col("seeds") < max_nodes), "request_id")
    visited = stage(
        open_seeds.select("request_id", "node", F.lit(0).alias("depth"), F.row_number().over(order).alias("place")),
        "frontier",
    )
    frontier = visited
    for step in range(1, depth + 1):
        reached = frontier.join(near, "node").select("request_id", F.col("neighbour").alias("node"), "place")
        fresh = (
            reached.join(visited.select("request_id", "node"), ["request_id", "node"], "left_anti")
            .groupBy("request_id", "node").agg(F.min("place").alias("parent_place"))
        )
        taken = visited.groupBy("request_id").agg(F.count("*").alias("taken"))
        queue = W.partitionBy("request_id").orderBy("parent_place", "node")
        frontier = stage(
            fresh.withColumn("_n", F.row_number().over(queue)).filter(F.col("_n") <= max_nodes)
            .join(taken, "request_id")
            .filter(F.col("_n") <= max_nodes - F.col("taken"))
            .select("request_id", "node", F.lit(step).alias("depth"), (F.col("_n") + F.col("taken")).cast("int").alias("place")),
            "frontier",
        )
        visited = visited.unionByName(frontier)
    full = seeds.join(counts.filter(F.col("seeds") >= max_nodes).select("request_id"), "request_id", "left_semi")
    return visited.select("request_id", "node", "depth").unionByName(
        full.select("request_id", "node", F.lit(0).alias("depth"))
    )


def node_system(node: Column) -> Column:
    """System a node names, or null."""
    name = (
        F.when(node.startswith("module:"), F.regexp_replace(node, "^module:", ""))
        .when(node.contains("/"), F.substring_index(node, "/", 1))
    )
    return F.when(name != "", name)


def is_dependency_node(node: Column) -> Column:
    return ~node.startswith("module:") & ~node.contains("/")


def classify_nodes(visited: DataFrame) -> DataFrame:
    """Visited nodes with their system and whether they name a dependency."""
    return visited.withColumns(
        {"system": node_system(F.col("node")), "is_dependency": is_dependency_node(F.col("node"))}
    )


def distinct_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Visited or blocked sets (U4)."""
    return df.select(*columns).distinct()
