"""Snapshots compared: changes, renames, generations, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import folder_of
from ..session import stage

EVENT_TYPES = ("created", "modified", "deleted", "renamed")


def snapshot_diff(current: DataFrame, previous: DataFrame, keys: tuple[str, ...] = ("project", "path")) -> DataFrame:
    """created / modified / deleted rows of two (keys, hash) snapshots."""
    now = current.select(*keys, F.col("hash").alias("current_hash"))
    before = previous.select(*keys, F.col("hash").alias("previous_hash"))
    event = (
        F.when(F.col("previous_hash").isNull(), "created")
        .when(F.col("current_hash").isNull(), "deleted")
        .when(F.col("current_hash") != F.col("previous_hash"), "modified")
    )
    return (
        now.join(before, list(keys), "full").withColumn("event_type", event).filter("event_type is not null")
    )


def pair_renames(changes: DataFrame, scope: str = "project") -> DataFrame:
    """The k-th deleted and the k-th created path of equal content become one rename.

    Ordinals count per (scope, hash) in path order.  A third of all files may share one
    hash (empty files), so no window runs over such a group: see :func:`_with_ordinals`.
    """
    moved = changes.filter(F.col("event_type").isin("created", "deleted")).withColumn(
        "hash", F.coalesce("current_hash", "previous_hash")
    )
    # Only hashes present on both sides can pair.
    both = (
        moved.groupBy(scope, "hash").agg(F.count_distinct("event_type").alias("_sides")).filter("_sides = 2")
        .select(scope, "hash")
    )
    pairable = _with_ordinals(moved.join(both, [scope, "hash"]), [scope, "hash", "event_type"], "path")
    side = [scope, "hash", "_ordinal"]
    created = pairable.filter("event_type = 'created'").select(*side, F.col("path"))
    deleted = pairable.filter("event_type = 'deleted'").select(*side, F.col("path").alias("previous_path"))
    return created.join(deleted, side).drop("_ordinal")


def _with_ordinals(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """Ordinal of each row within ``group`` by ``order``, without one task per group.

    Range partitioning on group and order splits any large group over tasks; rows are
    numbered within their range, and the ranges' counts give the offsets.  The ranged rows
    are staged, so that numbers and counts come from the same split even after a retry.
    """
    ranged = stage(
        df.repartitionByRange(*group, order).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    local = F.row_number().over(W.partitionBy(*group, "_range").orderBy(order))
    return (
        ranged.withColumn("_local", local).join(offsets, [*group, "_range"])
        .withColumn("_ordinal", F.col("_offset") + F.col("_local")).drop("_range", "_local", "_offset")
    )


def resolve_changes(changes: DataFrame, scope: str = "project") -> DataFrame:
    """Change events with renames paired off (J5 + J6)."""
    renames = pair_renames(changes, scope)
    gone = renames.select(scope, F.col("previous_path").alias("path"), F.lit("deleted").alias("event_type")).unionByName(
        renames.select(scope, "path", F.lit("created").alias("event_type"))
    )
    rest = changes.join(gone, [scope, "path", "event_type"], "left_anti").select(
        scope, "path", "event_type", F.lit(None).cast("string").alias("previous_path"), "previous_hash", "current_hash"
    )
    paired = renames.select(
        scope, "path", F.lit("renamed").alias("event_type"), "previous_path",
        F.col("hash").alias("previous_hash"), F.col("hash").alias("current_hash"),
    )
    return rest.unionByName(paired)


def change_counts(events: DataFrame, *keys: str) -> DataFrame:
    """Counts per event type and their total."""
    counts = [F.count_if(F.col("event_type") == e).alias(e) for e in EVENT_TYPES]
    return events.groupBy(*keys).agg(*counts, F.count("*").alias("changes_detected"))


def removed_rows(previous: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("project", "path")) -> DataFrame:
    """Previous rows whose key is gone."""
    return previous.join(current.select(*keys), list(keys), "left_anti")


def drift_count(current: DataFrame, previous: DataFrame, *scope: str) -> DataFrame:
    """New, changed and removed nodes between two node tables."""
    keys = [*scope, "node_id"]
    now = current.select(*keys, F.col("source_hash").alias("_now"))
    before = previous.select(*keys, F.col("source_hash").alias("_before"))
    drifted = ~F.col("_now").eqNullSafe(F.col("_before"))
    return now.join(before, keys, "full").groupBy(*scope).agg(F.count_if(drifted).alias("drift"))


def bump_generation(current: DataFrame, previous: DataFrame, *scope: str, force: bool = False) -> DataFrame:
    """Node rows with ``changed`` and the next ``generation``."""
    keys = [*scope, "node_id"]
    before = previous.select(
        *keys, F.col("source_hash").alias("_hash"), F.col("generation").alias("_generation"), F.lit(True).alias("_known")
    )
    changed = F.lit(force) | F.col("_known").isNull() | ~F.col("source_hash").eqNullSafe(F.col("_hash"))
    generation = F.when(changed, F.coalesce("_generation", F.lit(0)) + 1).otherwise(F.coalesce("_generation", F.lit(1)))
    return (
        current.drop("generation").join(before, keys, "left")
        .withColumn("changed", changed).withColumn("generation", generation.cast("long"))
        .drop("_hash", "_generation", "_known")
    )


def ingestion_report(current: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """Per project: scanned, changed, removed, regenerated files and folders.

    A project without previous files, and any project under ``force``, rebuilds all folders.
    """
    keys = ["project", "path"]
    now = current.select(*keys, F.col("hash").alias("_now"))
    before = previous.select(*keys, F.col("hash").alias("_before"))
    rows = now.join(before, keys, "full").withColumns(
        {
            "_folder": folder_of(F.col("path")),
            "_changed": F.col("_now").isNotNull() & (F.lit(force) | ~F.col("_now").eqNullSafe(F.col("_before"))),
            "_removed": F.col("_now").isNull(),
        }
    )
    # Folder rows first, so that the distinct count needs no wide set per project.
    folders = rows.groupBy("project", "_folder").agg(
        F.count("_now").alias("scanned"),
        F.count_if("_changed").alias("changed"),
        F.count_if("_removed").alias("removed"),
        F.count("_before").alias("known"),
    )
    present = F.col("scanned") > 0
    touched = (F.col("changed") > 0) | (F.col("removed") > 0)
    return folders.groupBy("project").agg(
        F.sum("scanned").alias("scanned_files"),
        F.sum("changed").alias("changed_files"),
        F.sum("removed").alias("removed_files"),
        F.sum("changed").alias("generated_file_summaries"),
        F.when(F.lit(force) | (F.sum("known") == 0), F.count_if(present)).otherwise(F.count_if(present & touched))
        .alias("generated_folder_summaries"),
    )


def impacted_folders(events: DataFrame) -> DataFrame:
    """Folders holding changed or removed files, both ends of a rename included."""
    ends = events.select("project", "path").unionByName(
        events.filter("previous_path is not null").select("project", F.col("previous_path").alias("path"))
    )
    return ends.select("project", folder_of(F.col("path")).alias("folder")).distinct()
