"""Cooldown-gated trigger: fire on weak context, at most once per cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship_package, stage

_RESULT = "workspace_id string, seq long, at_micros long, weak boolean, fired boolean, reason string"


def gate_reason(is_chat: Column, enabled: Column, available: Column) -> Column:
    """Why an event can neither fire nor be cooled down, or null (order of R5)."""
    return (
        F.when(~is_chat, "non_chat_request").when(~enabled, "disabled").when(~available, "sync_unavailable")
    )


def _jumps(times: pd.Series, cooldown: int) -> list[int]:
    """Position of the first time at or after each time plus the cooldown; len when none."""
    values = times.to_numpy()
    return values.searchsorted(values + cooldown, side="left").tolist()


def cooldown_trigger(events: DataFrame, seconds: int = 120, bucket_seconds: int = 21600) -> DataFrame:
    """Events (workspace_id, seq, at, weak) with ``fired`` and ``reason``.

    Firing depends on the last firing, but only through the time the cooldown ends, so a
    busy workspace is cut into time buckets.  Within a bucket every possible entry time leads
    to one exit time; buckets compute that map in parallel, a short walk over the buckets of a
    workspace picks the real entries, and buckets then mark their events in parallel.  Rows of
    one workspace never meet in one task, only its bucket maps do.
    """
    ship_package(events.sparkSession)
    cooldown, width = seconds * 1_000_000, max(bucket_seconds, seconds) * 1_000_000
    rows = stage(
        events.select(
            "workspace_id", "seq", F.unix_micros(F.col("at").cast("timestamp")).alias("at_micros"), "weak"
        ).withColumn("bucket", F.floor(F.col("at_micros") / F.lit(width)).cast("long")),
        "cooldown",
    )

    def exits(frame: pd.DataFrame) -> pd.DataFrame:
        """(first time that can fire here, cooldown end it leads to) per distinct entry."""
        times = frame["at_micros"].drop_duplicates().sort_values().reset_index(drop=True)
        jump = _jumps(times, cooldown)
        ends = [0] * len(times)
        for i in range(len(times) - 1, -1, -1):
            ends[i] = ends[jump[i]] if jump[i] < len(times) else int(times[i]) + cooldown
        # An earlier cooldown reaches at most one cooldown into this bucket.
        start = int(frame["bucket"].iloc[0]) * width
        keep = int(times.searchsorted(start + cooldown, side="left")) + 1
        return pd.DataFrame(
            {
                "workspace_id": frame["workspace_id"].iloc[0], "bucket": int(frame["bucket"].iloc[0]),
                "entry": times[:keep].astype("int64"), "exit": ends[:keep],
            }
        )

    weak = rows.filter("weak")
    maps = weak.groupBy("workspace_id", "bucket").applyInPandas(
        exits, "workspace_id string, bucket long, entry long, exit long"
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cooldown end before each bucket; rows come sorted by workspace, bucket and entry."""
        workspace, end, bucket, taken = None, None, None, False
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.workspace_id != workspace:
                    workspace, end, bucket = row.workspace_id, None, None
                if row.bucket != bucket:
                    bucket, taken = row.bucket, False
                    out.append((workspace, bucket, end))
                if not taken and (end is None or row.entry >= end):
                    end, taken = row.exit, True
            yield pd.DataFrame(out, columns=["workspace_id", "bucket", "open_at"]).astype({"open_at": "Int64"})

    entries = stage(
        maps.repartition("workspace_id").sortWithinPartitions("workspace_id", "bucket", "entry")
        .mapInPandas(walk, "workspace_id string, bucket long, open_at long"),
        "cooldown-entries",
    )
    # A bucket without weak events inherits the end of the last one before it.
    known = rows.select("workspace_id", "bucket").distinct().join(entries, ["workspace_id", "bucket"], "left")

    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at_micros", "seq"]).reset_index(drop=True)
        opens = frame["open_at"].iloc[0]
        end = None if pd.isna(opens) else int(opens)
        fired, reasons = [], []
        for at, is_weak in zip(frame["at_micros"], frame["weak"]):
            if end is not None and at < end:
                fired.append(False)
                reasons.append("cooldown_active")
            elif is_weak:
                fired.append(True)
                reasons.append("weak_context")
                end = at + cooldown
            else:
                fired.append(False)
                reasons.append("context_sufficient")
        frame["fired"], frame["reason"] = fired, reasons
        return frame[["workspace_id", "seq", "at_micros", "weak", "fired", "reason"]]

    before = W.partitionBy("workspace_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    last_exit = _exit_of(maps, entries)
    opened = (
        known.join(last_exit, ["workspace_id", "bucket"], "left")
        .withColumn("open_at", F.coalesce("open_at", F.last("exit", ignorenulls=True).over(before)))
        .select("workspace_id", "bucket", "open_at")
    )
    return rows.join(opened, ["workspace_id", "bucket"]).groupBy("workspace_id", "bucket").applyInPandas(mark, _RESULT)


def _exit_of(maps: DataFrame, entries: DataFrame) -> DataFrame:
    """Cooldown end after each bucket, given the end before it."""
    can_enter = F.col("open_at").isNull() | (F.col("entry") >= F.col("open_at"))
    return (
        maps.join(entries, ["workspace_id", "bucket"])
        .groupBy("workspace_id", "bucket")
        .agg(F.coalesce(F.min_by("exit", F.when(can_enter, F.col("entry"))), F.max("open_at")).alias("exit"))
    )
