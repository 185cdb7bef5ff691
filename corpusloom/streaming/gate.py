"""The cooldown gate as a stateful operator on a stream.

State is kept per workspace: the end of the running cooldown, and the events that wait until the watermark has passed them, in Arrow batches by
``BUCKET_SECONDS`` of event time.  A timer at the end of each bucket wakes the workspace when nothing earlier can come any more; then the
bucket's events are judged in time order, a step a firing.  A call holds one bucket of one workspace at a time.  So
the result is that of the batch operator, for any number of micro-batches and any disorder within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship_package
from .cooldown import gate_reason

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_RESULT = "workspace_id string, seq long, at_micros long, weak boolean, fired boolean, reason string"
_COLUMNS = [field.split()[0] for field in _RESULT.split(", ")]


#: Event time of one bucket of waiting events.
BUCKET_SECONDS = 3600
#: Waiting events that a call gathers before it stores them.
_HELD = 100_000
_WAITING = pa.schema([("at_micros", pa.int64()), ("seq", pa.int64()), ("weak", pa.bool_()), ("gate", pa.string())])


def judge(at: np.ndarray, weak: np.ndarray, gates: np.ndarray, cooldown: int, end: int | None) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(fired, reasons, cooldown end after them) of events in time order; a gate is None where it is open."""
    is_open = np.array([g is None for g in gates], bool)
    need = np.flatnonzero(is_open & weak)
    times, fires, starts = at[need], [], [] if end is None else [end - cooldown]
    next_one = 0 if end is None else int(np.searchsorted(times, end))
    while next_one < len(times):
        fires.append(need[next_one])
        end = int(times[next_one]) + cooldown
        next_one = max(next_one + 1, int(np.searchsorted(times, end)))
    fired = np.zeros(len(at), bool)
    fired[fires] = True
    # The firing before each event, or the one that the state remembers.
    begun = np.array([*starts, *at[fires]], np.int64)
    before = np.searchsorted(np.asarray(fires, np.int64), np.arange(len(at))) + len(starts) - 1
    cooled = np.zeros(len(at), bool)
    has = before >= 0
    cooled[has] = at[has] < begun[before[has]] + cooldown
    reasons = np.where(fired, "weak_context", np.where(cooled, "cooldown_active", "context_sufficient")).astype(object)
    reasons[~is_open] = gates[~is_open]
    return fired, reasons, end


class CooldownGate(StatefulProcessor):
    """Judges the events of one workspace in time order: gates first, then the cooldown, then the need."""

    def __init__(self, seconds: int, bucket_seconds: int = BUCKET_SECONDS) -> None:
        self.cooldown, self.width = seconds * 1_000_000, bucket_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("cooldown_end", "micros long")
        self.parts = handle.getValueState("parts", "n long")
        self.waiting = handle.getMapState("waiting", "bucket long, part long", "events binary")

    def _store(self, frames: list[pd.DataFrame]) -> None:
        events = pd.concat(frames, ignore_index=True)
        part = self.parts.get()[0] if self.parts.exists() else 0
        for bucket, rows in events.groupby(events["at_micros"] // self.width):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _WAITING) as writer:
                writer.write_table(pa.Table.from_pandas(rows[_WAITING.names], _WAITING, preserve_index=False))
            self.waiting.updateValue((int(bucket), part), (sink.getvalue().to_pybytes(),))
            self.handle.registerTimer(-(-(int(bucket) + 1) * self.width // 1000))
        self.parts.update((part + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in rows:
            if len(frame):
                held.append(frame)
                n += len(frame)
            if n >= _HELD:
                self._store(held)
                held, n = [], 0
        if held:
            self._store(held)
        yield pd.DataFrame(columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        ready: dict[int, list[int]] = {}
        for bucket, part in sorted((int(b), int(p)) for b, p in self.waiting.keys()):
            if (bucket + 1) * self.width <= until:
                ready.setdefault(bucket, []).append(part)
        end = self.end.get()[0] if self.end.exists() else None
        for bucket, parts in ready.items():
            tables = [pa.ipc.open_stream(self.waiting.getValue((bucket, part))[0]).read_all() for part in parts]
            events = pa.concat_tables(tables).sort_by([("at_micros", "ascending"), ("seq", "ascending")])
            at, weak = events["at_micros"].to_numpy(), events["weak"].to_numpy()
            fired, reasons, end = judge(at, weak, np.array(events["gate"].to_pylist(), object), self.cooldown, end)
            for part in parts:
                self.waiting.removeKey((bucket, part))
            if end is not None:
                self.end.update((end,))
            yield pd.DataFrame(
                {"workspace_id": key[0], "seq": events["seq"].to_pandas(), "at_micros": at, "weak": weak, "fired": fired, "reason": reasons}, columns=_COLUMNS
            )
        if not ready:
            yield pd.DataFrame(columns=_COLUMNS)

    def close(self) -> None:
        pass


def gate_events(events: DataFrame, seconds: int = 120, delay: str = "1 hour") -> DataFrame:
    """Streamed events (workspace_id, seq, at, weak[, is_chat, enabled, available]) with ``fired`` and ``reason``.

    A missing gate column is open.  Events that come later than ``delay`` behind the newest one are dropped by the watermark.
    The session needs the RocksDB state store (:func:`use_state_store`).
    """
    ship_package(events.sparkSession)
    flag = {c: F.coalesce(F.col(c), F.lit(True)) if c in events.columns else F.lit(True) for c in ("is_chat", "enabled", "available")}
    rows = events.withWatermark("at", delay).select(
        "workspace_id", "at", F.unix_micros("at").alias("at_micros"), "seq", F.coalesce("weak", F.lit(False)).alias("weak"), gate_reason(*flag.values()).alias("gate")
    )
    return rows.groupBy("workspace_id").transformWithStateInPandas(CooldownGate(seconds), _RESULT, "Append", "EventTime")


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)


def run_gate(events: DataFrame, out: str, checkpoint: str, seconds: int = 120, delay: str = "1 hour"):
    """Judge what is there and stop; each epoch's verdicts replace its own folder, so a repeated epoch adds nothing."""
    use_state_store(events.sparkSession)

    def land(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    judged = gate_events(events, seconds, delay)
    return judged.writeStream.foreachBatch(land).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heartbeat(like: DataFrame, at: str) -> DataFrame:
    """One event of no workspace at a time, in the columns of ``like``: it moves the watermark on a quiet stream."""
    made = {"workspace_id": F.lit(""), "at": F.to_timestamp(F.lit(at)), "weak": F.lit(False), "seq": F.lit(-1).cast("long")}
    return like.sparkSession.range(1).select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def read_verdicts(spark: SparkSession, out: str) -> DataFrame:
    """Everything judged so far, without heartbeats."""
    return spark.read.schema(_RESULT).option("recursiveFileLookup", "true").parquet(out).filter("workspace_id <> ''")
