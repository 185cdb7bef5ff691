"""The cooldown gate on a stream against a walk in time order."""

import datetime
import random

import pandas as pd

from pyspark.sql import functions as F

from corpusloom.streaming import gate

SCHEMA = "workspace_id string, seq long, at timestamp, weak boolean, is_chat boolean, enabled boolean, available boolean"
START = datetime.datetime(2024, 1, 1)


def _events():
    rng, at, rows = random.Random(8), {w: 0 for w in "abc"}, []
    for seq in range(600):
        w = rng.choice("aaabc")
        at[w] += rng.choice([0, 1, 30, 60, 119, 120, 500])
        gates = [rng.random() > 0.1 for _ in range(2)] + [rng.choice([True, True, True, None, False])]
        rows.append((w, seq, START + datetime.timedelta(seconds=at[w]), rng.choice([True, True, False, None]), *gates))
    return rows


def _walk(rows):
    ends, want = {}, {}
    for w, seq, at, weak, chat, enabled, available in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        closed = [reason for is_open, reason in ((chat, "non_chat_request"), (enabled, "disabled"), (available, "sync_unavailable")) if is_open is False]
        if closed:
            want[seq] = (False, closed[0])
        elif w in ends and at < ends[w]:
            want[seq] = (False, "cooldown_active")
        elif weak:
            want[seq] = (True, "weak_context")
            ends[w] = at + datetime.timedelta(seconds=120)
        else:
            want[seq] = (False, "context_sufficient")
    return want


def test_stream_with_restarts_equals_a_walk(spark, tmp_path):
    rows = _events()
    rng = random.Random(1)
    # Files by time of arrival: an event comes up to half an hour late.
    arrived = sorted(rows, key=lambda r: r[2] + datetime.timedelta(seconds=rng.randrange(1800)))
    source, out, checkpoint = (str(tmp_path / x) for x in ("events", "out", "checkpoint"))
    files = [arrived[i : i + 150] for i in range(0, len(arrived), 150)]
    beats = [[("", -1, START + datetime.timedelta(days=d), False, True, True, True)] for d in (40, 41)]
    seen = []
    for n, part in enumerate([*files, *beats]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if n % 2 or n >= len(files):  # stop and start again from the checkpoint
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            gate.run_gate(stream, out, checkpoint, 120, "31 minutes").awaitTermination()
            seen.append(gate.read_verdicts(spark, out).count())
    got = {r["seq"]: (r["fired"], r["reason"]) for r in gate.read_verdicts(spark, out).collect()}
    assert got == _walk(rows)
    assert gate.read_verdicts(spark, out).count() == len(rows) and 0 < seen[0] < len(rows)
    assert gate.read_verdicts(spark, out).filter(F.col("fired")).count() == sum(fired for fired, _ in got.values())


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _Map:
    def __init__(self):
        self.held = {}

    def keys(self):
        return list(self.held)

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]


class _Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return _Value()

    def getMapState(self, *_):
        return _Map()

    def registerTimer(self, at):
        self.timers.add(at)


class _Expiry:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_a_busy_workspace_waits_in_packed_buckets():
    rng = random.Random(4)
    rows = [("a", i, START + datetime.timedelta(seconds=rng.randrange(48 * 3600)), rng.random() < 0.7, rng.random() > 0.1, True, None) for i in range(20_000)]
    frame = pd.DataFrame(
        {
            "at_micros": [int((r[2] - START).total_seconds()) * 1_000_000 for r in rows], "seq": [r[1] for r in rows], "weak": [r[3] for r in rows],
            "gate": [None if r[4] else "non_chat_request" for r in rows],
        }
    )
    handle, processor = _Handle(), gate.CooldownGate(120)
    processor.init(handle)
    for part in range(0, len(frame), 5000):  # four batches
        list(processor.handleInputRows(("a",), iter([frame[part : part + 2500], frame[part + 2500 : part + 5000]]), None))
    assert len(processor.waiting.held) == 4 * 48  # a state row per batch and hour, none per event
    got = {}
    for at in sorted(handle.timers):
        for judged in processor.handleExpiredTimer(("a",), None, _Expiry(at)):
            assert judged["at_micros"].floordiv(3_600_000_000).nunique() <= 1
            got |= {s: (bool(f), r) for s, f, r in zip(judged["seq"], judged["fired"], judged["reason"])}
    assert got == _walk(rows) and not processor.waiting.held
