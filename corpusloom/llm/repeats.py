"""Finding every window of ``width`` tokens that occurs more than once, without shuffling windows.

1. Each text is cut into runs of windows with one anchor (see ``windows``); a run is shuffled as a few numbers, by the
   hash of its anchor.  Runs that repeat inside one batch are settled there, and a batch sends one of them on; runs that share a
   frequent anchor but differ are spread by their content.  So neither a large group of copies nor a frequent passage lands in one task.
2. Where runs with one anchor meet, equal runs are repeats in full.  Of the others, only those that share their anchor
   with a different run are open: part of their windows may repeat.  One representative of each distinct run is cut out of its text.
3. A judge decides the windows of the open runs inside shards that hold all distinct runs of an anchor.  An anchor with more than
   ``SHARD_RUNS`` distinct runs is cut by the distance from window to anchor, which equal windows share.

A document is known by a 64-bit hash of its id and text, so repeated rows and null ids need no care; rows that agree in both get equal
results, as each is the other's repeat.  Runs are compared by two 64-bit hashes in step 2 and by their bytes in step 3.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.windows import byte_codes, gram_hashes, minimizer_runs, range_hashes, slices, text_buffers, words
from corpusloom.session import stage

SHARD_RUNS = 4096
MOST_SLICES = 16
_SPREAD = 8  # distinct runs of an anchor in one batch from which they are spread by content
_SETTLED, _RUN, _MARK = 0, 1, 2
_ROUTED = "route long, kind int, h long, c long, key long, first long, size long, lead long"
_FOUND = "kind int, h long, key long, first long, size long, lead long, open boolean"


@dataclass(frozen=True)
class Windows:
    unit: str  # "bytes" or "words"
    width: int
    gram: int

    @property
    def span(self) -> int:
        return self.width - self.gram + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def text_runs(data: np.ndarray, offsets: np.ndarray, spec: Windows) -> tuple[np.ndarray, ...]:
    """(text, first window, windows - 1, anchor - first, anchor hash, content hash) of all runs; windows count from the text's first."""
    parts = []
    for a, b in slices(offsets):
        piece, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        values = byte_codes(piece)
        if spec.unit == "words":
            starts, stops, ends = words(piece, ends)
            values = range_hashes(values, starts, stops)
        grams = gram_hashes(values, spec.gram)
        text, first, last, anchor = minimizer_runs(grams, ends, spec.width, spec.gram)
        if len(text):
            content = range_hashes(values, first, last + spec.width)
            parts.append((text + a, first - ends[text], last - first, anchor - first, grams[anchor], content))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(column) for column in zip(*parts))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, rows of each group)."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([key[order][1:] != key[order][:-1] for key in keys], axis=0)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.bincount(group) if len(order) else np.zeros(0, np.int64)


def _first_of(group: np.ndarray) -> np.ndarray:
    first = np.zeros(len(group), bool)
    first[np.unique(group, return_index=True)[1]] = True
    return first


def _send_runs(spec: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _ROUTED.split(", ")]
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            text, first, size, lead, h, c = text_runs(*text_buffers(batch.column(1)), spec)
            if not len(text):
                continue
            key = keys[text]
            same, copies = _groups(c, h)
            repeated = copies[same] > 1
            shown = _first_of(same)  # one of each distinct run goes on
            alike, kinds = _groups(h[shown])
            spread = np.zeros(len(h), bool)
            spread[np.flatnonzero(shown)[kinds[alike] >= _SPREAD]] = True
            settled = np.flatnonzero(repeated)
            if len(settled):  # neighbouring runs of a text become one
                joins = (text[settled][1:] == text[settled][:-1]) & (first[settled][1:] == (first + size)[settled][:-1] + 1)
                head = np.append(True, ~joins)
                heads, tails = settled[head], settled[np.append(~joins, True)]
                zero = np.zeros(len(heads), np.int64)
                columns = [_signed(key[heads]), pa.array(zero + _SETTLED, pa.int32()), *(pa.array(zero),) * 2, _signed(key[heads]), pa.array(first[heads]), pa.array((first + size)[tails] - first[heads]), pa.array(zero)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            # A shown run that repeats in this batch is sent as two of its kind, so that it is known as such elsewhere.
            sent = np.flatnonzero(shown)
            route = np.where(spread[sent], c[sent], h[sent])
            mark = np.where(repeated[sent], -1, 1) * (lead[sent] + 1)
            columns = [_signed(route), pa.array(np.full(len(sent), _RUN), pa.int32()), _signed(h[sent]), _signed(c[sent]), _signed(key[sent]), pa.array(first[sent]), pa.array(size[sent]), pa.array(mark)]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            marked = np.unique(h[spread])
            if len(marked):
                zero = np.zeros(len(marked), np.int64)
                yield pa.RecordBatch.from_arrays([_signed(marked), pa.array(zero + _MARK, pa.int32()), _signed(marked), *(pa.array(zero),) * 5], names=names)

    return run


def _meet_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kept, marks = [], []
    for batch in batches:
        route, kind, h, c, key, first, size, lead = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        at = np.flatnonzero(kind == _SETTLED)
        if len(at):
            zero = np.zeros(len(at), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(zero + _SETTLED, pa.int32()), pa.array(zero), pa.array(key[at]), pa.array(first[at]), pa.array(size[at]), pa.array(zero), pa.array(zero > 0)], names=names)
        marks.append(h[kind == _MARK])
        at = kind == _RUN
        kept.append([x[at] for x in (route, h, c, key, first, size, lead)])
    if not kept:
        return
    route, h, c, key, first, size, lead = (np.concatenate(x) for x in zip(*kept))
    if not len(h):
        return
    known = np.isin(h, np.concatenate(marks)) | (route != h)
    weight = np.where(lead < 0, 2, 1)
    lead = np.abs(lead) - 1
    same, _ = _groups(c, h)
    total = np.bincount(same, weight)[same]
    shown = _first_of(same)
    alike, _ = _groups(h)
    kinds = np.bincount(alike, shown)[alike]
    shared = known | (kinds > 1)
    settled = np.flatnonzero((total > 1) & (weight == 1))
    reps = np.flatnonzero(shown & shared)
    for at, kind in ((settled, _SETTLED), (reps, _RUN)):
        columns = [pa.array(np.full(len(at), kind), pa.int32()), pa.array(h[at]), pa.array(key[at]), pa.array(first[at]), pa.array(size[at]), pa.array(lead[at]), pa.array(total[at] < 2)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _cut_out(spec: Windows):
    """Rows (h, slice, string, lead, key, first, size, open): the text of each representative, ``lead`` its token before the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                raw = (text.as_py() or "").encode()
                tokens = raw.split() if spec.unit == "words" else raw
                for x in runs.as_py():
                    lead, size, n = x["lead"], x["size"], x["slices"]
                    high = lead  # distances from window to anchor run from lead down to lead - size
                    while high >= lead - size:
                        part = high * n // spec.span
                        low = max(lead - size, -(-part * spec.span // n))
                        start = x["first"] + lead - high
                        piece = tokens[start : start + high - low + spec.width]
                        for column, value in zip(rows, (x["h"], part, b" ".join(piece) if spec.unit == "words" else piece, high, x["key"], start, high - low, x["open"])):
                            column.append(value)
                        high = low - 1
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds)], names=["h", "slice", "string", "lead", "key", "first", "size", "open"])

    return run


#: (strings, lead, size) of the runs of one shard -> for each run the windows (0..size) that also occur elsewhere in the shard, as a boolean matrix
Judge = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _judge(judge: Judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [batch for batch in batches if batch.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        h, lead, key, first, size = (table[x].to_numpy() for x in ("h", "lead", "key", "first", "size"))
        open_ = table["open"].to_numpy()
        found = judge(table["string"].to_pylist(), h, lead, size)
        edges = np.diff(np.pad(found & open_[:, None], ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, at = np.nonzero(edges == 1)
        _, until = np.nonzero(edges == -1)
        yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(first[row] + at), pa.array(until - at - 1)], names=["key", "first", "size"])

    return run


def with_repeats(docs: DataFrame, spec: Windows, judge: Judge, lead_bytes: int | None, id_col: str, text_col: str, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """(id, text, spans): every row with the ranges (first window, windows - 1) that also start elsewhere; null if none.

    ``lead_bytes``: shards are ranges of the first so many bytes at the anchor, cut at sampled splitters; None: shards by hash.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    sent = texts.select("key", "text").mapInArrow(_send_runs(spec), _ROUTED)
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stage(sent.repartition(shuffles, "route").mapInArrow(_meet_runs, _FOUND), "repeat-runs")
    reps = found.where(F.col("kind") == _RUN)
    crowded = reps.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_runs)
    slices_of = F.least(F.ceil(F.coalesce("n", F.lit(1)) / shard_runs), F.lit(min(MOST_SLICES, spec.span))).cast("int")
    lists = reps.join(crowded, "h", "left").groupBy("key").agg(
        F.collect_list(F.struct("h", "key", "first", "size", "lead", "open", slices_of.alias("slices"))).alias("runs")
    )
    # The texts are shuffled once: both joins below use the same exchange.  The lists are the hashed side.
    dealt = texts.repartition(shuffles, "key")
    strings = dealt.join(lists.hint("shuffle_hash"), "key").select("id", "text", "runs").mapInArrow(
        _cut_out(spec), "h long, slice int, string binary, lead long, key long, first long, size long, open boolean"
    )
    if lead_bytes is None:
        sharded = strings.repartition(shuffles, "h", "slice")
    else:
        sharded = strings.repartitionByRange(shuffles, F.substring("string", F.col("lead").cast("int") + 1, F.lit(lead_bytes)), "h", "slice")
    judged = sharded.mapInArrow(_judge(judge), "key long, first long, size long")
    spans = found.where(F.col("kind") == _SETTLED).select("key", "first", "size").unionByName(judged).groupBy("key").agg(
        F.collect_list(F.struct("first", "size")).alias("spans")
    )
    return dealt.join(spans.hint("shuffle_hash"), "key", "left").select("id", "text", "spans")


def covered(n_tokens: int, spans: pa.Scalar, width: int) -> np.ndarray:
    """Mask of the tokens in any of the windows."""
    depth = np.zeros(n_tokens + 1, np.int64)
    if spans.is_valid and len(spans):
        first, size = (spans.values.field(x).to_numpy() for x in ("first", "size"))
        np.add.at(depth, first, 1)
        np.add.at(depth, first + size + width, -1)
    return np.cumsum(depth[:-1]) > 0
