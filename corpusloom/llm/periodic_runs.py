"""Periodic runs of words, found in tiles scaled to the period.

Periods are taken by octave, ``scale <= period < 2 * scale``.  A document is exploded into overlapping tiles of every octave, whose size
grows with the scale; boundaries stand in a tile at every half scale, so that each run of the octave holds one with ``GRAM`` matches after
it.  Tiles are shuffled one by one and solved alone: at a boundary, the Z-function of the words after it gives for every period how far
they match the words one period later, and the Z-function of the reversed words before it how far back.  Together these are a fragment
of a run, cut off where the tile ends.  The fragments are shuffled by document and period, and those that touch are stitched.

A boundary is worth solving only if the ``GRAM`` words after it occur again one period later, so tiles without such a boundary are not
emitted, nor those where the words between are themselves a repetition, which belongs to a lower octave.  Both leave out no run.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.windows import byte_codes, gram_hashes, mixed, range_hashes, slices, text_buffers, words
from corpusloom.session import stage

LEAST_WORDS = 12
GRAM = 5
TILE_WORDS = 4096
_SEND_WORDS = 1 << 21
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def z_values(s: list[int]) -> list[int]:
    """For every position, how many items from there on equal the items from the start on."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
    return z


def _least_matches(period: int, least: int) -> int:
    """Matches of words one period apart that a run has at least."""
    return max(least - period, period)


def reach(scale: int, least: int) -> int:
    """How far a tile goes beyond its boundaries."""
    return max(2 * scale, least)


def tiles(codes: np.ndarray, grams: np.ndarray, least: int = LEAST_WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(scale, first word, codes, boundaries in the tile) of a document.

    ``grams`` are hashes of every ``GRAM`` words; two that collide cost time and change nothing.
    """
    n = len(codes)
    order = np.argsort(grams, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = grams[order[1:]] != grams[order[:-1]]
    kind = np.cumsum(new)
    place = kind << 32 | order  # sorted: the places of each gram, in order
    own = np.zeros(len(order), np.int64)
    own[order] = kind
    back = np.zeros(len(order), np.int64)  # words until the gram occurs again, 0 if it does not
    back[order[:-1]] = np.where(new[1:], 0, np.diff(order))
    # Words from here on that match those `back` later, at least: further on as long as the distance stays.
    change = np.append(np.flatnonzero(np.diff(back)), len(back) - 1)
    matching = change[np.searchsorted(change, np.arange(len(back)))] - np.arange(len(back)) + GRAM
    scale = 1
    while 2 * scale <= n:
        at = np.arange(0, len(grams), max(1, scale // 2))
        at = at[back[at] > 0]
        low, high = (np.searchsorted(place, own[at] << 32 | at + k * scale) for k in (1, 2))
        found = np.repeat(np.arange(len(at)), high - low)
        if len(found):
            nth = np.arange(len(found)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            edge = at[found]
            period = (place[low[found] + nth] & (1 << 32) - 1) - edge
            step = back[edge]
            repeats = (step < period) & (period % step == 0) & (period <= step + matching[edge])
            edges = np.unique(edge[~repeats])
            size, beyond = max(8 * scale, TILE_WORDS), reach(scale, least)
            for group in np.split(edges, np.flatnonzero(np.diff(edges // size)) + 1) if len(edges) else ():
                first = max(0, int(group[0]) - beyond)
                yield scale, first, codes[first : int(group[-1]) + 2 * scale + beyond], group - first
        scale *= 2


def _prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] * (n > 1)


def solve(scale: int, codes: list[int], boundaries: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(period, first, end): where words of the tile match those one period later, around its boundaries.

    Only periods of the octave whose root is no repetition itself, and only if the matches suffice for a run.
    """
    beyond, found = reach(scale, least), defaultdict(list)
    for c in boundaries:
        after = z_values(codes[c : c + 2 * scale + beyond])
        periods = [p for p in range(scale, min(2 * scale, len(after))) if after[p] >= GRAM]
        if not periods:
            continue
        start, stop = max(0, c - beyond), min(len(codes), c + 2 * scale)
        before = z_values(codes[start:c][::-1] + [-1] + codes[start:stop][::-1])
        for p in periods:
            # Reversed, the word before c + p stands stop - c - p after the separator.
            behind = before[c - start + 1 + stop - c - p] if c + p <= stop else 0
            if behind + after[p] >= _least_matches(p, least) and not any(after[p // r] >= p - p // r for r in _prime_factors(p) if p > 1):
                found[p].append((c - behind, c + after[p]))
    merged = []
    for p, spans in found.items():
        low, high = spans[0]
        for a, b in spans[1:]:  # boundaries ascend, but a fragment may reach back beyond the last one
            if a <= high:
                low, high = min(low, a), max(high, b)
            else:
                merged.append((p, low, high))
                low, high = a, b
        merged.append((p, low, high))
    return merged


def _explode(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, texts, kind = batch.column(0), batch.column(2), batch.column(1).type
            data, offsets = text_buffers(texts)
            for low, high in slices(offsets):
                piece = data[offsets[low] : offsets[high]]
                at = offsets[low : high + 1] - offsets[low]
                begins, ends, first = words(piece, at)
                tokens = range_hashes(byte_codes(piece), begins, ends)
                grams = gram_hashes(tokens, GRAM)
                owner = np.repeat(np.arange(high - low), np.diff(first))[: len(grams)]
                inside = np.arange(len(grams)) + GRAM <= first[owner + 1]
                keyed = mixed(grams ^ mixed(owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[inside]
                order = np.argsort(keyed)
                again = order[1:][keyed[order[1:]] == keyed[order[:-1]]]
                repeating = set(np.unique(owner[inside][again]).tolist())
                documents, found, size = [], [], 0
                for i in range(high - low):
                    body = b" ".join(piece[at[i] : at[i + 1]].tobytes().split())
                    mine = []
                    if i in repeating:
                        ids: dict[bytes, int] = {}
                        codes = np.fromiter((ids.setdefault(w, len(ids)) for w in body.split()), np.int32, first[i + 1] - first[i])
                        mine = list(tiles(codes, grams[first[i] : first[i + 1] - GRAM + 1], least))
                    documents.append((low + i, None if mine else hashlib.sha256(body).hexdigest(), body if mine else None))
                    found += [(low + i, *tile) for tile in mine]
                    size += sum(len(tile[2]) for tile in mine)
                    if size > _SEND_WORDS:
                        yield _batch(uid, batch.column(1), kind, documents, found)
                        documents, found, size = [], [], 0
                yield _batch(uid, batch.column(1), kind, documents, found)

    return run


def _batch(uid: pa.Array, ids: pa.Array, kind: pa.DataType, documents: list, found: list) -> pa.RecordBatch:
    """Rows of documents, then rows of tiles, under one schema."""
    n, m = len(documents), len(found)
    rows = pa.array([d[0] for d in documents] + [t[0] for t in found], pa.int64())
    bare = pa.nulls(m, kind)
    return pa.RecordBatch.from_arrays(
        [
            uid.take(rows), pa.concat_arrays([ids.take(rows[:n]), bare]), pa.array([d[1] for d in documents] + [None] * m, pa.string()),
            pa.array([d[2] for d in documents] + [None] * m, pa.binary()), pa.array([None] * n + [t[1] for t in found], pa.int64()),
            pa.array([None] * n + [t[2] for t in found], pa.int64()), pa.array([None] * n + [t[3] for t in found], pa.list_(pa.int32())),
            pa.array([None] * n + [t[4] for t in found], pa.list_(pa.int64())),
        ],
        names=["uid", "id", "plain", "body", "scale", "first", "codes", "boundaries"],
    )


def _solve(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], []]
            for uid, scale, first, codes, boundaries in zip(*batch.columns):
                for period, low, high in solve(scale.as_py(), codes.values.tolist(), boundaries.values.tolist(), least):
                    for column, value in zip(rows, (uid.as_py(), period, first.as_py() + low, first.as_py() + high)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["uid", "period", "low", "high"])

    return run


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the words that stay: all but those in a run after its first period."""
    for batch in batches:
        shas = []
        for body, runs in zip(batch.column("body"), batch.column("runs")):
            kept = body.as_py().split()
            edge = np.zeros(len(kept) + 1, np.int64)
            for r in runs.as_py() or ():
                edge[r["start"] + r["period"]] += 1
                edge[r["start"] + r["length"]] -= 1
            stay = np.cumsum(edge[:-1]) == 0
            shas.append(hashlib.sha256(b" ".join(w for w, s in zip(kept, stay.tolist()) if s)).hexdigest())
        yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("uid", "id", "runs")], pa.array(shas, pa.string())], names=["uid", "id", "runs", "plain"])


def stitch(fragments: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(uid, start, length, period) of all runs, from fragments (uid, period, low, high) that overlap or touch."""
    order = W.partitionBy("uid", "period").orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = fragments.withColumn("opens", F.when(before >= F.col("low"), 0).otherwise(1))
    whole = opened.withColumn("nth", F.sum("opens").over(order)).groupBy("uid", "period", "nth").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    runs = whole.select("uid", "start", (F.col("high") - F.col("start") + F.col("period")).alias("length"), "period")
    long = runs.where(F.col("length") >= F.greatest(F.lit(least), 2 * F.col("period")))
    return long.groupBy("uid", "start", "length").agg(F.min("period").alias("period"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """One row per input row: (id, runs, collapsed_sha256).

    ``runs`` holds (start, length, period) of every stretch of words with smallest period ``period`` that no neighbouring word extends,
    of ``least`` words or more and two periods or more, by start and period; an empty list if there is none.  ``collapsed_sha256`` is the digest of
    the words that stay, joined by one space, if all words of a run after its first period go.  Null and empty texts have no words.
    Null ids and repeated rows are rows like any other.  A very long text is split into tiles; its words once pass through one task, its runs
    are one list.  An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cut = stage(
        rows.mapInArrow(
            _explode(least), f"uid long, id {kind}, plain string, body binary, scale long, first long, codes array<int>, boundaries array<long>"
        ),
        "run-tiles",
    )
    apart = cut.where("scale IS NOT NULL").select("uid", "scale", "first", "codes", "boundaries").repartition("uid", "scale", "first")
    found = stitch(apart.mapInArrow(_solve(least), "uid long, period long, low long, high long"), least)
    listed = found.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("sorted"))
    none = F.expr(f"cast(array() as {_RUNS})")
    runs = listed.select("uid", F.transform("sorted", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    tiled = cut.where("scale IS NULL AND body IS NOT NULL").select("uid", "id", "body").join(runs, "uid", "left")
    judged = tiled.select("uid", "id", "body", F.coalesce("runs", none).alias("runs")).mapInArrow(_collapse, f"uid long, id {kind}, runs {_RUNS}, plain string")
    plain = cut.where("scale IS NULL AND body IS NULL").select("uid", "id", none.alias("runs"), "plain")
    return plain.unionByName(judged).select(F.col("id").alias(id_col), "runs", F.col("plain").alias("collapsed_sha256"))
