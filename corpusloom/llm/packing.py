"""Packing token sequences by minimum bin slack.

Documents are cut into full sequences and one remainder.  Only the histogram of remainder lengths (at most
``capacity - 1`` rows, whatever the input) reaches the driver.  There a bitset subset-sum picks, around the longest length left,
the multiset of lengths that comes closest to the capacity; backtracking gives the counts, and the multiset is repeated as often as
the histogram allows.  The plan goes back as a broadcast table with one row per length, and every piece finds its sequence by
its number among the pieces of that length, which is counted per bucket so that no length is one task's work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.session import stage

CAPACITY = 2048
END_ID = 1
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES_PER_BUCKET = 4096


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The byte-level BPE; ids equal those of ``byte_bpe_50k.json``, special token included."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def token_ids(text: str | None, path: str = VOCABULARY) -> np.ndarray:
    """Ids of a text and the end id, as little-endian unsigned 32-bit numbers."""
    ids = _encoder(path).encode(text, allowed_special="all") if text else []
    return np.array([*ids, END_ID], "<u4")


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for i, text in enumerate(batch.column(1)):
                ids = token_ids(text.as_py(), path)
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    for column, value in zip(rows, (i, start, len(part), zlib.crc32(part.tobytes()), len(ids))):
                        column.append(value)
            numbers = [pa.array(column, pa.int64()) for column in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(numbers[0]), *numbers[1:]], names=["id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return run


def fill(counts: dict[int, int], capacity: int) -> list[int]:
    """Counts of lengths that come closest to ``capacity`` from below and hold the longest one: [(length, copies), ...]."""
    lengths = sorted(counts, reverse=True)
    target = capacity - lengths[0]
    limit = (1 << target + 1) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > target:
            continue
        left, size = min(counts[length] - (length == lengths[0]), target // length), 1
        while left > 0:
            take = min(size, left)
            grown = (reach | reach << take * length) & limit
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            size *= 2
        if reach >> target & 1:
            break
    at = reach.bit_length() - 1
    used = {lengths[0]: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, last, copies, sequence, offset) that give every piece a place.

    Pieces ``first <= n < last`` of a length go ``copies`` to a sequence, from ``sequence`` on, laid from ``offset`` on.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        used = fill(left, capacity)
        times, offset = min(left[length] // n for length, n in used), 0
        for length, n in used:
            rows.append((length, taken[length], taken[length] + n * times, n, sequence, offset))
            taken[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
            offset += n * length
        sequence += times
    return rows


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str = VOCABULARY,
    pieces_per_bucket: int = PIECES_PER_BUCKET,
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Null and empty texts are the end id alone.  Null ids and repeated rows are packed like any other; pieces that agree in all
    columns may swap places.  A long text gives many full sequences and one remainder.  An empty table gives no rows; other
    columns are not read.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    pieces = stage(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            _pieces(path, capacity), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
        ),
        "pack-pieces",
    )
    histogram = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    buckets = max(1, -(-sum(histogram.values()) // pieces_per_bucket))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets)))
    inside = W.partitionBy("bucket", "length").orderBy("id", "start", "ids_crc32", "doc_tokens")
    before = dealt.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n")).select(
        "bucket", "length", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")
    )
    numbered = dealt.withColumn("nth", F.row_number().over(inside)).join(before, ["bucket", "length"]).withColumn(
        "nth", F.col("before") + F.col("nth") - 1
    )
    schema = "length long, first long, last long, copies long, sequence long, at long"
    places = spark.createDataFrame(plan(histogram, capacity), schema).groupBy("length").agg(
        F.collect_list(F.struct("first", "last", "copies", "sequence", "at")).alias("places")
    )
    placed = numbered.join(F.broadcast(places), "length").withColumn(
        "place", F.expr("filter(places, p -> nth >= p.first AND nth < p.last)[0]")
    )
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("place.sequence") + F.floor((F.col("nth") - F.col("place.first")) / F.col("place.copies"))).alias("sequence_id"),
        (F.col("place.at") + F.pmod(F.col("nth") - F.col("place.first"), F.col("place.copies")) * F.col("length")).alias("offset"),
    )
