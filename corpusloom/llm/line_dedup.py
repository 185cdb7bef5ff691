"""Line de-duplication in content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines ends a chunk of ``MIN_LINES`` lines or more where it is divisible by ``DIVISOR``, so
boundaries move with the text when lines are inserted before it; a shorter rest joins the chunk before.  Chunks of several lines are counted by a 128-bit digest over all documents; the texts of
repeated ones are then compared byte by byte, and every copy but the first is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stage

DIVISOR = 3
MIN_LINES = 2


def chunks(text: str | None, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> list[list[bytes]]:
    """The lines of each chunk, in order; together they are the text.  Only a text of fewer lines has a chunk of fewer than ``min_lines``."""
    lines = (text or "").encode().split(b"\n")
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        rolling = (hashes[i - 1] * 0x9E3779B97F4A7C15 + hashes[i]) & (1 << 64) - 1 if i else hashes[i]
        if len(now) >= min_lines and (rolling >> 17) % divisor == 0:
            out.append(now)
            now = []
    if len(now) < min_lines and out:
        out[-1] += now
    elif now:
        out.append(now)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _digests(divisor: int, min_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(4)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for nth, chunk in enumerate(chunks(text.as_py(), divisor, min_lines)):
                    if len(chunk) >= min_lines:
                        digest = xxhash.xxh3_128_intdigest(b"\n".join(chunk))
                        for column, value in zip(rows, (key, nth, _signed(digest >> 64), _signed(digest & (1 << 64) - 1))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["key", "nth", "d1", "d2"])

    return run


def _texts(divisor: int, min_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            ids = []
            for i, (text, key, wanted) in enumerate(zip(batch.column("text"), batch.column("key").to_pylist(), batch.column("repeated").to_pylist())):
                cut = chunks(text.as_py(), divisor, min_lines)
                for x in wanted:
                    ids.append(i)
                    for column, value in zip(rows, (key, x["nth"], x["d1"], x["d2"], b"\n".join(cut[x["nth"]]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(ids, pa.int64())), *(pa.array(x, pa.int64()) for x in rows[:4]), pa.array(rows[4], pa.binary())],
                names=["id", "key", "nth", "d1", "d2", "chunk"],
            )

    return run


def _finish(divisor: int, min_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for text, gone in zip(batch.column("text"), batch.column("gone").to_pylist()):
                cut, out = chunks(text.as_py(), divisor, min_lines), set(gone or ())
                kept = [line for nth, chunk in enumerate(cut) if nth not in out for line in chunk]
                lines = sum(map(len, cut))
                for column, value in zip(rows, (lines, len(cut), len(out), lines - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(x, pa.int64()) for x in rows[:4]), pa.array(rows[4], pa.string())],
                names=["id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", "kept_sha256"],
            )

    return run


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """One row per input row: (id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, kept_sha256).

    Of equal chunks of ``min_lines`` lines or more the first in order of (id, position) stays; null ids come last.  Kept lines are joined by
    newlines.  A null or empty text is one empty line.  Rows that agree in id and text are one document and get one result.  Chunks that
    share a digest but not their bytes all stay.  An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    found = stage(texts.select("key", "text").mapInArrow(_digests(divisor, min_lines), "key long, nth long, d1 long, d2 long"), "line-chunks")
    often = found.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = found.join(often, ["d1", "d2"], "left_semi")
    lists = repeated.groupBy("key").agg(F.collect_set(F.struct("nth", "d1", "d2")).alias("repeated"))
    # The texts are shuffled once: both joins below use the same exchange.
    dealt = texts.repartition(shuffles, "key")
    copies = dealt.join(lists.hint("shuffle_hash"), "key").select("id", "text", "key", "repeated").mapInArrow(
        _texts(divisor, min_lines), f"id {kind}, key long, nth long, d1 long, d2 long, chunk binary"
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "nth")).alias("first")
    compared = copies.groupBy("d1", "d2", "chunk").agg(first).groupBy("d1", "d2").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("texts"))
    owners = compared.where("texts = 1").select("d1", "d2", F.col("first.key").alias("own_key"), F.col("first.nth").alias("own_nth"))
    gone = repeated.join(owners, ["d1", "d2"]).where("key <> own_key OR nth <> own_nth").groupBy("key").agg(F.collect_set("nth").alias("gone"))
    return (
        dealt.join(gone.hint("shuffle_hash"), "key", "left").select("id", "text", "gone")
        .mapInArrow(_finish(divisor, min_lines), f"id {kind}, n_lines long, n_chunks long, n_removed_chunks long, n_removed_lines long, kept_sha256 string")
        .withColumnRenamed("id", id_col)
    )
