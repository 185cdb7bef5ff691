"""Alignment of two tokenizers over a corpus.

Every text is encoded by both; byte offsets where a token of each ends cut its tokens into groups.  Most groups are one token of A and
one of B with the same bytes.  For these an array from A ids to B ids is prepared once: their counts are kept in a vector as long as
A's vocabulary, one per task, and never become pairs.  Only the links of other groups enter the pair shuffle, pre-aggregated
per document and per task.  What every task needs back is bounded by the vocabularies: the summed vector, the highest count of each B id,
and at most ``hot`` pairs that hold more than 1 / ``hot`` of the irregular links.  The links of rarer pairs are joined by pair.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stage

#: The byte-level vocabulary as ranks; ids equal those of ``byte_bpe_50k.json`` with special strings as plain text.
A_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
HOT = 1 << 18
_SLICE_CHARS = 1 << 20
_FOUND = "uid long, id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_n array<long>, odd array<long>, odd_n array<long>"


class Vocabularies:
    """Both encoders, the bytes of their tokens and the array from A ids to the B ids of the same bytes (-1: none)."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        size = self.b.get_piece_size()
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(size)
        ]
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        by_bytes: dict[bytes, int] = {}
        for i, token in enumerate(self.b_bytes):
            if not self.b.is_byte(i) or token not in by_bytes:
                by_bytes[token] = i
        self.same = np.array([by_bytes.get(token, -1) for token in self.a_bytes], np.int64)
        self.names = [f"{i}{end}" for ids, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(ids))]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of every text, empty where the tokens' bytes are not a space and the text."""
        a, b = [self.a.encode_ordinary(" " + t) if t else [] for t in texts], self.b.encode(texts, num_threads=1) if texts else []
        for i, text in enumerate(texts):
            whole = b" " + text.encode()
            if not text or b"".join(map(self.a_bytes.__getitem__, a[i])) != whole or b"".join(map(self.b_bytes.__getitem__, b[i])) != whole:
                a[i], b[i] = [], []
        return a, b


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


def _per_text(keys: np.ndarray, width: int, texts: int) -> tuple[pa.ListArray, pa.ListArray]:
    """Distinct values and their numbers by text, from keys text * width + value."""
    values, n = np.unique(keys, return_counts=True)
    ends = pa.array(np.searchsorted(values, np.arange(texts + 1) * width), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(values % width)), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int64)))


def align(vocab: Vocabularies, texts: list[str]) -> tuple[list[pa.Array], np.ndarray]:
    """Columns n_a, n_b, n_groups, n_links, groups_sha256, same, same_n, odd, odd_n of some texts, and the counts of same links by A id."""
    a_ids, b_ids = vocab.encode(texts)
    n, sizes = len(texts), (len(vocab.a_bytes), len(vocab.b_bytes))
    n_a, n_b = np.array([len(x) for x in a_ids], np.int64), np.array([len(x) for x in b_ids], np.int64)
    a, b = np.fromiter((i for x in a_ids for i in x), np.int64, n_a.sum()), np.fromiter((i for x in b_ids for i in x), np.int64, n_b.sum())
    # Texts are laid end to end: both tokenizers cover the same bytes of each, so a text's end is an end of both.
    a_end, b_end = np.cumsum(vocab.a_length[a]), np.cumsum(vocab.b_length[b])
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    last_a, last_b = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
    a_first, b_first = np.concatenate([[0], last_a + 1]), np.concatenate([[0], last_b + 1])
    text_of = np.repeat(np.arange(n), n_a)[last_a] if len(cuts) else np.zeros(0, np.int64)
    # The tokens in the order of the written groups: those of A, then those of B, group by group.
    order = np.empty(len(a) + len(b), np.int64)
    a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_last[last_a] = 1
    b_last[last_b] = 1
    order[np.arange(len(a)) + b_first[a_group]] = a + a_last * sizes[0]
    order[np.arange(len(b)) + a_first[b_group + 1]] = b + b_last * sizes[1] + 2 * sizes[0]
    names, at, shas = vocab.names, np.concatenate([[0], np.cumsum(n_a + n_b)]), []
    for low, high in zip(at[:-1], at[1:]):
        written = "".join(map(names.__getitem__, order[low:high].tolist()))
        shas.append(hashlib.sha256(written[:-1].encode()).hexdigest() if written else "")
    # Of a group, the last token of A and the last of B end together; they are its link.
    link_a, link_b = a[last_a], b[last_b]
    single = (np.diff(a_first) == 1) & (np.diff(b_first) == 1) & (vocab.same[link_a] == link_b)
    same, same_n = _per_text(text_of[single] * sizes[0] + link_a[single], sizes[0], n)
    pairs = sizes[0] * sizes[1]
    odd, odd_n = _per_text(text_of[~single] * pairs + link_a[~single] * sizes[1] + link_b[~single], pairs, n)
    groups = pa.array(np.bincount(text_of, minlength=n))
    columns = [pa.array(n_a), pa.array(n_b), groups, groups, pa.array(shas, pa.string()), same.cast(pa.list_(pa.int32())), same_n, odd, odd_n]
    return columns, np.bincount(link_a[single], minlength=sizes[0])


def _encode(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabularies(a_path, b_path)
        totals, kind, names = np.zeros(len(vocab.a_bytes), np.int64), None, None
        for batch in batches:
            texts, kind = [t or "" for t in batch.column(2).to_pylist()], batch.column(1).type
            names = ["uid", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "odd", "odd_n"]
            first = 0
            while first < len(texts):
                last, chars = first, 0
                while last < len(texts) and (last == first or chars + len(texts[last]) <= _SLICE_CHARS):
                    chars += len(texts[last])
                    last += 1
                columns, counted = align(vocab, texts[first:last])
                totals += counted
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), *columns], names=names)
                first = last
        if kind is not None:  # the task's vector, as a row without a text
            has = np.flatnonzero(totals)
            none = [pa.array([None], pa.int64()), pa.array([None], kind), *[pa.array([None], pa.int64())] * 4, pa.array([None], pa.string())]
            lists = [pa.array([has.tolist()], pa.list_(pa.int32())), pa.array([totals[has].tolist()], pa.list_(pa.int64())), *[pa.array([None], pa.list_(pa.int64()))] * 2]
            yield pa.RecordBatch.from_arrays([*none, *lists], names=names)

    return run


def _settle(counts: Broadcast, width: int):
    """Links of known count become sums; pairs that are not among the hot ones are left as lists."""

    def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[at[1:]] - total[at[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, counted, best, hot, hot_n = counts.value
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(name)) for name in ("same", "same_n", "odd", "odd_n")]
            ids, n, odd, odd_n = (x.flatten().to_numpy() for x in lists)
            ids_at, odd_at = (np.concatenate([[0], np.cumsum(x.value_lengths().fill_null(0).to_numpy())]) for x in (lists[0], lists[2]))
            n_best, total = sums(n * (counted[ids] == best[same[ids]]), ids_at), sums(n * counted[ids], ids_at)
            slot = np.minimum(np.searchsorted(hot, odd), max(len(hot) - 1, 0))
            known = hot[slot] == odd if len(hot) else np.zeros(len(odd), bool)
            count = np.where(known, hot_n[slot] if len(hot) else 0, 0)
            n_best += sums(odd_n * (known & (count == best[odd % width])), odd_at)
            total += sums(odd_n * count, odd_at)
            left = np.concatenate([[0], np.cumsum(~known)])
            ends = pa.array(left[odd_at], pa.int32())
            rare, rare_n = (pa.ListArray.from_arrays(ends, pa.array(x[~known])) for x in (odd, odd_n))
            plain = [batch.column(i) for i in range(7)]
            yield pa.RecordBatch.from_arrays([*plain, pa.array(n_best), pa.array(total), rare, rare_n], names=[*batch.schema.names[:7], "n_best", "count_sum", "odd", "odd_n"])

    return run


def align_tokenizers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = A_PATH, b_path: str = B_PATH, hot: int = HOT,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of tokenizer A (byte-level ranks) and tokenizer B (pieces).

    ``documents`` has one row per input row: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).  A link is a token of A and a
    token of B whose byte ranges end together, so a group has one, its last tokens.  ``n_best`` counts the links whose pair is as frequent
    over all documents as any pair of its B id, ties included; ``count_sum`` adds up the counts.  ``pairs`` is (a_id, b_id, n), all links
    of the corpus.  Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and
    an empty digest.  Null ids and repeated rows are rows like any other and all count.  An empty table gives no rows; other
    columns are not read.  A text is encoded whole, so one text must fit a worker.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    vocab = vocabularies(a_path, b_path)
    width = len(vocab.b_bytes)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = stage(rows.mapInArrow(_encode(a_path, b_path), _FOUND.format(kind)), "align-links")
    texts, vectors = found.where("uid IS NOT NULL"), found.where("uid IS NULL")
    totals = vectors.select(F.explode(F.arrays_zip("same", "same_n")).alias("x")).groupBy("x.same").agg(F.sum("x.same_n").alias("n")).toArrow()  # at most A's vocabulary
    counted = np.zeros(len(vocab.a_bytes), np.int64)
    counted[totals["same"].to_numpy()] = totals["n"].to_numpy()
    pairs = stage(texts.select(F.explode(F.arrays_zip("odd", "odd_n")).alias("x")).groupBy(F.col("x.odd").alias("pair")).agg(F.sum("x.odd_n").alias("n")), "align-pairs")
    highest = pairs.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("n")).toArrow()  # at most B's vocabulary
    best = np.zeros(width, np.int64)
    best[highest["b"].to_numpy()] = highest["n"].to_numpy()
    has = np.flatnonzero(counted)
    np.maximum.at(best, vocab.same[has], counted[has])
    limit = (pairs.agg(F.sum("n")).first()[0] or 0) / hot
    often = pairs.where(F.col("n") > limit).orderBy("pair").toArrow()  # fewer than `hot` rows, for they hold more than 1 / hot each
    counts = spark.sparkContext.broadcast((vocab.same, counted, best, often["pair"].to_numpy(), often["n"].to_numpy()))
    settled = stage(
        texts.mapInArrow(_settle(counts, width), f"uid long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, odd array<long>, odd_n array<long>"),
        "align-settled",
    )
    top = spark.createDataFrame(pa.table({"b": np.arange(width), "best": best}))
    rare = settled.select("uid", F.explode(F.arrays_zip("odd", "odd_n")).alias("x")).select("uid", F.col("x.odd").alias("pair"), F.col("x.odd_n").alias("times"))
    judged = rare.join(pairs.where(F.col("n") <= limit), "pair").join(F.broadcast(top), (F.col("pair") % width) == F.col("b"))
    late = judged.groupBy("uid").agg(
        F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("late_best"), F.sum(F.col("n") * F.col("times")).alias("late_sum")
    )
    documents = settled.drop("odd", "odd_n").join(late, "uid", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("late_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("late_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
    same = spark.createDataFrame(pa.table({"a_id": has, "b_id": vocab.same[has], "n": counted[has]}), "a_id long, b_id long, n long")
    every = same.unionByName(pairs.select(F.floor(F.col("pair") / width).alias("a_id"), (F.col("pair") % width).alias("b_id"), "n"))
    return documents, every
