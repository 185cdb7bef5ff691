"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The test items are a stated query set: they are cut into blocks of at most ``BLOCK_BYTES`` of text, and each block travels to the
rows, so documents are never shuffled.  A first pass gathers which n-grams of the items occur in any document.  Each of these is a seed, so a
copy is found by any n-gram that its edits left whole.  Wherever a seed occurs, the passage around it is aligned with the item by word-level
Smith-Waterman; the score is the share of the best possible one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.rows import row_key
from corpusloom.session import stage

GRAM = 3
MIN_SCORE = 0.5
BLOCK_BYTES = 4 << 20
_CACHE_WORDS = 300_000
_MATCH, _MISMATCH, _GAP = 2, -1, -1
_EDGE_SIGNS = ".,;:!?\"'()[]{}<>*&%$#-_"


def plain(word: str) -> str:
    """Lower case without signs at the ends; the word itself if nothing would be left."""
    lowered = word.lower()
    return lowered.strip(_EDGE_SIGNS) or lowered


class Items:
    """The word ids and n-grams of one block of test items."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words = [], []
        for item, text in rows:
            coded = [self.vocabulary.setdefault(plain(w), len(self.vocabulary) + 1) for w in (text or "").split()]
            if coded:
                self.ids.append(item)
                self.words.append(np.array(coded, np.int64))

    def grams(self, words: np.ndarray) -> np.ndarray:
        """Packed n-grams; shorter sequences have one of all words.  0 where a word is in no item."""
        if len(words) < GRAM:
            return np.zeros(0, np.int64)
        packed = np.zeros(len(words) - GRAM + 1, np.int64)
        known = np.ones(len(packed), bool)
        for i in range(GRAM):
            part = words[i : i + len(packed)]
            packed = (packed << 21) | part
            known &= part > 0
        return np.where(known, packed, 0)

    def seeds(self, counts: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """gram -> [(item position, offset)] of all grams that occur in the documents."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            grams = self.grams(words)
            for i, gram in enumerate(grams.tolist()):
                if gram in counts:
                    found[gram].append((k, i))
        return dict(found)


class _Coder(dict):
    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = code = self.vocabulary.get(plain(word), 0)
        return code

    def code(self, text: str | None) -> np.ndarray:
        found = (text or "").split()
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(score, end) of the best local alignment; ``end`` is the passage position after it."""
    steps = np.arange(len(passage) + 1) * -_GAP
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == word, _MATCH, _MISMATCH), row[1:] + _GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps  # gaps in the passage
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def matches(words: np.ndarray, items: Items, seeds: dict[int, list[tuple[int, int]]], keys: np.ndarray, min_score: float) -> list[tuple[int, float, int, int]]:
    """(item position, score, first word, end word) of the best alignment with each item that reaches the score."""
    grams = items.grams(words)
    at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, grams), len(keys) - 1)] == grams) if len(keys) and len(grams) else []
    spots: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for position in at:
        for k, offset in seeds[int(grams[position])]:
            size = len(items.words[k])
            slack = size // 4 + 2
            spots[k].append((max(0, position - offset - slack), min(len(words), position - offset + size + slack)))
    found = []
    for k, spans in spots.items():
        item, best = items.words[k], (0.0, 0, 0)
        done: list[tuple[int, int]] = []
        for low, high in sorted(spans):  # overlapping passages become one
            if done and low <= done[-1][1]:
                done[-1] = (done[-1][0], max(high, done[-1][1]))
            else:
                done.append((low, high))
        for low, high in done:
            # No alignment matches more words than the passage has: this leaves out no passage that could reach the score.
            if np.isin(item, words[low:high]).sum() < min_score * len(item):
                continue
            score, end = align(item, words[low:high])
            if score / (_MATCH * len(item)) > best[0]:
                _, back = align(item[::-1], words[low : low + end][::-1])
                best = (score / (_MATCH * len(item)), low + end - back, low + end)
            if best[0] == 1:
                break
        if best[0] >= min_score:
            found.append((k, *best))
    return found


def _count(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(items.vocabulary)
        wanted = np.unique(np.concatenate([items.grams(w) for w in items.words] or [np.zeros(0, np.int64)]))
        totals = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for text in batch.column(0):
                grams = items.grams(coder.code(text.as_py()))
                if len(grams) and len(wanted):
                    slot = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
                    totals += np.bincount(slot[wanted[slot] == grams], minlength=len(wanted))
        has = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[has]), pa.array(totals[has])], names=["gram", "n"])

    return run


def _find(items: Items, seeds: dict[int, list[tuple[int, int]]], min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, keys = _Coder(items.vocabulary), np.array(sorted(seeds), np.int64)
        for batch in batches:
            row, item, score, first, end = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                for k, value, a, b in matches(coder.code(text.as_py()), items, seeds, keys, min_score):
                    for column, x in zip((row, item, score, first, end), (i, items.ids[k], value, a, b)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                names=["id", "item_id", "score", "first_word", "end_word"],
            )

    return run


def contaminations(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document row and test item that align: (id, item_id, score, first_word, end_word).

    ``score`` is the Smith-Waterman score over that of a verbatim copy; the words from ``first_word`` to before ``end_word`` are the copy.
    Items of fewer than three words have no seed and match nothing; null texts have no words.  Items that repeat match each
    for themselves, as do repeated rows; null ids are returned as such.  Empty tables give no rows; other columns are not read.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    schema = f"id {kind}, item_id long, score double, first_word long, end_word long"
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        chosen = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = Items(sorted(((row["item_id"], row["text"]) for row in chosen.select("item_id", "text").collect()), key=str))
        counted = texts.select("text").mapInArrow(_count(items), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        counts = {row["gram"]: row["n"] for row in counted.collect()}  # at most the n-grams of one block
        out = out.unionByName(texts.mapInArrow(_find(items, items.seeds(counts), min_score), schema))
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` without an aligned item; rows that share an id, null included, are decided each by its text."""
    keyed = docs.withColumn("__row", row_key(id_col, text_col))
    gone = stage(contaminations(keyed, benchmark, "__row", text_col, min_score).select(F.col("__row").alias("__gone")).distinct(), "leaks")
    return keyed.join(gone, keyed["__row"] == gone["__gone"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
