"""Substring de-duplication by relative Lempel-Ziv parsing.

The representatives of repeated regions (see ``repeats``) form reference blocks: a block holds all distinct texts around its anchors
and an index of every ``width``-word sequence in them.  Each text of the block is parsed greedily against the block: the longest
run of words that a reference continues is a factor.  After a factor the parse goes on with the first sequence that the factor does not hold whole,
so sequences across a factor boundary are looked up as well.  Factors of ``width`` words or more, after comparison of their bytes, are duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.repeats import Windows, covered, with_repeats
from corpusloom.llm.windows import byte_codes, gram_hashes, range_hashes, words

WIDTH = 35
GRAM = 10


def parse_judge(width: int):
    def judge(strings: list[bytes], h: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
        found = np.zeros((len(strings), int(size.max()) + 1), bool)
        block = b"".join(strings)
        data = np.frombuffer(block, np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
        starts, stops, first = words(data, ends)
        sequences = gram_hashes(range_hashes(byte_codes(data), starts, stops), width)
        at = np.concatenate([np.arange(a, a + n + 1) for a, n in zip(first[:-1], size)])
        text = np.repeat(np.arange(len(strings)), size + 1)
        # The index: every sequence of the block; each one's reference is the first other place that holds it.
        order = np.argsort(sequences[at], kind="stable")
        value = sequences[at][order]
        new = np.append(True, value[1:] != value[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        other = np.where(new, np.minimum(np.arange(len(order)) + 1, len(order) - 1), head)
        reference = np.full(len(at), -1)
        has = value[other] == value
        has &= other != np.arange(len(order))
        reference[order[has]] = order[other[has]]
        # A factor goes on while the reference does, inside both texts.
        goes_on = (reference[1:] >= 0) & (reference[1:] == reference[:-1] + 1) & (text[1:] == text[:-1])
        goes_on &= text[reference[1:]] == text[reference[:-1]]
        begins = (reference >= 0) & ~np.append(False, goes_on)
        heads = np.flatnonzero(begins)
        breaks = np.flatnonzero(~np.append(goes_on, False))
        tails = breaks[np.searchsorted(breaks, heads)]
        for a, b in zip(heads.tolist(), tails.tolist()):
            x, y, n = at[a], at[reference[a]], b - a + width - 1
            if block[starts[x] : stops[x + n]] == block[starts[y] : stops[y + n]]:
                found[text[a], x - first[text[a]] : x - first[text[a]] + b - a + 1] = True
        return found

    return judge


def _finish(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(3)]
            for text, spans in zip(batch.column(1), batch.column(2)):
                found = (text.as_py() or "").encode().split()
                gone = covered(len(found), spans, width)
                removed = int(gone.sum())
                kept = b" ".join(x for x, out in zip(found, gone.tolist()) if not out) if removed else b" ".join(found)
                for column, value in zip(rows, (len(found), removed, hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in rows[:2]), pa.array(rows[2], pa.string())],
                names=["id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: (id, n_words, n_removed, kept_sha256).

    Each word covered by ``width`` consecutive words that also start anywhere else is removed, sequences being judged on the input.
    Null and empty texts have no words.  Of repeated rows each is the other's copy.  A text of fewer words keeps all.
    An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    marked = with_repeats(docs, Windows("words", width, gram), parse_judge(width), None, id_col, text_col)
    return marked.mapInArrow(_finish(width), f"id {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)
