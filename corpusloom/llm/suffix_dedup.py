"""Suffix-array de-duplication of byte strings.

Every 200-byte string that occurs twice contains the same anchor at the same distance, so it is enough to sort the suffixes that
start at anchors, and to the left of them the reversed prefixes.  Sampled splitters range-partition them by their
leading bytes; a bucket sorts both arrays by multikey quicksort with 8-byte characters and takes the common lengths of neighbours.
A window ``o`` bytes before its anchor repeats if another suffix agrees with it on ``width - o`` bytes and its prefix on ``o``:
both are intervals of the two sorted arrays.  Ranges never cut equal keys, so no comparison across a bucket's boundary is left open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.repeats import Windows, covered, with_repeats

WIDTH = 200
GRAM = 50


def multikey_order(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order of byte rows within their groups: quicksort by one 8-byte character, then only ties by the next."""
    characters = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    segment = group[order]
    todo = np.arange(len(order))
    for column in range(characters.shape[1]):
        if not len(todo):
            break
        part, key = order[todo], characters[order[todo], column]
        again = np.lexsort((key, segment[todo]))
        order[todo], key, kept = part[again], key[again], segment[todo][again]
        new = np.ones(len(todo), bool)
        new[1:] = (kept[1:] != kept[:-1]) | (key[1:] != key[:-1])
        # Positions stay as they are; a segment is named by its first position.
        name = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
        segment[todo] = name
        tied = np.zeros(len(todo), bool)
        tied[:-1] |= ~new[1:]
        tied |= ~new
        todo = todo[tied]
    return order


def _common(group: np.ndarray, rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row of the order shares with the one before it; -1 between groups."""
    shared = np.full(len(order), -1, np.int64)
    for a in range(1, len(order), 65_536):  # bounded memory
        here, before = order[a : a + 65_536], order[a - 1 : a - 1 + min(65_536, len(order) - a)]
        differ = rows[here] != rows[before]
        length = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        shared[a : a + 65_536] = np.where(group[here] == group[before], length, -1)
    return shared


def _rows(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x[:width].ljust(width, b"\0") for x in strings), np.uint8).reshape(len(strings), width)


def suffix_judge(width: int):
    def judge(strings: list[bytes], h: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
        _, group = np.unique(h, return_inverse=True)
        wide = -(-width // 8) * 8
        right = _rows([x[a:] for x, a in zip(strings, lead.tolist())], wide)
        left = _rows([x[:a][::-1] for x, a in zip(strings, lead.tolist())], wide)
        ranks = []
        for side in (right, left):
            order = multikey_order(group, side)
            ranks.append((order, _common(group, side, order)))
        found = np.zeros((len(strings), int(size.max()) + 1), bool)
        classes = [np.empty(len(strings), np.int64) for _ in range(2)]
        for o in range(int((lead - size).min()), int(lead.max()) + 1):
            valid = np.flatnonzero((lead >= o) & (lead - size <= o))
            if len(valid) < 2:
                continue
            for slot, ((order, shared), need) in enumerate(zip(ranks, (width - o, o))):
                classes[slot][order] = np.cumsum(shared < need)
            code = classes[0][valid] * (len(strings) + 1) + classes[1][valid]
            _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
            twice = valid[count[inverse] > 1]
            found[twice, lead[twice] - o] = True
        return found

    return judge


def _finish(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(4)]
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode()
                gone = covered(len(raw), spans, width)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                for column, value in zip(rows, (len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in rows[:3]), pa.array(rows[3], pa.string())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: (id, n_bytes, n_removed, n_spans, kept_sha256).

    Each byte covered by a ``width``-byte string that also starts anywhere else is removed, strings being judged on the input.
    Null and empty texts have no bytes.  Of repeated rows each is the other's copy.  A text shorter than the width keeps all.
    An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    marked = with_repeats(docs, Windows("bytes", width, gram), suffix_judge(width), 8, id_col, text_col)
    return marked.mapInArrow(_finish(width), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
