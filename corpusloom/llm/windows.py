"""Numpy kernels on the bytes of an Arrow batch: words, rolling hashes and minimizer runs.

A *window* is ``width`` consecutive tokens of one document (bytes or words).  Its
*anchor* is the token position inside it whose ``gram``-token hash is smallest, leftmost
on ties.  The anchor depends on the window's content alone, so equal windows have equal
anchors at equal offsets, and consecutive windows mostly share one.  A *run* is a maximal
range of window starts with one anchor: the unit that is shuffled instead of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Text bytes handled by one kernel call; a longer document makes a call of its own.
SLICE_BYTES = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for slot, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[slot] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise hashes so that all 64 bits are usable."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return total, down


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values; empty if there are fewer."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    total, down = _prefix(values)
    n = len(values) - size + 1
    return mixed((total[size:] - total[:n]) * down[:n])


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range of values."""
    total, down = _prefix(values)
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end, never across one of ``ends``.

    ``ends`` are offsets 0..len(data).  Returns (start byte, end byte, first word of each text + total).
    """
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    stops = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, stops, np.searchsorted(starts, ends)


def minimizer_runs(grams: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of texts laid end to end: (text, first window, last window, anchor).

    ``grams`` are the hashes of every ``gram`` tokens, ``ends`` the token offsets of the texts (0 first).
    """
    span, lengths = width - gram + 1, np.diff(ends)
    if len(grams) < span or not (lengths >= width).any():
        return (np.zeros(0, np.int64),) * 4
    low = np.uint64((1 << 24) - 1)
    if len(grams) >= 1 << 24:
        raise ValueError("a text of 16 million tokens must be cut before this kernel")
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step * 2 <= span:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if span > step:
        key = np.minimum(key[: len(key) - (span - step)], key[span - step :])
    counts = np.maximum(lengths - width + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    first_of = np.cumsum(counts) - counts
    window = np.arange(len(owner)) - first_of[owner] + ends[:-1][owner]
    anchor = (key[window] & low).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    until = np.append(at[1:], len(window)) - 1
    return owner[at], window[at], window[until], anchor[at]
