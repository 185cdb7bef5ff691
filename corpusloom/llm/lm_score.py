"""Language-model scores from log-frequency Bloom filters.

Counts of words and word pairs of the training texts are taken over all data: tasks send packed, locally summed ids by bucket, and
each bucket is summed in one place.  A count c is quantised to 1 + floor(log_BASE(c)), and a gram enters the filter once
for each level up to its own; a reader probes one level after the other until it misses.  So the filter holds counts in a few
bits a gram, errs only upwards, and rarely.  Filters are cut into buckets that are built apart, and are at most ``FILTER_BITS`` long
each: they are the only model that is broadcast, together with the exact counts of at most ``FREQUENT`` words, those of the highest levels, and
what the filter answers for at most ``OFTEN`` pairs, chosen alike: a common pair has many levels to probe and occurs in most texts.
Within a slice of texts each distinct id is looked up once, in order, as ids of one bucket lie side by side.

``P(w | v) = L(v) * count(v w) / count(v) + (1 - L(v)) * P(w)`` with ``P(w) = (count(w) + 0.1) / (N + 0.1 (V + 1))``.  ``L`` depends on the
level of ``v`` and is fitted by expectation maximisation on leave-one-out counts of all training tokens, gathered as one small histogram.
Numerators are rounded down and denominators up, so the probabilities of all words sum to at most one but for rare false hits.
Pairs seen once are not stored.  If a filter outgrows ``FILTER_BITS``, its lower levels go to a second one of any size: a file that each executor
fetches once and its tasks map into memory, so no count is lost and what is broadcast stays bounded.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.windows import byte_codes, gram_hashes, mixed, range_hashes, slices, text_buffers, words
from corpusloom.session import stage

BASE = 1.5
BUCKETS = 4096
PROBES = 5
BITS_PER_ENTRY = 10
FILTER_BITS = 1 << 28
FREQUENT = 1 << 18
OFTEN = 1 << 20
_ID_BITS = 60
_SEND_GRAMS = 3_000_000
_END = np.uint64(0x1F0E2D3C4B5A6978)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RATIOS = np.arange(-4, 9.01, 0.25)  # log10 steps of the fitting histogram


def level_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


#: The least and largest count of every level.
_LEVELS = 120
_LEAST = np.array([0.0, *np.ceil(BASE ** np.arange(_LEVELS) - 1e-6)])
_MOST = np.maximum(np.append(_LEAST[1:], np.inf) - 1, _LEAST)
_MOST[0] = 1


def _ids(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - _ID_BITS)


def token_ids(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, ids of all tokens, first token of each text + total) of each slice; every text ends in the end token."""
    for a, b in slices(offsets):
        piece = _LOWER[data[offsets[a] : offsets[b]]]
        starts, stops, ends = words(piece, offsets[a : b + 1] - offsets[a])
        tokens = np.insert(range_hashes(byte_codes(piece), starts, stops), ends[1:], _END)
        yield a, b, _ids(tokens), ends + np.arange(len(ends))


def pair_ids(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, position of the second token) of all pairs inside texts."""
    inside = np.ones(len(tokens), bool)
    inside[ends[:-1]] = False
    second = np.flatnonzero(inside)
    return _ids(gram_hashes(tokens, 2))[second - 1], second


@lru_cache(maxsize=4)
def _mapped(name: str) -> np.ndarray:
    """A file of the application, mapped: tasks of one machine share its pages."""
    return np.load(SparkFiles.get(name), mmap_mode="r")


@dataclass
class LogFrequencyFilter:
    bits: np.ndarray | str  # (buckets, bytes of one), or the name of a file that holds them
    least: int  # the level of the smallest stored count
    rest: LogFrequencyFilter | None = None  # the levels below ``least``
    often: tuple[np.ndarray, np.ndarray] | None = None  # ids, ascending, and what :meth:`probed` says of them

    @staticmethod
    def hashes(ids: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
        return h, (h >> np.uint64(33)) | np.uint64(1)

    def reached(self, ids: np.ndarray, level: int) -> np.ndarray:
        """Positions of the ids that were stored with this level; most others are dropped at the first probe."""
        if level < self.least and self.rest is not None:
            return self.rest.reached(ids, level)
        bits = _mapped(self.bits) if isinstance(self.bits, str) else self.bits
        width, flat = bits.shape[1], bits.reshape(-1)
        start, (h, step) = (ids >> np.uint64(_ID_BITS - 12)).astype(np.int64) * width, self.hashes(ids, level)
        at = np.arange(len(ids))
        for probe in range(PROBES):
            place = (h[at] + np.uint64(probe) * step[at]) % np.uint64(width * 8)
            byte = flat[start[at] + (place >> np.uint64(3)).astype(np.int64)]
            at = at[byte >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1]
        return at

    def levels(self, ids: np.ndarray) -> np.ndarray:
        """The quantised count of every id, 0 where it is not stored."""
        seen, back = np.unique(ids, return_inverse=True)
        if self.often is None or not len(self.often[0]):
            return self.probed(seen)[back]
        known, level = self.often
        slot = np.minimum(np.searchsorted(known, seen), len(known) - 1)
        out = level[slot].astype(np.int64)
        rest = np.flatnonzero(known[slot] != seen)
        out[rest] = self.probed(seen[rest])
        return out[back]

    def probed(self, ids: np.ndarray) -> np.ndarray:
        """The same, all read from the filter."""
        out = np.zeros(len(ids), np.int64)
        at, level = np.arange(len(ids)), self.least if self.rest is None else self.rest.least
        while len(at) and level < _LEVELS:
            at = at[self.reached(ids[at], level)]
            out[at] = level
            level += 1
        return out


@dataclass
class Model:
    total: int
    distinct: int
    frequent_ids: np.ndarray
    frequent_counts: np.ndarray
    single: LogFrequencyFilter
    pair: LogFrequencyFilter
    weights: np.ndarray  # by level of the first word

    def word_counts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(least count, largest count, exactly known): exact for frequent words, else as the filter has it."""
        seen, back = np.unique(ids, return_inverse=True)
        slot = np.minimum(np.searchsorted(self.frequent_ids, seen), max(0, len(self.frequent_ids) - 1))
        exact = self.frequent_ids[slot] == seen if len(self.frequent_ids) else np.zeros(len(seen), bool)
        low, high = np.zeros(len(seen)), np.zeros(len(seen))
        low[exact] = high[exact] = self.frequent_counts[slot[exact]]
        rest = np.flatnonzero(~exact)
        level = self.single.probed(seen[rest])
        low[rest], high[rest] = _LEAST[level], _MOST[level]
        return low[back], high[back], exact[back]


def _parts(model: Model, ids: np.ndarray, ends: np.ndarray, left_out: int):
    """(P(w), pair estimate, level of the word before; 0 at a text's first token, exact counts, exactly known)."""
    low, high, exact = model.word_counts(ids)
    single = (np.maximum(low - left_out, 0) + 0.1) / (model.total + 0.1 * (model.distinct + 1))
    pairs, second = pair_ids(ids, ends)
    count = np.maximum(_LEAST[model.pair.levels(pairs)] - left_out, 0)
    before = np.maximum(high[second - 1], 1)
    estimate, history = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    estimate[second] = np.minimum(count / np.maximum(before - left_out, 1), 1)
    history[second] = level_of(before)
    return single, estimate, history, low, exact


def _send_counts(order: int, known: Broadcast | None):
    """Rows (bucket, ids seen once, other ids, their counts): six bytes an id, summed over many texts."""
    def packed(kept: list[np.ndarray]) -> pa.RecordBatch:
        ids, counts = np.unique(np.concatenate(kept), return_counts=True)
        bucket = (ids >> np.uint64(_ID_BITS - 12)).astype(np.int64)
        tail = ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        rows: list[list] = [[], [], [], []]
        edges = np.searchsorted(bucket, np.arange(BUCKETS + 1))
        for x in np.flatnonzero(np.diff(edges)):
            a, b = edges[x], edges[x + 1]
            once = counts[a:b] == 1
            for column, value in zip(rows, (int(x), tail[a:b][once].tobytes(), tail[a:b][~once].tobytes(), counts[a:b][~once].astype("<u4").tobytes())):
                column.append(value)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds)], names=["bucket", "once", "more", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            for _, _, tokens, ends in token_ids(*text_buffers(batch.column(0))):
                if order == 1:
                    grams = tokens
                else:  # a pair seen twice has words seen twice
                    grams, second = pair_ids(tokens, ends)
                    often = np.zeros(len(tokens), bool)
                    often[known.value.reached(tokens, 2)] = True
                    grams = grams[often[second] & often[second - 1]]
                kept.append(grams)
                n += len(grams)
                if n >= _SEND_GRAMS:
                    yield packed(kept)
                    kept, n = [], 0
        if n:
            yield packed(kept)

    return run


def _sum_counts(least: int):
    def unpacked(tail: bytes, bucket: int) -> np.ndarray:
        raw = np.zeros((len(tail) // 6, 8), np.uint8)
        raw[:, :6] = np.frombuffer(tail, np.uint8).reshape(-1, 6)
        return raw.view("<u8").reshape(-1) | np.uint64(bucket << 48)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for bucket, once, more, n in zip(*(column.to_pylist() for column in batch.columns)):
                ids += [unpacked(once, bucket), unpacked(more, bucket)]
                counts += [np.ones(len(once) // 6, np.int64), np.frombuffer(n, "<u4").astype(np.int64)]
        every, weight = np.concatenate(ids), np.concatenate(counts)
        del ids, counts
        order = np.argsort(every)
        every, weight = every[order], weight[order]
        head = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight, head) if len(head) else weight
        kept = total >= least
        yield pa.RecordBatch.from_arrays([pa.array(every[head][kept].view(np.int64)), pa.array(total[kept])], names=["id", "n"])

    return run


def gram_counts(texts: DataFrame, order: int, known: Broadcast | None, least: int) -> DataFrame:
    """(id, n) of all words or pairs seen ``least`` times or more in the training texts."""
    shuffles = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.mapInArrow(_send_counts(order, known), "bucket int, once binary, more binary, counts binary")
    return stage(sent.repartition(min(BUCKETS, shuffles), "bucket").mapInArrow(_sum_counts(least), "id long, n long"), f"grams-{order}")


def _fill(size: int, least: int, most: int = _LEVELS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, level = batch.column(0).to_numpy().view(np.uint64), level_of(batch.column(1).to_numpy())
            for step in range(least, min(int(level.max(initial=0)), most) + 1):
                mine = ids[level >= step]
                bucket = (mine >> np.uint64(_ID_BITS - 12)).astype(np.int64)
                h, stride = LogFrequencyFilter.hashes(mine, step)
                spots = np.concatenate([bucket * size + ((h + np.uint64(x) * stride) % np.uint64(size)).astype(np.int64) for x in range(PROBES)])
                spots.sort()
                for part in np.split(spots, np.flatnonzero(np.diff(spots // size)) + 1) if len(spots) else []:
                    row = made.setdefault(int(part[0] // size), np.zeros(size // 8, np.uint8))
                    np.bitwise_or.at(row, part % size >> 3, (1 << (part & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([x.tobytes() for x in made.values()], pa.binary())], names=["bucket", "bits"])

    return run


def _level() -> Column:
    return F.floor(F.log(F.col("n")) / F.lit(float(np.log(BASE))) + 1e-9).cast("int") + 1


def _by_level(counts: DataFrame) -> dict[int, int]:
    """Grams of each level; at most ``_LEVELS`` rows."""
    return {row["level"]: row["n"] for row in counts.groupBy(_level().alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}


def _commonest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ascending, their counts) of the grams of the highest levels that are at most ``most`` together."""
    histogram, least = _by_level(counts), _LEVELS
    while least > 1 and sum(n for level, n in histogram.items() if level >= least - 1) <= most:
        least -= 1
    top = counts.where(_level() >= least).toArrow()  # at most ``most`` rows
    ids, n = top["id"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(ids)
    return ids[order], n[order]


def build_filter(counts: DataFrame, least_count: int, max_bits: int = FILTER_BITS) -> LogFrequencyFilter:
    """A filter of at most ``max_bits`` for the highest levels that fit, and the file of the rest if there is one."""
    histogram = _by_level(counts)
    lowest = least = int(level_of(np.array([least_count]))[0])
    entries = lambda low, high=_LEVELS: sum(n * (min(level, high) - low + 1) for level, n in histogram.items() if level >= low)
    size_of = lambda n: max(64, -(-n * BITS_PER_ENTRY // BUCKETS // 64) * 64)
    while entries(least) * BITS_PER_ENTRY > max_bits:
        least += 1
    size = size_of(entries(least))
    bits = np.zeros((BUCKETS, size // 8), np.uint8)
    _put(counts.where(_level() >= least).mapInArrow(_fill(size, least), "bucket int, bits binary"), bits)
    made = LogFrequencyFilter(bits, least)
    return made if least == lowest else replace(made, rest=_filter_file(counts, size_of(entries(lowest, least - 1)), lowest, least - 1, max_bits))


def _put(parts: DataFrame, bits: np.ndarray) -> None:
    found = parts.toArrow()
    for bucket, row in zip(found["bucket"].to_pylist(), found["bits"]):
        bits[bucket] |= np.frombuffer(row.as_buffer(), np.uint8)


def _filter_file(counts: DataFrame, size: int, least: int, most: int, max_bits: int) -> LogFrequencyFilter:
    """A filter of the levels from ``least`` to ``most``, written and handed on ``max_bits`` at a time."""
    spark = counts.sparkSession
    name = f"lm-filter-{uuid.uuid4().hex}.npy"
    path = Path(tempfile.mkdtemp(prefix="corpusloom-lm-")) / name
    bits = np.lib.format.open_memmap(path, "w+", np.uint8, (BUCKETS, size // 8))
    parts = stage(counts.where(_level() >= least).mapInArrow(_fill(size, least, most), "bucket int, bits binary"), "lm-filter")
    step = min(BUCKETS, max(1, max_bits // size))
    for first in range(0, BUCKETS, step):
        _put(parts.where(F.col("bucket").between(first, first + step - 1)), bits)
    bits.flush()
    del bits
    spark.sparkContext.addFile(str(path))
    return LogFrequencyFilter(name, least)


def _histogram(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = len(_RATIOS) + 1
        seen = np.zeros(_LEVELS * columns, np.int64)
        for batch in batches:
            for _, _, tokens, ends in token_ids(*text_buffers(batch.column(0))):
                single, estimate, history, _, _ = _parts(shared.value, tokens, ends, 1)
                with np.errstate(divide="ignore"):
                    ratio = np.digitize(np.log10(estimate / single), _RATIOS)
                seen += np.bincount(history * columns + ratio, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["slot", "n"])

    return run


def fitted_weights(histogram: dict[int, int], rounds: int = 60) -> np.ndarray:
    """Mixture weight of the pair estimate for every level of the first word, by expectation maximisation."""
    columns = len(_RATIOS) + 1
    ratio = np.append(0.0, 10 ** (_RATIOS + 0.125))
    weights = np.zeros(_LEVELS)
    for level in range(1, _LEVELS):
        n = np.array([histogram.get(level * columns + x, 0) for x in range(columns)], float)
        if n.sum():
            w = 0.5
            for _ in range(rounds):
                w = float((n * (w * ratio / (w * ratio + 1 - w))).sum() / n.sum())
                w = min(max(w, 1e-6), 1 - 1e-6)
            weights[level] = w
    return weights


def train(texts: DataFrame, max_bits: int = FILTER_BITS, frequent: int = FREQUENT, often: int = OFTEN) -> tuple[Model, DataFrame]:
    """The model of a table with one column ``text``, and the exact word counts (id, n)."""
    context = texts.sparkSession.sparkContext
    counts = gram_counts(texts, 1, None, 1)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    single = build_filter(counts, 1, max_bits)
    pairs = gram_counts(texts, 2, context.broadcast(single), 2)
    pair = build_filter(pairs, 2, max_bits)
    common, _ = _commonest(pairs, often)
    pair.often = common, pair.probed(common).astype(np.uint8)
    model = Model(total, distinct, *_commonest(counts, frequent), single, pair, np.zeros(_LEVELS))
    seen = texts.mapInArrow(_histogram(context.broadcast(model)), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # bounded
    model.weights = fitted_weights({row["slot"]: row["n"] for row in seen})
    return model, counts


def _score(shared: Broadcast):
    """Rows of a text (row, held_out, ...) and rows of its words that are not frequent (row, word, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            size = batch.num_rows
            n_tokens, known, base, score = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
            words_of, ids_of, count_of = [], [], []
            for a, b, tokens, ends in token_ids(*text_buffers(batch.column(2))):
                single, estimate, history, counts, exact = _parts(model, tokens, ends, 0)
                weight = model.weights[history]
                logs = np.log10(weight * estimate + (1 - weight) * single)
                owner = np.repeat(np.arange(a, b), np.diff(ends))
                n_tokens[a:b] = np.diff(ends)
                known[a:b] = np.bincount(owner[exact] - a, minlength=b - a)
                base[a:b] = np.bincount(owner[exact] - a, np.log10(counts[exact] + 0.1), minlength=b - a)
                score[a:b] = np.bincount(owner - a, logs, minlength=b - a)
                rest = np.flatnonzero(~exact)
                order = rest[np.lexsort((tokens[rest], owner[rest]))]
                new = np.append(True, (tokens[order][1:] != tokens[order][:-1]) | (owner[order][1:] != owner[order][:-1])) if len(order) else np.zeros(0, bool)
                head = np.flatnonzero(new)
                words_of.append(owner[order][head])
                ids_of.append(tokens[order][head])
                count_of.append(np.diff(np.append(head, len(order))))
            numbers = np.arange(row, row + size)
            row += size
            none = lambda n, kind: pa.nulls(n, kind)
            names = ["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "word", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column(0), batch.column(1), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(score), none(size, pa.int64()), none(size, pa.int64())], names=names)
            if words_of:
                at, ids, n = np.concatenate(words_of), np.concatenate(ids_of), np.concatenate(count_of)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[at]), none(len(at), batch.column(0).type), none(len(at), pa.bool_()), *(none(len(at), x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(ids.view(np.int64)), pa.array(n)], names=names)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = FILTER_BITS, frequent: int = FREQUENT, often: int = OFTEN) -> DataFrame:
    """One row per input row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Rows whose CRC-32 of the id as text is divisible by 10 are held out, the others train.  A null id counts as the empty text, which is
    held out; null and empty texts have the end token alone.  Repeated rows train and are scored each for itself.  Without training rows every
    probability is that of an unseen word.  An empty table gives no rows; other columns are not read.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0
    texts = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    model, counts = train(texts.where("NOT held_out").select("text"), max_bits, frequent, often)
    rows = stage(
        texts.mapInArrow(
            _score(spark.sparkContext.broadcast(model)),
            f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, word long, n long",
        ),
        "lm-rows",
    )
    rare = rows.where("word IS NOT NULL").select("row", "word", "n").join(counts.select(F.col("id").alias("word"), F.col("n").alias("c")), "word", "left")
    rest = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more_base"),
    )
    below = float(np.log10(model.total + 0.1 * (model.distinct + 1)))
    return rows.where("word IS NULL").join(rest, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"), "score",
    )
