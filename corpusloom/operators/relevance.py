"""Substring relevance of prompts against a corpus, without comparing every pair and without moving the corpus.

The distinct terms of all requests form one multi-pattern automaton; their number saturates as requests are added.  The requests
themselves are an inverted list, term to requests, of a few bytes per entry.  Both are broadcast, in blocks whose size is counted first: a
second block is begun only where the lists or the vocabulary outgrow a bound.  Documents stream through the automaton where
they are read, one pass a block and no shuffle, and hits are counted per request inside the task.  Asked for the best documents
only, a task keeps so many per request and hands over no other pair.  The result does not depend on the number of blocks.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Characters of distinct terms in one block, and entries of its inverted list: what bounds a broadcast and the automaton of a task.
BLOCK_CHARS = 1_000_000
BLOCK_ENTRIES = 4_000_000
#: Pairs in one output batch; a document with more spreads over several rows.
OUTPUT_PAIRS = 100_000
#: Pairs that a task holds while it looks for the best of each request.
HELD_PAIRS = 1_000_000
#: Cells (request, value) of the table in which a task marks what documents have brought.
NEWS_CELLS = 1 << 26


class _Inverted:
    """The requests of one block as they are broadcast: ids, scopes, numbers of terms, vocabulary, and term to requests."""

    def __init__(self, rows: pa.Table, scoped: bool) -> None:
        self.ids = rows["request_id"].combine_chunks().cast(pa.string())
        listed = rows["terms"].combine_chunks()
        self.n_terms = listed.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        flat = listed.flatten().dictionary_encode()
        slots = flat.indices.to_numpy(zero_copy_only=False)
        self.vocabulary = flat.dictionary.to_pylist()
        owners = np.repeat(np.arange(len(self.n_terms)), self.n_terms)
        order = np.argsort(slots, kind="stable")
        self.users = owners[order].astype(np.int32)
        self.starts = np.searchsorted(slots[order], np.arange(len(self.vocabulary) + 1))
        self.scopes = rows["scope"].to_pylist() if scoped else None


class _Block:
    """A block with its automaton, as a task holds it."""

    def __init__(self, inverted: _Inverted) -> None:
        self.ids, self.n_terms, self.users = inverted.ids, inverted.n_terms, inverted.users
        self.first, self.times = inverted.starts[:-1], np.diff(inverted.starts)
        self.scope_codes: dict[str, int] | None = None
        if inverted.scopes is not None:
            self.scope_codes = {scope: code for code, scope in enumerate(sorted({s for s in inverted.scopes if s is not None}))}
            self.scope_of = np.array([self.scope_codes.get(s, -1) for s in inverted.scopes], np.int64)
        self.automaton = ahocorasick.Automaton()
        for slot, term in enumerate(inverted.vocabulary):
            if term:
                self.automaton.add_word(term, slot)
        self.automaton.make_automaton()

    def hits(self, haystack: str | None, scope: str | None, min_rel: float) -> tuple[np.ndarray, np.ndarray]:
        """(requests, hits) above ``min_rel`` for one document."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not haystack or not len(self.automaton) or (self.scope_codes is not None and scope not in self.scope_codes):
            return none
        slots = {slot for _, slot in self.automaton.iter(haystack)}
        if not slots:
            return none
        found = np.fromiter(slots, np.int64, len(slots))
        times = self.times[found]
        before = np.cumsum(times) - times
        users = self.users[np.repeat(self.first[found] - before, times) + np.arange(times.sum())]
        if self.scope_codes is not None:
            users = users[self.scope_of[users] == self.scope_codes[scope]]
        if len(self.n_terms) > 4 * len(users):  # few of many requests are hit: sorting them costs less than a slot for each
            hit, counts = np.unique(users, return_counts=True)
        else:
            counts = np.bincount(users, minlength=len(self.n_terms))
            hit = np.flatnonzero(counts)
            counts = counts[hit]
        kept = counts / self.n_terms[hit] > min_rel
        return hit[kept], counts[kept]


def _matched(block: _Block, rows: list[tuple], docs: pa.Array) -> pa.RecordBatch:
    """One output batch: documents with their (request, hits, terms[, news])."""
    requests = np.concatenate([row[1] for row in rows])
    columns = [block.ids.take(pa.array(requests)), pa.array(np.concatenate([row[2] for row in rows]), pa.int32()), pa.array(block.n_terms[requests], pa.int32())]
    if len(rows[0]) > 3:
        columns.append(pa.array(np.concatenate([row[3] for row in rows])))
    found = pa.StructArray.from_arrays(columns, names=["request_id", "hits", "n_terms", "news"][: len(columns)])
    offsets = np.concatenate([[0], np.cumsum([len(row[1]) for row in rows])])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)
    return pa.RecordBatch.from_arrays([docs.take(pa.array([row[0] for row in rows])), lists], names=["doc", "found"])


def places(values: pa.Array | pa.ChunkedArray, order: str) -> np.ndarray:
    """A number per value in its order; nulls stand where Spark puts them, first where ascending and last where descending."""
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)
    coded = values.dictionary_encode()
    places = np.zeros(len(coded.dictionary), np.int64)
    places[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(1, len(places) + 1)
    found = np.zeros(len(values), np.int64)
    valid = coded.indices.is_valid().to_numpy(zero_copy_only=False)
    found[valid] = places[coded.indices.drop_null().to_numpy()]
    return found if order == "ascending" else -found


class _Best:
    """The best documents per request so far: the largest share times weight, then the ties in their order."""

    def __init__(self, block: _Block, k: int, ties: list[tuple[str, str]]) -> None:
        self.block, self.k = block, k
        self.ties = ties
        self.held: list[pa.Table] = []
        self.size, self.limit = 0, min(2 * k * len(block.n_terms), HELD_PAIRS) + OUTPUT_PAIRS

    def add(self, rows: list[tuple[int, np.ndarray, np.ndarray]], docs: pa.Array, weights: np.ndarray, ties: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        requests, hits = np.concatenate([r for _, r, _ in rows]), np.concatenate([h for _, _, h in rows])
        owner = np.repeat([i for i, _, _ in rows], [len(r) for _, r, _ in rows])
        at = pa.array(owner)
        columns = {"request": pa.array(requests), "score": pa.array(hits / self.block.n_terms[requests] * weights[owner]), "hits": pa.array(hits), "doc": docs.take(at)}
        self.held.append(pa.table(columns | {name: tie.take(at) for name, tie in ties.items()}))
        self.size += len(at)
        if self.size > self.limit:
            self.cut()
            if self.size > self.limit // 2:  # more requests than a task holds the best of: these are handed over, and others gathered
                yield from self.rows()

    def cut(self) -> None:
        pairs = pa.concat_tables(self.held).combine_chunks()
        requests, score = pairs["request"].to_numpy(), pairs["score"].to_numpy()
        ties = [places(pairs[name].combine_chunks(), order) for name, order in self.ties]
        order = np.lexsort((*reversed(ties), -score, requests))
        at = requests[order]
        nth = np.arange(len(order)) - np.searchsorted(at, at)
        self.held = [pairs.take(pa.array(order[nth < self.k]))]
        self.size = self.held[0].num_rows

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.cut()
            pairs, self.held, self.size = self.held[0], [], 0
            for at in range(0, pairs.num_rows, OUTPUT_PAIRS):
                part = pairs.slice(at, OUTPUT_PAIRS).combine_chunks()
                yield _single_pairs(self.block, part["request"].to_numpy(), part["hits"].to_numpy(), part["doc"].combine_chunks())


def _single_pairs(block: _Block, requests: np.ndarray, hits: np.ndarray, docs: pa.Array) -> pa.RecordBatch:
    """One output batch with a row for each pair."""
    found = pa.StructArray.from_arrays(
        [block.ids.take(pa.array(requests)), pa.array(hits, pa.int32()), pa.array(block.n_terms[requests], pa.int32())], names=["request_id", "hits", "n_terms"]
    )
    return pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(pa.array(np.arange(len(requests) + 1), pa.int32()), found)], names=["doc", "found"])


class _News:
    """Which of the first ``k`` values in order the documents of a task have brought to each request so far."""

    def __init__(self, n_requests: int, k: int) -> None:
        self.k, self.n_requests = k, n_requests
        self.forget()

    def forget(self, coming: int = 0) -> None:
        self.slots: dict[str, int] = {}
        self.order: list[str] = []
        self.seen = np.zeros((self.n_requests, coming + 64), bool)
        self.place = np.zeros(coming + 64)  # of a value in the order; a value that came later stands between two
        self.last = np.full(self.n_requests, np.inf)  # place of a request's k-th value: those behind it are no news

    def of(self, requests: np.ndarray, values: list[str | None] | None) -> np.ndarray:
        """Whether a document with these values brings one to each of the requests."""
        mine = {v for v in values or () if v is not None}
        if not mine:
            return np.zeros(len(requests), bool)
        if len(self.slots) + len(mine) > self.seen.shape[1]:
            self._cut(len(mine))
        for value in mine:
            if value not in self.slots:
                self.place[len(self.slots)] = bisect.bisect_left(self.order, value) - 0.5
                self.slots[value] = len(self.slots)
        slots = [self.slots[v] for v in mine]
        at = np.ix_(requests, slots)
        new = ~self.seen[at] & (self.place[slots] <= self.last[requests][:, None])
        self.seen[at] |= new
        return new.any(axis=1)

    def _cut(self, coming: int) -> None:
        """Put the values in order, find each request's k-th, and drop the values that are news to no request any more; make room for others."""
        names = np.array([*self.slots, None], object)[:-1]
        order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        seen = self.seen[:, order]
        rank = np.cumsum(seen, axis=1, dtype=np.int32)
        enough = rank[:, -1] >= self.k if len(names) else np.zeros(self.n_requests, bool)
        self.last = np.where(enough, np.argmax(rank >= self.k, axis=1) if len(names) else 0, np.inf)
        end = int(self.last.max(initial=-1)) + 1 if enough.all() else len(names)
        width = 2 * end + coming + 64
        if self.n_requests * width > NEWS_CELLS:
            self.forget(coming)  # a value may be news again, which costs a row and changes no result
            return
        self.order = names[order][:end].tolist()
        self.slots = {name: slot for slot, name in enumerate(self.order)}
        self.seen = np.zeros((self.n_requests, width), bool)
        self.seen[:, :end] = seen[:, :end]
        self.place = np.concatenate([np.arange(end, dtype=float), np.zeros(width - end)])


def _stream(inverted: Broadcast, min_rel: float, best: int | None, ties: list[tuple[str, str]], news: int | None = None):
    """Arrow function over documents (doc, haystack, scope[, weight, ties] or [, values])."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(inverted.value)
        top = _Best(block, best, ties) if best else None
        brought = _News(len(block.n_terms), news) if news else None
        for batch in batches:
            docs, scopes, rows, pairs = batch.column(0), batch.column(2).to_pylist(), [], 0
            for i, (haystack, scope) in enumerate(zip(batch.column(1), scopes)):
                requests, hits = block.hits(haystack.as_py(), scope, min_rel)
                more = [] if brought is None else [brought.of(requests, batch.column(3)[i].as_py())]
                for at in range(0, len(requests), OUTPUT_PAIRS):
                    rows.append((i, requests[at : at + OUTPUT_PAIRS], hits[at : at + OUTPUT_PAIRS], *[x[at : at + OUTPUT_PAIRS] for x in more]))
                    pairs += len(rows[-1][1])
                    if pairs >= OUTPUT_PAIRS and top is None:
                        yield _matched(block, rows, docs)
                        rows, pairs = [], 0
            if rows and top is not None:
                weights = np.nan_to_num(batch.column(3).to_numpy(zero_copy_only=False), nan=-np.inf)  # none: last
                yield from top.add(rows, docs, weights, {c: batch.column(4 + n) for n, (c, _) in enumerate(ties)})
            elif rows:
                yield _matched(block, rows, docs)
        if top is not None:
            yield from top.rows()

    return match


def _blocks(wanted: DataFrame, block_chars: int, block_entries: int) -> int:
    """Blocks that keep every broadcast within its bounds."""
    terms = wanted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    size = F.length("t")
    entries, chars, volume = terms.agg(F.sum("n"), F.sum(size), F.sum(size * F.col("n"))).first()
    # A vocabulary that fits is shared by all blocks; one that does not is bounded by what the requests of a block hold.
    return 1 + max((entries or 0) // block_entries, (volume or 0) // block_chars if (chars or 0) > block_chars else 0)


def lexical_match(
    requests: DataFrame,
    corpus: DataFrame,
    *,
    haystack: Column,
    terms: str = "terms",
    scope: str | None = None,
    min_rel: float = 0.05,
    keep: list[str] | None = None,
    best: tuple[int, str | list[tuple[str, str]]] | None = None,
    weight: Column | None = None,
    news: tuple[str, int] | None = None,
    block_chars: int = BLOCK_CHARS,
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """Pairs whose term share exceeds ``min_rel``.

    ``requests`` needs request_id and an array of terms (repeats count, as in Q3 and J3);
    ``corpus`` is any frame from which ``haystack`` can be computed.  With ``scope`` (a
    column of both) a request only meets rows of its own scope.  Returns the corpus columns
    (those in ``keep``) plus request_id, hits, n_terms and relevance.  ``best`` = (k, ties): a task may leave out pairs
    that are not among its k of a request by relevance, times ``weight`` if given, and the ties (T1), one column ascending or
    several with "ascending" or "descending"; the k best of all are among what comes out.  A task holds ``HELD_PAIRS`` at most.
    ``news`` = (column, k), without ``best``: pairs get a column ``news``, true where the document's array of strings has one that no earlier document of the task brought
    to the request, and that may be among the request's first k; the true pairs together have the first k of all pairs.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    kept = corpus.columns if keep is None else keep
    own = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
    wanted = requests.select(
        F.col("request_id").cast("string").alias("request_id"), F.filter(F.col(terms).cast("array<string>"), lambda t: t.isNotNull()).alias("terms"), own.alias("scope")
    ).filter(F.size("terms") > 0)
    blocks = _blocks(wanted, block_chars, block_entries)
    order = [] if best is None else [(best[1], "ascending")] if isinstance(best[1], str) else best[1]
    ties = [(f"tie{n}", direction) for n, (_, direction) in enumerate(order)]
    tie = [(F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"), *[F.col(c).alias(f"tie{n}") for n, (c, _) in enumerate(order)]] if best else []
    docs = corpus.select(F.struct(*kept).alias("doc"), F.lower(haystack).alias("haystack"), own.alias("scope"), *tie, *([news[0]] if news else []))
    schema = f"doc {docs.schema['doc'].dataType.simpleString()}, found array<struct<request_id: string, hits: int, n_terms: int{', news: boolean' if news else ''}>>"
    pairs = None
    for block in range(blocks):
        chosen = wanted.filter(F.pmod(F.xxhash64("request_id"), F.lit(blocks)) == block)
        inverted = spark.sparkContext.broadcast(_Inverted(chosen.toArrow(), scope is not None))  # one block, bounded above
        part = docs.mapInArrow(_stream(inverted, min_rel, best[0] if best else None, ties, news[1] if news else None), schema)
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs.select("doc", F.explode("found").alias("found")).select(
        "doc.*", F.col("found.request_id").cast(requests.schema["request_id"].dataType).alias("request_id"), "found.hits", "found.n_terms", *(["found.news"] if news else [])
    ).withColumn("relevance", F.col("hits") / F.col("n_terms"))
