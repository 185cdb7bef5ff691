"""SimHash near-duplicates: fingerprints, then BK-trees over shards of fingerprints that can be close.

Equal fingerprints collapse first.  Two fingerprints within ``RADIUS`` = 3 bits agree on at least two of five bit
blocks, so each is sent to ten shards, one for every pair of blocks, keyed by the bits there (25 or 26 of them).  A shard
holds a BK-tree: children keyed by their Hamming distance to the parent, and a search follows only the edges within the
radius.  A shard emits the links of a spanning forest, never all pairs.  Shards over ``SHARD_ROWS`` fingerprints are cut
into chunks, and each pair of chunks is a task of its own: one chunk's tree, searched for the other's rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.windows import text_buffers
from corpusloom.session import stage

RADIUS = 3
SHINGLE = 3
SHARD_ROWS = 2048
_EDGES = (0, 13, 26, 39, 52, 64)
_LANES = np.uint64(0x0101010101010101)


def _shingle_hashes(text: bytes, size: int) -> list[int]:
    found = text.lower().split()
    if not found:
        return []
    if len(found) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(found), 42)]
    line, ends, at = b" ".join(found), [], 0
    for word in found:
        at += len(word)
        ends.append(at)
        at += 1
    starts = [0, *[x + 1 for x in ends[: len(found) - size]]]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :])]


def fingerprint_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority bits of each text's hashes; ``counts`` hashes belong to each text, in order.

    Eight bits at a time are counted in the byte lanes of one word, over at most 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    blocks = -(-counts[has] // 255)
    text = np.repeat(np.arange(len(has)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(np.cumsum(counts[has]) - counts[has], blocks) + nth * 255
    first_block = np.cumsum(blocks) - blocks
    majority = np.zeros(len(has), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        per_lane = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_block, axis=0)
        over = per_lane * 2 > counts[has][:, None]
        for lane in range(8):
            majority |= over[:, lane].astype(np.uint64) << np.uint64(8 * lane + bit)
    out[has] = majority
    return out


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            raw, hashes, counts, found = data.tobytes(), [], np.zeros(len(offsets) - 1, np.int64), []
            pending: list[int] = []
            first = 0
            for i in range(len(offsets) - 1):
                mine = _shingle_hashes(raw[offsets[i] : offsets[i + 1]], size)
                counts[i] = len(mine)
                pending += mine
                if len(pending) >= 200_000 or i == len(offsets) - 2:
                    hashes = np.array(pending, np.uint64)
                    found.append(fingerprint_of(hashes, counts[first : i + 1]))
                    pending, first = [], i + 1
            prints = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "print"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, print): the 64 majority bits of XXH64 (seed 42) over lower-cased word shingles, as a signed long.

    Fewer words than a shingle make one; a text without words, null included, has the print 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(size), f"id {kind}, print long")


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        at, new = 0, len(self.values) - 1
        while True:
            distance = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = new
                return
            at = below

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of the values within the radius."""
        if not self.values:
            return []
        found, todo = [], [0]
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            edges = children[at]
            if edges:
                low, high = distance - radius, distance + radius
                todo += [below for edge, below in edges.items() if low <= edge <= high]
        return found


class _Forest:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = self.parent.setdefault(x, x)
        while self.parent[top] != top:
            top = self.parent[top]
        while self.parent[x] != top:
            self.parent[x], x = top, self.parent[x]
        return top

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def shard_links(left: list[int], right: list[int] | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of one shard, or of one chunk's tree and another chunk's rows."""
    tree, forest = BKTree(), _Forest()
    if right is None:
        for value in left:
            for other in tree.near(value, radius):
                if forest.join(value, tree.values[other]):
                    yield value, tree.values[other]
            tree.add(value)
        return
    for value in left:
        tree.add(value)
    for value in right:
        for other in tree.near(value, radius):
            if forest.join(value, tree.values[other]):
                yield value, tree.values[other]


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                unsigned = [[x & (1 << 64) - 1 for x in side] if side is not None else None for side in (left, right)]
                for x, y in shard_links(unsigned[0], unsigned[1], radius):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(side, np.uint64).view(np.int64)) for side in (a, b)], names=["a", "b"]
            )

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links that connect every two different values of ``print`` within ``radius`` <= 3 bits."""
    if radius > 3:
        raise ValueError("two of five blocks agree for at most three differing bits")
    shards = []
    for n, (i, j) in enumerate(itertools.combinations(range(5), 2)):
        mask = sum(((1 << _EDGES[k + 1]) - (1 << _EDGES[k])) for k in (i, j))
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        shards.append(F.struct(F.lit(n).alias("t"), F.col("print").bitwiseAND(F.lit(mask)).alias("bits")))
    spread = prints.select("print").distinct().select("print", F.explode(F.array(*shards)).alias("shard")).select("print", "shard.*")
    # A chunk of a shard takes part in as many tasks as the shard has chunks; almost all shards have one.
    sizes = spread.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(
        spread.join(sizes, ["t", "bits"]).select(
            "t", "bits", "print", F.ceil(F.col("n") / shard_rows).cast("int").alias("chunks"),
        ).withColumn("chunk", F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")),
        "simhash-shards",
    )
    chunk = shared.groupBy("t", "bits", "chunks", "chunk").agg(F.sort_array(F.collect_list("print")).alias("prints"))
    alone = chunk.select("prints", F.lit(None).cast("array<bigint>").alias("others"))
    large = chunk.where("chunks > 1")
    first = large.select("t", "bits", F.col("chunk").alias("i"), F.col("prints"), F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks"))).alias("j")).where("j < chunks")
    second = large.select("t", "bits", F.col("chunk").alias("j"), F.col("prints").alias("others"))
    pairs = first.join(second, ["t", "bits", "j"]).select("prints", "others")
    return alone.unionByName(pairs).mapInArrow(_search(radius), "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: (id, fingerprint as 16 hex digits, component_id).

    ``component_id`` is the smallest id reachable through links of at most ``radius`` differing bits.  Texts without words
    have the print 0 and are linked like any other.  Null ids are ignored as component ids unless a component has no other;
    repeated rows share a print and so a component.  An empty table gives no rows; other columns are not read.
    """
    prints = stage(fingerprints(docs, id_col, text_col, size), "simhash-prints")
    distinct = stage(prints.groupBy("print").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(near_links(distinct, radius))
    named = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = named.join(least, "root").select("print", "component_id")
    return prints.join(final, "print").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
