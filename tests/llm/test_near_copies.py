"""The near-copy stage against all pairs."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import decontaminate, near_copies


def _sets(text):
    found = (text or "").lower().encode().split()
    return {b" ".join(found[i : i + 5]) for i in range(len(found) - 4)} or {b" ".join(found)}


def _edited():
    """Groups of edited copies around the similarity, a hot passage, nulls, short texts and repeated ids."""
    rng = np.random.default_rng(9)
    pool = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(40):
        base = list(rng.choice(pool, int(rng.integers(30, 200))))
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in rng.choice(len(copy), int(rng.integers(1, 1 + len(copy) // 25)), replace=False):
                copy[at] = "edit"
            texts.append(" ".join(copy))
    passage = " ".join(rng.choice(pool, 50))
    texts += [f"{' '.join(rng.choice(pool, 30))} {passage}" for _ in range(30)]
    texts += ["", "   ", "one", "ONE", "two words", None]
    return texts


def _groups(texts):
    sets, root = [_sets(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("group_shingles", [4_000_000, 150])
def test_near_copies_against_all_pairs(spark, group_shingles):
    texts = _edited()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = _groups(texts)
    assert 40 < len(set(want)) < len(texts) - 40
    got = near_copies.drop_near_copies(frame, group_shingles=group_shingles)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want))


def test_stage_finds_edited_copies(spark):
    texts = _edited()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, frame, "").collect()) == sorted(set(_groups(texts)))


def test_rows_are_decided_by_id_and_text(spark):
    rng = np.random.default_rng(1)
    pool = [f"w{i}" for i in range(900)]
    say = lambda: " ".join(rng.choice(pool, 60))
    a, b, c, d, e = (say() for _ in range(5))
    rows = [(1, a), (None, a + " more"), (None, b), (None, c), (2, d), (3, d + " more"), (3, e), (4, c + " end"), (5, b[::-1]), (5, b[::-1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter(tuple(r) for r in corpus_pipeline.near_copies(spark, frame, "").collect())
    assert kept == Counter([(1, a), (None, b), (2, d), (3, e), (4, c + " end"), (5, b[::-1])])
    test = spark.createDataFrame([(0, a), (1, d)], "item_id long, text string")
    clean = Counter(tuple(r) for r in decontaminate.drop_contaminated(frame, test).collect())
    assert clean == Counter([(None, b), (None, c), (3, e), (4, c + " end"), (5, b[::-1]), (5, b[::-1])])


def test_null_ids_and_null_texts_are_rows_of_their_own(spark):
    rows = [("abc", None), (None, "abc"), ("", None), (None, ""), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    kept = Counter(tuple(r) for r in corpus_pipeline.near_copies(spark, frame, "").collect())
    assert kept == Counter([("", None), (None, "abc")])  # empty texts are one group, its smallest id stays
    test = spark.createDataFrame([(0, "one two three four"), (1, "abc")], "item_id long, text string")
    clean = Counter(tuple(r) for r in decontaminate.drop_contaminated(frame.union(spark.createDataFrame([(None, "one two three four")], frame.schema)), test).collect())
    assert clean == Counter(rows)


def test_beginnings_rule_out_no_similar_pair():
    rng = np.random.default_rng(11)
    none = np.zeros(0, np.uint64)
    ruled_out = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        x = rng.choice(400, n, replace=False).astype(np.uint64)
        edits = int(rng.integers(0, n // 4 + 2 if rng.random() < 0.7 else n + 1))
        y = np.unique(np.concatenate([x[edits:], rng.integers(400, 800, int(rng.integers(0, edits + 1))).astype(np.uint64)]))
        x = np.sort(x)
        frequent = np.sort(rng.choice(np.union1d(x, y), int(rng.integers(0, 5)))) if rng.random() < 0.5 and len(y) else none
        frequent = np.unique(frequent)
        if not len(y):
            continue
        shared = len(np.intersect1d(x, y))
        (a, need_a), (b, need_b) = (near_copies.beginning(s, frequent, 0.8) for s in (x, y))
        common = len(np.intersect1d(a, b))
        if shared >= 0.8 * (len(x) + len(y) - shared):
            assert common >= need_a and common >= need_b
        else:
            ruled_out += common < need_a or common < need_b
    assert ruled_out > 100


def test_wanted_texts_are_found_without_shuffling_the_others(spark):
    keys = [*range(-3000, 3000, 7), (1 << 62) + 5, near_copies.MAP_BITS + 4, -(1 << 63)]
    rows = spark.createDataFrame([(k, f"t{k}") for k in [*keys, 1, 2, 2]], "key long, text string")
    wanted = [-3000, 4, (1 << 62) + 5, 2, -(1 << 63)]  # one key that has no text
    asked = spark.createDataFrame([(k, k + 1 if k < 100 else 0) for k in wanted], "key long, root long")
    got = near_copies.texts_of(rows, asked)
    assert got.columns == ["key", "text", "root"]
    present = [k for k in [*keys, 1, 2, 2] if k in wanted]
    assert sorted(r["key"] for r in got.collect()) == sorted(present) and all(r["text"] == f"t{r['key']}" for r in got.collect())
    assert near_copies.texts_of(rows, asked.limit(0)).count() == 0


@pytest.mark.parametrize("star_from", [1, 3, 32])
def test_candidate_links_tie_similar_sets_and_no_chain_of_single_shingles(spark, star_from):
    rng = np.random.default_rng(5)
    none = np.zeros(0, np.uint64)
    sets = []
    for i in range(60):
        n = int(rng.integers(1, 60))
        base = rng.integers(1 << 20, 1 << 40, n).astype(np.uint64)
        sets.append(np.unique(base))
        for _ in range(int(rng.integers(0, 6))):
            edits = int(rng.integers(0, n // 6 + 2))
            sets.append(np.unique(np.concatenate([base[edits:], rng.integers(1 << 20, 1 << 40, edits).astype(np.uint64), base[:1]])))
    similar = len(sets)
    for i in range(50):  # each has one prefix shingle in common with the next, and is similar to none
        sets.append(np.unique(np.concatenate([rng.integers(1 << 20, 1 << 40, 40).astype(np.uint64), np.array([i, i + 1], np.uint64)])))
    rows = [(k, len(x), int(s)) for k, x in enumerate(sets) for s in near_copies.prefix(x, none, 0.8, near_copies.SHARED).view(np.int64)]
    first = spark.createDataFrame(rows, "key long, size int, shingle long").repartition(3)
    links = [(r["a"], r["b"]) for r in near_copies.candidate_links(first, 0.8, star_from=star_from).collect()]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    pairs = 0
    for i in range(similar):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                pairs += 1
                assert find(i) == find(j)
    assert pairs > 50
    if star_from > 1:
        assert all(a < similar and b < similar for a, b in links)
