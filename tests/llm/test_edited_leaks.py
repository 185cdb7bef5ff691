"""Heavily edited copies of test items against plain Smith-Waterman."""

import numpy as np
import pytest

from corpusloom.llm import decontaminate


def _plain_score(words, item):
    row, best = [0] * (len(words) + 1), 0
    for x in item:
        new = [0]
        for j, y in enumerate(words):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best / (2 * len(item))


@pytest.mark.parametrize("verbatim", [False, True])
def test_edited_copies(spark, verbatim):
    rng = np.random.default_rng(12)
    pool = [f"t{i}" for i in range(4000)]
    items = [(k, " ".join(rng.choice(pool, int(rng.integers(16, 60)), replace=False))) for k in range(40)]
    texts = []
    for n, (_, item) in enumerate(items):
        for step in (4, 5, 6):
            texts.append(" ".join([f"new{n}x{i}" if i % step == step - 1 else w for i, w in enumerate(item.split())]))
        texts.append(" ".join([f"new{n}y{i}" if rng.random() < 0.2 else w for i, w in enumerate(item.split())]))
    # Every n-gram occurs somewhere else, too.
    texts += [item for _, item in items] if verbatim else []
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in decontaminate.contaminations(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k): round(s, 9) for i, t in enumerate(texts) for k, x in items if set(t.split()) & set(x.split()) and (s := _plain_score(t.split(), x.split())) >= 0.5}
    assert got == want and len(want) > 150
