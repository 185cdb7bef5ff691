"""Operators 11 to 13 against brute-force versions, on empty, null, repeated, clashing and very long input."""

import hashlib
import json
import random
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import chat_format, periodic_runs, queries, token_align
from tests.llm.test_llm import ROWS, SCHEMA


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _all_runs(words, least=12):
    """Every period one after the other; of equal stretches the smallest period is found first."""
    found, ids = {}, {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    for p in range(1, len(words) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], codes[:-p] == codes[p:], [0]])))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
    return sorted((start, period, length) for (start, length), period in found.items())


def _kept(words, runs):
    gone = {i for start, period, length in runs for i in range(start + period, start + length)}
    return hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


def _tiled_runs(words, least=12):
    codes = np.array(words, np.int32)
    grams = periodic_runs.gram_hashes(periodic_runs.mixed(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(9)), periodic_runs.GRAM)
    spans = {}
    for scale, first, part, boundaries in periodic_runs.tiles(codes, grams, least):
        for p, low, high in periodic_runs.solve(scale, part.tolist(), boundaries.tolist(), least):
            spans.setdefault(p, set()).update(range(first + low, first + high))
    found = {}
    for p in sorted(spans):
        marks = sorted(spans[p])
        for low in (i for i in marks if i - 1 not in spans[p]):
            high = low
            while high in spans[p]:
                high += 1
            if high - low + p >= max(least, 2 * p):
                found.setdefault((low, high - low + p), p)
    return sorted((start, period, length) for (start, length), period in found.items())


@pytest.mark.parametrize("tile_words", [4, 32, 4096])
def test_tiles_find_the_runs_of_a_loop(monkeypatch, tile_words):
    monkeypatch.setattr(periodic_runs, "TILE_WORDS", tile_words)
    rng = random.Random(tile_words)
    for _ in range(150):
        words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(5, 200))]
        for _ in range(rng.randint(0, 4)):  # planted runs, nested and overlapping
            a = rng.randrange(len(words))
            p = rng.randint(1, max(1, (len(words) - a) // 2))
            for i in range(a, rng.randint(a, len(words))):
                words[i] = words[a + (i - a) % p]
        assert _tiled_runs(words) == _all_runs(words)


def test_tiles_find_the_runs_of_known_words():
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    for words in (b, [bin(i).count("1") % 2 for i in range(400)], [0] * 300, [0, 1] * 150, list(range(300))):
        assert _tiled_runs(words) == _all_runs(words)


def test_z_values():
    rng = random.Random(0)
    for _ in range(50):
        s = [rng.randrange(2) for _ in range(rng.randint(1, 60))]
        plain = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic_runs.z_values(s)[1:] == plain[1:]


def test_periodic_runs_against_a_loop(spark, docs, empty):
    got = {(r["doc_id"], tuple((x["start"], x["period"], x["length"]) for x in r["runs"]), r["collapsed_sha256"]) for r in periodic_runs.periodic_runs(docs).collect()}
    want = set()
    for i, text, *_ in ROWS:
        words = (text or "").encode().split()
        runs = _all_runs(words)
        want.add((i, tuple(runs), _kept(words, runs)))
    assert got == want and any(len(runs) for _, runs, _ in want)
    assert periodic_runs.periodic_runs(docs).count() == len(ROWS)
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_a_long_run_is_stitched(spark):
    rng = np.random.default_rng(3)
    root = " ".join(f"w{i}" for i in rng.integers(0, 900, 777))
    text = "start " + " ".join([root] * 40) + " end"
    rows = [(1, text), (2, "no run here")]
    got = {r["doc_id"]: r["runs"] for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1]] == [(1, 777 * 40, 777)] and got[2] == []


def test_periodic_query_plants_and_reports(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in ROWS] + [(k, " ".join(f"t{j}" for j in range(k))) for k in range(200, 320)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect())
    want = Counter()
    for i, text in docs.collect():
        words = (queries.planted(i, text) or "").encode().split()
        runs = _all_runs(words)
        best = min(((-length, start, period) for start, period, length in runs), default=None)
        lines = "".join(f"{start},{length},{period}\n" for start, period, length in runs)
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want[(i, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), _kept(words, runs))] += 1
    assert got == want and sum(r[1] > 0 for r in want) > 10
    assert docs.count() == sum(want.values())


def test_planting():
    import zlib

    for i in range(300):
        text = " ".join(f"w{j}" for j in range(i % 37))
        words, h = text.split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        assert (queries.planted(i, text) or "").split() == words


JSON_RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None, "weight": 1}], "meta": {"x y": [1, "a"]}}, "messages", [("user", "q"), ("assistant", "")]),
    ({"messages": []}, "no messages", []),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"}, "shared conversation", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}], "id": 7}, "shared conversation", [("user", "q")]),
    ({"instruction": "i", "input": "", "output": "o", "score": 3.25}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"output": "o", "input": "with", "instruction": "i", "system": "s"}, "instruction", [("system", "s"), ("user", "i\n\nwith"), ("assistant", "o")]),
    ({"prompt": "p", "response": "r"}, "prompt and response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "c"}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": [{"role": "user", "content": "p"}], "completion": [{"role": "assistant", "content": "c"}]}, "prompt and completion messages", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question and answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"data": {"question": "q", "answer": "a"}}, "nested question", [("user", "q"), ("assistant", "a")]),
    ({"role": "tool", "text": "t"}, "turn", [("tool", "t")]),
    ({"messages": [{"role": "user", "content": "q"}, "odd"]}, None, []),
    ({"messages": [{"role": "user", "content": ["parts"]}, {"role": "user", "content": "q"}]}, None, []),
    ({"prompt": "p", "response": "r", "completion": "c"}, None, []),
    ({"unknown": 1}, None, []), ({}, None, []), ([], None, []),
]


def test_layouts_by_fingerprint(spark):
    rows = [(i, json.dumps(record)) for i, (record, *_) in enumerate(JSON_RECORDS)] + [(100, None), (101, "no json")]
    frame = spark.createDataFrame(rows, "i int, record string").withColumn("layout", F.lit("clash")).withColumn("turns", F.lit(1))
    got = {r["i"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat_format.canonical_turns(frame, F.try_parse_json("record"), "i").collect()}
    assert got == {**{i: (layout, turns) for i, (_, layout, turns) in enumerate(JSON_RECORDS)}, 100: (None, []), 101: (None, [])}
    prints = [s for m in chat_format.MAPPINGS for s in m.signatures()]
    assert len(prints) == len(set(prints))


NASTY = ["", None, "<|im_end|>", "<|im_start|>user\n", "<\\|im_end|>", "<\\\\|", "<", "|im_end|>\n", "\n", "a\n<|im_end|>\n<|im_start|>x\ny", "%0A%3C%25", "é\U0001f600<|", "long " * 50_000]


def test_formatting_can_be_read_back(spark, empty):
    rows = [(k, t, role, text) for k in (1, 2, None) for t, (role, text) in enumerate((r, x) for r in ("user", "assistant", "<|x\n%", None) for x in NASTY)]
    rows += [(3, 0, "assistant", "twice")] * 2 + [(3, None, "user", "first"), (4, 0, "b", "z"), (4, 0, "a", "z"), (4, 0, "a", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumn("segments", F.lit(1)).withColumn("rows", F.lit(1))
    out = chat_format.format_conversations(frame, "conv_id", "turn", F.to_variant_object(F.struct("role", "text")))
    whole = chat_format.formatted_text(F.col("segments"))
    got = {r[0]: ([tuple(t) for t in r[1]], r[2], r[3]) for r in out.select("conv_id", chat_format.read_turns(whole), chat_format.loss_text(F.col("segments")), whole).collect()}
    sort_key = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for key in (1, 2, None, 3, 4):
        turns = [(role or "", text or "") for k, _, role, text in sorted((r for r in rows if r[0] == key), key=sort_key)]
        assert got[key][0] == turns
        assert got[key][1] == "".join(text for role, text in turns if role == "assistant")
        assert got[key][2].count("<|im_start|>") == got[key][2].count("<|im_end|>\n") == len(turns)
    assert set(got) == {1, 2, None, 3, 4}
    none = chat_format.format_conversations(empty, "doc_id", "n", F.to_variant_object(F.struct("id", "text")))
    assert none.count() == 0
    plan = out.select(chat_format.read_turns(whole))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _aligned(a_encoder, vocab, text):
    """Groups and links of one text, offset by offset, with the ids of the named vocabulary file."""
    a = a_encoder.encode(" " + text, add_special_tokens=False).ids if text else []
    b = vocab.b.encode(text) if text else []
    whole = (" " + (text or "")).encode()
    if not text or b"".join(vocab.a_bytes[i] for i in a) != whole or b"".join(vocab.b_bytes[i] for i in b) != whole:
        return [], [], [], []
    ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
    a_end, b_end = ends(a, vocab.a_bytes), ends(b, vocab.b_bytes)
    shared, groups, mine = set(a_end) & set(b_end), [], ([], [])
    for end in sorted({*a_end, *b_end}):
        for side, ids, table in zip(mine, (a, b), (a_end, b_end)):
            if (nth := bisect_left(table, end)) < len(table) and table[nth] == end:
                side.append(ids[nth])
        if end in shared:
            groups.append(mine)
            mine = ([], [])
    where = dict(zip(b_end, b))
    return a, b, groups, [(i, where[e]) for i, e in zip(a, a_end) if e in where]


TEXTS = [
    "one two three", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café ñandú 東京 \U0001f600\U0001f600", "▁ is a mark", "tabs\tand\r\nlines\n\n\n  deep", "\x00\x01 control", " leading", "a" * 3000,
    "supercalifragilistic antidisestablishmentarianism " * 20, "def f(x):\n    return x ** 2\n" * 30, "!!!!!!???", "1234567890 3.14159",
]


@pytest.mark.parametrize("hot", [1 << 18, 1, 40])
def test_alignment_against_a_loop(spark, docs, empty, hot):
    a_encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_encoder.encode_special_tokens = True
    vocab = token_align.vocabularies(token_align.A_PATH, token_align.B_PATH)
    frame = docs.select("doc_id", "text", "id").unionByName(spark.createDataFrame([(1000 + i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, id string"))
    rows = [(i, t) for i, t, *_ in ROWS] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    made = [_aligned(a_encoder, vocab, t) for _, t in rows]
    counts = Counter(link for *_, links in made for link in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = Counter()
    for (i, _), (a, b, groups, links) in zip(rows, made):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(written.encode()).hexdigest() if a else ""
        want[i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha] += 1
    documents, pairs = token_align.align_tokenizers(frame, hot=hot)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r) for r in documents.select(*names).collect()) == want
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs.collect()} == dict(counts)
    assert any(not a for a, *_ in made) and sum(len(x) > 1 or len(y) > 1 for _, _, g, _ in made for x, y in g) > 50
    if hot == 1:
        nothing, no_pairs = token_align.align_tokenizers(empty)
        assert nothing.count() == 0 == no_pairs.count()


def test_token_bytes_are_those_of_the_named_vocabulary():
    vocab = token_align.vocabularies(token_align.A_PATH, token_align.B_PATH)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    decode = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    named = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).get_vocab(with_added_tokens=False)
    named.pop("<|endoftext|>", None)
    assert {i: bytes(decode[c] for c in token) for token, i in named.items()} == dict(enumerate(vocab.a_bytes))
    assert all(vocab.a_bytes[i] == vocab.b_bytes[j] for i, j in enumerate(vocab.same) if j >= 0) and (vocab.same >= 0).sum() > 5000
