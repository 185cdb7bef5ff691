"""Every operator against a brute-force version, and on empty, null, repeated and very long input."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import decontaminate, exact_dedup, license_scan, line_dedup, lm_score, near_copies, packing, quality, queries, simhash, substring_dedup, suffix_dedup
from corpusloom.llm.components import components

SCHEMA = "doc_id long, text string, key string, id string, n int, word string, print string, digest string"


def _corpus():
    """Small texts with shared passages, copies, edits, nulls, empties, a repeated row, a null id and a very long text."""
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abcdeéñ"), int(rng.integers(2, 8)))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(pool, n))
    passage, block = say(60), "\n".join(say(8) for _ in range(20))
    texts = [say(int(rng.integers(1, 120))) for _ in range(30)]
    texts += [f"{say(int(rng.integers(0, 50)))} {passage} {say(int(rng.integers(0, 50)))}" for _ in range(25)]
    texts += [f"{say(5)}\n{block}\n{say(5)}" for _ in range(8)]
    base = say(150)
    texts += [base, base, base.replace(" ", "  \t", 3), base.rsplit(" ", 1)[0] + " zzz", base.upper()]
    texts += [None, None, "", "   ", "one", "two words", "x", "a b " * 300, "q" * 5000, (passage + "\n") * 200, say(1500), "naïve   text\u0085 with\x0bodd\x0c spaces <|endoftext|> end"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "a null id"), (None, base), (None, base)]
    return [(i, t, "k", "i", 1, "w", "p", "d") for i, t in rows]


ROWS = _corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(frame, *columns):
    return Counter(tuple(r) for r in frame.select(*columns).collect())


def _removed(tokens, width, joined):
    starts = Counter(tuple(t[i : i + width]) for t in tokens for i in range(len(t) - width + 1))
    for t in tokens:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if starts[tuple(t[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        runs = sum(g and not before for g, before in zip(gone, [False, *gone]))
        yield len(t), sum(gone), runs, hashlib.sha256(joined([x for x, g in zip(t, gone) if not g])).hexdigest()


def _words(text):
    return (text or "").encode().split()


def test_line_chunks_against_a_loop(docs, empty):
    got = _rows(line_dedup.remove_repeated_chunks(docs), "doc_id", "n_removed_chunks", "kept_sha256")
    seen, kept = {}, {}
    signed = lambda i, t: xxhash.xxh64_intdigest(f"{i} {t}")
    unique = {(i, t or "") for i, t, *_ in ROWS}
    for i, t in sorted(unique, key=lambda x: (x[0] is None, x[0] or 0, signed(*x))):
        removed, lines = 0, []
        for chunk in line_dedup.chunks(t):
            if len(chunk) > 1 and b"\n".join(chunk) in seen:
                removed += 1
            else:
                seen[b"\n".join(chunk)] = i
                lines += chunk
        kept[i, t] = (removed, hashlib.sha256(b"\n".join(lines)).hexdigest())
    assert got == Counter((i, *kept[i, t or ""]) for i, t, *_ in ROWS)
    assert sum(r[1] for r in got.elements()) > 5
    assert line_dedup.remove_repeated_chunks(empty).count() == 0


def test_chunk_boundaries_resist_shifts():
    lines = "\n".join(f"line number {i * i}" for i in range(200))
    before, after = line_dedup.chunks(lines), line_dedup.chunks("inserted\n" + lines)
    assert [x for c in after for x in c] == ("inserted\n" + lines).encode().split(b"\n")
    assert len({tuple(c) for c in before} & {tuple(c) for c in after}) >= len(before) - 2


def test_lm_scores_against_counts(docs, empty):
    got = lm_score.score_texts(docs, frequent=50)
    tokens = [[w for w in re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split()] + [None] for _, t, *_ in ROWS]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, *_ in ROWS]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    total, distinct = sum(counts.values()), len(counts)
    want = Counter((i, h, len(t), sum(counts[w] > 0 for w in t), total, round(sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t), 6)) for (i, *_), t, h in zip(ROWS, tokens, held))
    assert _rows(got.withColumn("base_score", F.round("base_score", 6)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == want
    sums = got.where("NOT held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > 0.9 * sums[1]  # shared passages are predicted from their pairs
    assert lm_score.score_texts(empty).count() == 0


def test_lm_probabilities_sum_to_one_at_most(spark, docs):
    model, _ = lm_score.train(docs.select("text"), frequent=20)
    words = sorted({w for _, t, *_ in ROWS for w in _words((t or "").lower())})
    histories = words[:15]
    for before in histories:
        text = b" ".join(x for w in words for x in (before, w))
        data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        (_, _, ids, ends), = lm_score.token_ids(data, offsets)
        single, estimate, history, _, _ = lm_score._parts(model, ids, ends, 0)
        weight = model.weights[history]
        assert (weight * estimate + (1 - weight) * single)[1:-1:2].sum() <= 1.02


def test_filter_never_underestimates(spark):
    rng = np.random.default_rng(1)
    ids = np.unique(rng.integers(0, 1 << 60, 5000, dtype=np.int64))
    n = rng.integers(1, 2000, len(ids))
    frame = spark.createDataFrame(list(zip(ids.tolist(), n.tolist())), "id long, n long")
    made = lm_score.build_filter(frame, 1)
    level = made.levels(ids.view(np.uint64))
    # Buckets of so small a filter are uneven; at 10 bits an entry large ones err in about one of a hundred.
    assert (level >= lm_score.level_of(n)).all() and (level == lm_score.level_of(n)).mean() > 0.9
    absent = rng.integers(0, 1 << 60, 5000, dtype=np.int64)
    assert (made.levels(absent.view(np.uint64)) > 0).mean() < 0.03
    small = lm_score.build_filter(frame, 1, max_bits=80_000)
    assert small.bits.size * 8 <= max(80_000, lm_score.BUCKETS * 64) and small.least > 1


def test_lm_filters_beyond_the_broadcast_lose_no_level(spark, docs):
    rng = np.random.default_rng(2)
    ids = np.unique(rng.integers(0, 1 << 60, 5000, dtype=np.int64))
    n = rng.integers(1, 2000, len(ids))
    small = lm_score.build_filter(spark.createDataFrame(list(zip(ids.tolist(), n.tolist())), "id long, n long"), 1, max_bits=80_000)
    level = small.levels(ids.view(np.uint64))
    assert (level >= lm_score.level_of(n)).all() and (level == lm_score.level_of(n)).mean() > 0.8
    assert len(small.reached(ids.view(np.uint64), 1)) == len(ids)
    totals = [
        lm_score.score_texts(docs, frequent=20, max_bits=bits).where("NOT held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_known")).first()
        for bits in (lm_score.FILTER_BITS, 4000)
    ]
    assert totals[1][0] > 0.9 * totals[1][1] and abs(totals[1][0] / totals[0][0] - 1) < 0.02 and totals[0][2] == totals[1][2]


def test_lm_common_pairs_are_not_probed_again(spark, docs, monkeypatch):
    model, _ = lm_score.train(docs.select("text"))
    text = " ".join(t for _, t, *_ in ROWS if t).encode()
    (_, _, ids, ends), = lm_score.token_ids(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    pairs, _ = lm_score.pair_ids(ids, ends)
    sent, reached = [], lm_score.LogFrequencyFilter.reached
    monkeypatch.setattr(lm_score.LogFrequencyFilter, "reached", lambda self, x, level: (sent.append(len(x)), reached(self, x, level))[1])
    want = model.pair.probed(pairs)
    everywhere = sum(sent)
    sent.clear()
    assert (model.pair.levels(pairs) == want).all() and (want > 0).any()
    assert sum(sent) < everywhere / 5  # those the model knows, and copies of the others, are not probed
    small = [_rows(lm_score.score_texts(docs, often=n), "doc_id", "score") for n in (0, 30, lm_score.OFTEN)]
    assert small[0] == small[1] == small[2] and len(lm_score.train(docs.select("text"), often=30)[0].pair.often[0]) <= 30


def test_licences(spark, docs, empty):
    model = license_scan.train(docs)
    known = {
        "we publish this under the MIT license": "mit", "Licensed under the Apache License, Version 2.0. See file": "apache-2.0",
        "This text is licensed under CC BY-NC 4.0": "cc-by-nc", "it is licensed under the GNU General Public License, version 3, by us": "gpl",
        "Her driving licence was renewed last week": "unknown", "All copyright questions go to the editor": "unknown",
    }
    rows = [(i, f"before\n{text}\nafter") for i, text in enumerate(known)] + [(None, "Released under the MIT License."), (90, None), (91, ""), (90, "license " * 20000)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["family"] for r in got if r["doc_id"] is not None and r["doc_id"] < 90} == dict(enumerate(known.values()))
    assert all(r["paragraph"] == 1 for r in got if (r["doc_id"] or 90) < 90)
    assert all(r["confirmed"] for r in got if r["doc_id"] is None)
    own = [(n, body, family) for family, bodies in license_scan.NOTICES.items() for n, body in enumerate(bodies)]
    again = license_scan.scan(spark.createDataFrame(own, "doc_id long, text string, label string"), model)
    assert again.where("confirmed").count() == len(own)
    assert all(any(cue in body.lower() for cue in license_scan.CUES) for _, body, _ in own)
    assert license_scan.scan(empty, model).count() == 0
    plan = license_scan.scan(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_on_held_out_rows(spark):
    rng = np.random.default_rng(8)
    pool = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(300):
        words = list(rng.choice(pool, 80))
        if i % 3 == 0:
            words = [w.upper() + "!!" for w in words]
        if i % 3 == 1:
            words[5:8] = ["vile", "nasty", "vile"]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if i % 3 == 0 else 1, 1 if i % 3 == 1 else None))
    rows += [(300, None), (301, ""), (None, "x"), (302, "long " * 50_000), (2, rows[2][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    label = spark.createDataFrame(labels[:150] + [(None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(frame, label)
    got = {r["doc_id"]: r for r in quality.grade(frame, model).collect()}
    assert len(got) == 304 and model.thresholds[0] < model.thresholds[1]
    grades = np.array([[got[i]["expected_grade"], got[i]["kept"]] for i in range(150, 300)])
    kind = np.arange(150, 300) % 3
    assert (grades[:, 1] == (kind != 0)).mean() > 0.97
    assert grades[kind == 0, 0].mean() < grades[kind == 1, 0].mean() < grades[kind == 2, 0].mean()
    kept = quality.keep_good(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    clash = frame.withColumns({c: F.lit("x") for c in ("grade", "labelled", "quality", "toxic", "id", "slots")})
    again = quality.train(clash, label.withColumn("text", F.lit("y")).withColumn("grade", F.lit(7)))
    assert np.allclose(again.weights, model.weights) and quality.keep_good(clash, again).count() == kept.count()
    many = quality.train(frame.unionByName(frame.where("doc_id = 4").join(spark.range(500), how="cross").drop("id")), label)
    assert np.allclose(many.weights, model.weights)  # a labelled id that fills the table is one training row
    none = quality.train(frame, label.limit(0))
    assert quality.grade(frame, none).where("kept").count() == len(rows)
    assert quality.grade(frame.limit(0), model).count() == 0


def test_ordinal_fit_follows_the_likelihood():
    rng = np.random.default_rng(0)
    score = rng.normal(0, 2, 4000)
    y = (score + rng.logistic(size=4000) > -1).astype(int) + (score + rng.logistic(size=4000) > 50)
    y = np.where(y == 1, (score + rng.logistic(size=4000) > 1.5) + 1, 0)
    model = quality.fit([np.array([0], np.int32)] * 4000, list(score[:, None].astype(np.float32)), y, l2=0)
    assert 0.5 < model.weights[0] < 2 and model.thresholds[0] < model.thresholds[1]


def test_repeated_words_against_a_loop(docs, empty):
    got = _rows(substring_dedup.remove_repeated_words(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = Counter((i, a, b, d) for (i, *_), (a, b, _, d) in zip(ROWS, _removed([_words(t) for _, t, *_ in ROWS], 35, b" ".join)))
    assert got == want
    assert substring_dedup.remove_repeated_words(empty).count() == 0


def test_repeated_bytes_against_a_loop(docs, empty):
    got = _rows(suffix_dedup.remove_repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = Counter((i, *x) for (i, *_), x in zip(ROWS, _removed([(t or "").encode() for _, t, *_ in ROWS], 200, bytes)))
    assert got == want
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


@pytest.mark.parametrize("shard_runs", [1, 7])
def test_crowded_anchors_are_cut(spark, shard_runs):
    rng = np.random.default_rng(2)
    pool = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(pool, 60))
    texts = [f"{' '.join(rng.choice(pool, int(rng.integers(0, 60))))} {passage} {' '.join(rng.choice(pool, int(rng.integers(0, 60))))}" for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from corpusloom.llm.repeats import Windows, covered, with_repeats

    def gone(judge, spec, lead):
        rows = with_repeats(frame, spec, judge, lead, "doc_id", "text", shard_runs).toArrow()
        return {
            i.as_py(): int(covered(len(t.as_py().split() if spec.unit == "words" else t.as_py()), s, spec.width).sum()) for i, t, s in zip(*rows.columns)
        }

    words = [x for x in _removed([_words(t) for t in texts], 35, b" ".join)]
    assert gone(substring_dedup.parse_judge(35), Windows("words", 35, 10), None) == {i: x[1] for i, x in enumerate(words)}
    raw = [x for x in _removed([t.encode() for t in texts], 200, bytes)]
    assert gone(suffix_dedup.suffix_judge(200), Windows("bytes", 200, 50), 8) == {i: x[1] for i, x in enumerate(raw)}


def test_exact_groups_against_a_loop(docs, empty):
    for support in (0.001, 0.05):
        got = _rows(exact_dedup.exact_groups(docs, support=support), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
        groups = defaultdict(list)
        body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        for i, t, *_ in ROWS:
            groups[body(t)].append(i)
        least = {b: min((i for i in ids if i is not None), default=None) for b, ids in groups.items()}
        want = Counter((i, least[body(t)], len(groups[body(t)]), i == least[body(t)], hashlib.sha256(body(t).encode()).hexdigest()) for i, t, *_ in ROWS)
        assert got == want
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and _rows(kept, "doc_id") == Counter((x[0],) for x in want.elements() if x[3])
    assert exact_dedup.exact_groups(empty).count() == 0
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontamination(spark, docs, empty):
    rng = np.random.default_rng(4)
    pool = [f"t{i}" for i in range(500)]
    items = [(k, " ".join(rng.choice(pool, 40))) for k in range(12)] + [(50, None), (51, ""), (52, "two words"), (3, None)]
    texts = []
    for k in range(12):
        words = items[k][1].split()
        edited = words[:10] + ["changed"] + words[11:25] + words[27:]  # a substitution and a gap
        texts += [" ".join([*rng.choice(pool, 30), *x, *rng.choice(pool, 30)]) for x in (words, edited, [w.upper() + "," for w in words])]
    texts += [" ".join(rng.choice(pool, 200)) for _ in range(40)] + [None, "", "t1 t2 t3", " ".join(rng.choice(pool, 3_000))]
    frame = spark.createDataFrame([*enumerate(texts), (None, items[0][1])], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    test = spark.createDataFrame(items, "item_id long, text string")

    def brute(words, item):
        """Plain Smith-Waterman over the whole text."""
        row, best = [0] * (len(words) + 1), 0
        for x in item:
            new = [0]
            for j, y in enumerate(words):
                new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
            row, best = new, max(best, *new)
        return best / (2 * len(item))

    plain = lambda t: [decontaminate.plain(w) for w in (t or "").split()]
    want = {(i, k): round(s, 9) for i, t in [*enumerate(texts[:-1]), (None, items[0][1])] for k, x in items[:12] if t and (s := brute(plain(t), plain(x))) >= 0.5}
    for block_bytes in (1 << 20, 900):
        got = {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in decontaminate.contaminations(frame, test, block_bytes=block_bytes).collect()}
        assert got == want and len(want) == 37
    spans = {(r["doc_id"], r["item_id"]): (r["first_word"], r["end_word"]) for r in decontaminate.contaminations(frame, test).collect()}
    assert all(spans[3 * k, k] == (30, 70) for k in range(12))
    kept = decontaminate.drop_contaminated(frame, test)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == set(range(36, len(texts)))
    assert decontaminate.contaminations(frame, test.limit(0)).count() == 0 == decontaminate.contaminations(empty, test).count()


def test_packing_round_trip(spark, docs, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, pieces_per_bucket=20).toPandas()
    ids = [[*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 1] for _, t, *_ in ROWS]
    assert pieces["length"].sum() == sum(map(len, ids))
    want = Counter()
    for (i, *_), x in zip(ROWS, ids):
        for start in range(0, len(x), 2048):
            part = np.array(x[start : start + 2048], "<u4")
            want[i, start, len(part), zlib.crc32(part.tobytes()), len(x)] += 1
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces.itertuples())
    assert got == want
    laid = pieces.sort_values(["sequence_id", "offset"])
    filled = laid.groupby("sequence_id")["length"].cumsum()
    assert ((filled - laid["length"]) == laid["offset"]).all() and filled.max() <= 2048
    assert laid["sequence_id"].nunique() == -(-sum(map(len, ids)) // 2048)
    assert packing.pack(empty).count() == 0


def test_minimum_slack_is_optimal():
    rng = np.random.default_rng(6)
    for _ in range(60):
        capacity = int(rng.integers(5, 40))
        counts = {int(x): int(n) for x, n in zip(rng.integers(1, capacity + 1, 5), rng.integers(1, 4, 5))}
        used = dict(packing.fill(counts, capacity))
        assert all(n <= counts[x] for x, n in used.items()) and max(counts) in used
        sums = {max(counts)}
        for x, n in counts.items():
            sums |= {s + x * k for s in sums for k in range(1, n + 1 - (x == max(counts)))}
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= capacity)
        rows = packing.plan(counts, capacity)
        assert Counter({x: sum(r[2] - r[1] for r in rows if r[0] == x) for x in counts}) == Counter(counts)


def test_fingerprints_and_components(docs, empty):
    def fingerprint(text):
        found = (text or "").encode().lower().split()
        grams = [b" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([b" ".join(found)] if found else [])
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))

    prints = [fingerprint(t) for _, t, *_ in ROWS]
    root = list(range(len(ROWS)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ROWS)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for n, (i, *_) in enumerate(ROWS):
        least[find(n)] = min((x for x in (i, least.get(find(n))) if x is not None), default=None)
    want = Counter((i, f"{p:016x}", least[find(n)]) for n, ((i, *_), p) in enumerate(zip(ROWS, prints)))
    assert _rows(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_components(empty).count() == 0


def test_near_links_with_crowded_shards(spark):
    rng = np.random.default_rng(7)
    centre = [int(x) for x in rng.integers(0, 1 << 62, 4)]
    values = {c ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for c in centre for _ in range(120)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "print long")

    def groups(links):
        root = {v: v for v, in signed}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {v: find(v) for v in root}

    want = groups((a, b) for (a,), (b,) in ((x, y) for x in signed for y in signed if x < y) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    for shard_rows in (2048, 9):
        links = simhash.near_links(frame, shard_rows=shard_rows)
        assert groups((r["a"], r["b"]) for r in links.collect()) == want
        roots = {r["node"]: r["root"] for r in components(links).collect()}
        assert all(want[v] == r for v, r in roots.items()) and set(roots) == {v for v in want if list(want.values()).count(want[v]) > 1}


def test_pipeline_stages_on_a_table(spark, tmp_path, docs):
    for name, frame in {
        "documents": docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")),
        "labels": spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(0, ROWS[35][1][-200:])], "item_id long, text string"),
    }.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path)).cache()
        assert after.columns == table.columns and after.exceptAll(now).count() == 0, name
        now = after
    rows = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(r[2] for r in rows) == sum(len(packing.token_ids(r["text"])) for r in now.collect())
    assert len({r["doc_id"] for r in now.collect()}) > 10
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]


def test_registered_queries_cover_every_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES) == list(range(1, 14))
    assert json.dumps(sorted(queries.QUERIES))


def test_licence_lines_without_a_cue_are_scored(spark, docs):
    model = license_scan.train(docs)
    bodies = [
        "This Source Code Form is subject to the terms of the Mozilla Public", "you may not use this file except in compliance with the Apache",
        "zzz qqq", " ", "Licensee", "Released under the MIT License.",
    ]
    rows = [(1, "\n".join(bodies)), (2, bodies[0]), (None, "associated documentation files"), (3, None)]
    got = {(r["doc_id"], r["paragraph"]): r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 4), (1, 5), (2, 0), (None, 0)}
    for at, body in (((1, 0), bodies[0]), ((1, 1), bodies[1])):
        words = body.lower().split()
        hits = [model.vocabulary.index(g) for g in license_scan._gram_list(words) if g in model.vocabulary]
        odds = model.probabilities([hits])[0]
        assert abs(got[at]["probability"] - odds[1:].max()) < 1e-9
        assert got[at]["family"] == (model.classes[1 + odds[1:].argmax()] if odds[1:].max() >= license_scan.MIN_PROBABILITY else "unknown")


def test_pipeline_links_checked_fingerprints(spark):
    same = "a b c " * 200
    base = " ".join(f"o{i}" for i in range(200))
    # The first two share a fingerprint, but few of their distinct five-word shingles; the next two are copies but for case, the last has no words.
    texts = [same + " ".join(f"{n}w{i}" for i in range(12)) for n in "xy"] + [base, base.upper(), ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    assert simhash.simhash_components(frame, "key").where("key < 2").select("component_id").distinct().count() == 1
    assert [tuple(r) for r in near_copies.fingerprint_links(frame).collect()] == [(3, 2)]
    plan = near_copies.drop_near_copies(frame, "key")
    assert sorted(r["key"] for r in plan.collect()) == [0, 1, 2, 4]
