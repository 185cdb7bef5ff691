from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import scoring, text
from corpusloom.operators import candidates as cand
from corpusloom.operators import memory, relevance
from corpusloom.operators.relevance import lexical_match
from corpusloom.plans.adapters import prepare_requests
from corpusloom.plans.retrieve import artifact_pairs, retrieve


def corpus_frame(spark, rows):
    schema = "path string, content string, dependencies array<string>, symbols array<string>, modified_at timestamp, confidence double, scoped string"
    import datetime

    at = datetime.datetime(2024, 1, 31)
    return spark.createDataFrame([(p, c, d, [], at, None, s) for p, c, d, s in rows], schema)


def request_frame(spark, rows):
    return prepare_requests(spark.createDataFrame(rows, "request_id string, workspace_id string, prompt string, scoped string"))


def now():
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))


def test_terms_keep_compact_forms(spark):
    got = spark.range(1).select(text.intent_terms(F.lit("Fix actions.xml now\nplease a")).alias("t")).first()["t"]
    assert set(got) == {"fix", "actions", "xml", "now", "please", "actionsxml", "nowplease"}


def test_match_in_one_or_many_blocks_agrees_with_a_plain_loop(spark):
    docs = [("d1", "The Hat sat"), ("d2", "nothing here"), ("d3", "hat hat mat-xml"), ("d3", "hat hat mat-xml"), ("d4", None)]
    asked = [("r1", ["hat", "sat", "hat"]), ("r2", ["zz"]), ("r3", []), ("r4", ["mat-xml", "a"])]
    d = spark.createDataFrame(docs, "id string, body string")
    q = spark.createDataFrame(asked, "request_id string, terms array<string>")
    expected = sorted(
        (r, i, sum(t in (b or "").lower() for t in ts))
        for r, ts in asked for i, b in docs if ts and sum(t in (b or "").lower() for t in ts) / len(ts) > 0.05
    )
    for block_chars in (1_000_000, 8, 1):  # 1, 3 and 18 blocks
        got = lexical_match(q, d, haystack=F.col("body"), keep=["id"], block_chars=block_chars).collect()
        assert sorted((g["request_id"], g["id"], g["hits"]) for g in got) == expected, block_chars
    assert lexical_match(q.limit(0), d, haystack=F.col("body")).count() == lexical_match(q, d.limit(0), haystack=F.col("body")).count() == 0


def test_requests_only_meet_their_scope(spark):
    docs = corpus_frame(spark, [("src/inventory.cs", "inventory A", [], "w1::p"), ("src/inventory.cs", "inventory B", [], "w2::p")])
    asked = request_frame(spark, [("r1", "w1", "inventory manager", "w1::p"), ("r2", "w2", "inventory manager", "w2::p")])
    ready = cand.artifact_documents(docs, now())
    pairs = artifact_pairs(asked, ready, scope="scoped")
    assert sorted((r["request_id"], r["size"]) for r in pairs.select("request_id", "size").collect()) == [("r1", 11), ("r2", 11)]


def test_oversized_top_candidate_is_clipped(spark):
    giant = "# actions\n" + "itemid actionid uniqueid script register\n" * 800
    docs = corpus_frame(spark, [("data/actions/actions.xml", giant, ["itemid"], "x")])
    asked = request_frame(spark, [("r", "mmo_workspace", "actions.xml itemid actionid uniqueid", "x")])
    packet = retrieve(asked, docs, now(), max_chars=600).packets.first()
    assert packet["selected"][0]["source"] == "artifact:file:data/actions/actions.xml"
    assert packet["selected"][0]["content"].endswith("...") and packet["used_chars"] <= 600


def test_noise_paths_never_become_candidates(spark):
    docs = corpus_frame(
        spark, [("src/boost_guard.h", "boost", [], "x"), ("vcpkg_installed/a/boost.hpp", "boost", [], "x"), ("build/CMakeCache.txt", "boost", [], "x")]
    )
    assert [r["path"] for r in cand.artifact_documents(docs, now()).collect()] == ["src/boost_guard.h"]


def test_profiles_add_up(spark):
    row = request_frame(spark, [("r", "mmo_workspace", "actions.xml register opcode routing", "x")]).first()
    assert row["profile_name"] == "mmo_profile+networking_profile+lua_profile+xml_profile"
    got = [round(row[f"{b}_boost"], 2) for b in ("xml", "scripts", "src", "networking")]
    assert got == [0.56, 0.38, 0.34, 0.36]


def test_fallback_equals_scoring_everything(spark):
    rows = [(f"{d}/f{i}{e}", "body", ["x"] * (i % 3), "x") for d in ("src", "data/scripts/a", "docs", "data/items") for e in (".xml", ".lua") for i in range(40)]
    docs = cand.artifact_documents(corpus_frame(spark, rows), now())
    asked = request_frame(spark, [("r1", "mmo_workspace", "qqq", "x"), ("r2", "plain", "zzzz f7.xml drop", "x"), ("r3", "plain", "wwww", "x")]).withColumn(
        "terms", F.array(F.lit("qqqqqq"))
    )
    none = spark.createDataFrame([], "request_id string")
    got = cand.fallback_candidates(asked, docs, none, k=10)
    everything = cand.score_artifacts(asked.crossJoin(docs.filter("is_domain").drop("scoped")).withColumn("relevance", F.lit(0.0)))
    expected = cand._top_by_importance(everything, 10)
    key = lambda df: sorted((r["request_id"], r["source"], round(r["importance"], 6)) for r in df.collect())
    assert key(got) == key(expected)


def test_semantic_blend_and_cosine(spark):
    row = spark.range(1).select(
        scoring.cosine01(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"),
        scoring.cosine01(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
        scoring.blended_relevance(F.lit(0.5), F.lit(0.9)).alias("b"), scoring.blended_relevance(F.lit(0.5), F.lit(0.0)).alias("plain"),
    ).first()
    assert (row["c"], row["zero"], row["b"], row["plain"]) == (0.8536, 0.0, 0.72, 0.5)


def test_memory_search_limits_and_scope(spark):
    rows = [(f"m{i}", "p", "u" if i % 2 else "v", "project", f"note {i} alpha", 0.5, i) for i in range(30)]
    mem = spark.createDataFrame(rows, "id string, project_id string, user_id string, scope string, content string, confidence double, seq long").withColumn("updated_at", F.timestamp_seconds("seq"))
    asked = spark.createDataFrame([("a", "p", "u", "ALPHA beta"), ("b", "p", "v", "?"), ("c", "p", "u", "zzz")], "request_id string, project_id string, user_id string, prompt string")
    got = {}
    for r in memory.memory_search(asked, mem, 3).collect():
        got.setdefault(r["request_id"], []).append(r["seq"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": [25, 27, 29], "b": [24, 26, 28]}


def test_tasks_keep_only_the_best_pairs(spark, monkeypatch):
    rows = [(i, f"alpha note {i % 7}" + (" beta" if i % 3 == 0 else ""), None if i % 11 == 0 else f"n{i % 40:02d}", None if i % 13 == 0 else i // 2, (i % 5) / 4) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc long, content string, name string, at long, confidence double").repartition(3)
    asked = spark.createDataFrame([("a", ["alpha", "beta"]), ("b", ["beta"]), ("c", ["note 3"])], "request_id string, terms array<string>")
    weight = F.lit(0.6) + F.lit(0.4) * F.col("confidence")
    everything = lexical_match(asked, docs, haystack=F.col("content"), min_rel=0.0).withColumn("score", F.col("relevance") * weight)
    monkeypatch.setattr(relevance, "HELD_PAIRS", 8)
    monkeypatch.setattr(relevance, "OUTPUT_PAIRS", 16)
    for ties, order in (
        ([("name", "ascending"), ("doc", "ascending")], [F.asc("name"), F.asc("doc")]),
        ([("at", "descending"), ("doc", "descending")], [F.desc("at"), F.desc("doc")]),
    ):
        best = lexical_match(asked, docs, haystack=F.col("content"), min_rel=0.0, best=(5, ties), weight=weight).withColumn("score", F.col("relevance") * weight)
        w = Window.partitionBy("request_id").orderBy(F.desc("score"), *order)
        top = lambda df: sorted((r["request_id"], r["n"], r["doc"]) for r in df.withColumn("n", F.row_number().over(w)).filter("n <= 5").collect())
        assert top(best) == top(everything) and len(top(best)) == 15
        assert best.count() < everything.count()


def test_searches_shuffle_keys_and_not_contents(spark):
    mem = spark.createDataFrame([(f"m{i}", "p", "u", "project", f"alpha {i} " + "x" * 5000, 0.5, i) for i in range(40)], "id string, project_id string, user_id string, scope string, content string, confidence double, seq long").withColumn("updated_at", F.timestamp_seconds("seq"))
    asked = spark.createDataFrame([(f"r{i}", "p", "u", "alpha", ["t"]) for i in range(6)], "request_id string, project_id string, user_id string, prompt string, terms array<string>")
    found = memory.memory_search(asked, mem, 3, carry=("terms",))
    assert sorted((r["request_id"], r["seq"]) for r in found.collect()) == [(f"r{i}", s) for i in range(6) for s in (37, 38, 39)]
    assert set(found.columns) == {*mem.columns, "request_id", "terms"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in "".join(line for line in plan.splitlines() if "Window" in line or "Aggregate" in line or "Generate" in line)
    nodes = spark.createDataFrame([(f"n{i}", "t", "p", "alpha" if i else "alpha beta", ["d"], ["q"], i / 40) for i in range(40)], "node_id string, title string, source_path string, summary string, dependencies array<string>, patterns array<string>, confidence double")
    best = memory.knowledge_search(asked.limit(1), nodes, 2)
    assert [r["node_id"] for r in best.orderBy("rank").collect()] == ["n39", "n38"]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # ranked before whole nodes join


def test_memory_search_takes_older_memories_only_for_words_without_answer(spark, monkeypatch):
    """Requests that the newest memories answer leave the search; the rest go on to all memories, with the results of comparing every pair."""
    monkeypatch.setattr(memory, "DEPTHS", (10, 40), raising=False)
    searched = []

    def recorded(requests, corpus, **how):
        searched.append((corpus.count(), {r["terms"][0] for r in requests.select("terms").collect()}))
        return lexical_match(requests, corpus, **how)

    monkeypatch.setattr(memory, "lexical_match", recorded)

    def content(i):
        return f"Alpha {i % 3}" + (" mid" if i % 7 == 0 else "") + (" seldom" if i % 60 == 0 else "") + (" once" if i == 4 else "")

    rows = [(f"m{i}", "p", "u" if i % 2 else "v", None if i % 50 == 49 else content(i), None if i in (4, 8) else i) for i in range(300)]
    rows += [rows[0], rows[120], rows[299], ("n", "p", None, "alpha", 500), ("w", "p", "w", "once", 1)]
    mem = spark.createDataFrame(rows, "id string, project_id string, user_id string, content string, seq long").withColumn("updated_at", F.timestamp_seconds("seq"))
    prompts = ["alpha", "ONCE alpha", "once", "mid zz", "seldom", "zz", "?", None, "mid seldom once", "alpha 1"]
    asked = [(f"{user}{n}", "p", user, prompt) for user in ("u", "v", "w", None) for n, prompt in enumerate(prompts)]
    asked.append(asked[2])
    got = {}
    for r in memory.memory_search(spark.createDataFrame(asked, "request_id string, project_id string, user_id string, prompt string"), mem, 3).collect():
        got.setdefault(r["request_id"], []).append((r["id"], r["seq"]))
    newest = sorted(rows, key=lambda r: -1 if r[4] is None else r[4], reverse=True)
    expected = {}
    for request, _, user, prompt in asked:
        own = [r for r in newest if user is not None and r[2] == user]
        words = [w for w in (prompt or "").lower().split() if len(w) >= 2]
        holding = {w: [r for r in own if w in (r[3] or "").lower()][:3] for w in words}
        found = {(r[0], r[4]) for of_word in holding.values() for r in of_word}
        if prompt is not None and not words and own:
            expected[request] = [(r[0], r[4]) for r in own[:3]]
        elif found:
            expected[request] = sorted(found, key=lambda f: -1 if f[1] is None else f[1], reverse=True)[:3]
    asked_twice = asked[2][0]
    assert {k: sorted(v, key=str) for k, v in got.items() if k != asked_twice} == {k: sorted(v, key=str) for k, v in expected.items() if k != asked_twice}
    assert set(got.get(asked_twice, [])) == set(expected.get(asked_twice, []))
    assert [n for n, words in searched if "alpha" in words] == [21]  # ten memories of u and of v, one of w
    assert len(searched) == 3 and searched[2][0] > 200 and "once" in searched[2][1]
