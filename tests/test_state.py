import datetime
import hashlib
import json
import random

from pyspark.sql import functions as F

from corpusloom.operators import diff, edits, hierarchy, quality
from corpusloom.operators.files import describe_files, extract_files, summarize_files
from corpusloom.sources import readers, sinks
from corpusloom.streaming.cooldown import cooldown_trigger
from corpusloom.streaming.rebuild import commit_path, incremental_rebuild


def test_cooldown_equals_a_sequential_walk(spark):
    rng = random.Random(3)
    rows, t = [], {"a": 0.0, "b": 0.0, "c": 0.0}
    for seq in range(1500):
        w = rng.choice("aaaab") if seq < 1400 else "c"
        t[w] += rng.choice([0, 0.5, 7, 60, 119, 120, 4000])
        rows.append((w, seq, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t[w]), rng.random() < 0.6))
    ends, expected = {}, {}
    for w, seq, at, weak in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if w in ends and at < ends[w]:
            expected[seq] = (False, "cooldown_active")
        elif weak:
            expected[seq] = (True, "weak_context")
            ends[w] = at + datetime.timedelta(seconds=120)
        else:
            expected[seq] = (False, "context_sufficient")
    frame = spark.createDataFrame(rows, "workspace_id string, seq long, at timestamp, weak boolean")
    got = {r["seq"]: (r["fired"], r["reason"]) for r in cooldown_trigger(frame, 120, 600).collect()}
    assert got == expected


def test_evaluation_of_the_known_traces(spark, tmp_path):
    def event(rid, kind, **payload):
        return json.dumps({"request_id": rid, "event_type": kind, "payload": {"project_id": "M", "user_id": "u", **payload}})

    good = {"avg_context_score": 0.82, "context_count": 3, "dropped_by_budget": 0, "used_chars": 3000, "max_chars": 3500}
    bad = {"avg_context_score": 0.18, "context_count": 0, "dropped_by_budget": 2, "used_chars": 600, "max_chars": 3500}
    lines = [
        event("r1", "retrieval.assembly", relevant_systems=["I"], dependencies_count=2, risks=[], retrieval=good),
        event("r2", "retrieval.assembly", relevant_systems=[], dependencies_count=3, risks=["2 may be stale"], retrieval=bad),
        event("r1", "route.decision", reason="passed", confidence=0.9, retrieval=good, usage={"prompt_tokens": 120, "completion_tokens": 160, "total_tokens": 280, "cost_usd": 0.005}),
        event("r2", "route.decision", reason="passed", confidence=0.86, retrieval={**bad, "avg_context_score": 0.1}, usage={"prompt_tokens": 80, "completion_tokens": 100, "total_tokens": 180, "cost_usd": 0.003}),
        event("r2", "cognitive.feedback", verdict="incorrect", issues=["hallucination", "xml_missing", "retrieval_incorrect"]),
        "{not json", "[1]",
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    traces = readers.read_traces(spark, str(tmp_path / "t.jsonl")).withColumn("seq", F.monotonically_increasing_id())
    r = quality.evaluate(traces, limit=100, project="M", user="u").first()
    assert r["sample_size"] == 5
    got = [r[c] for c in ("retrieval_precision", "stale_context_rate", "hallucination_rate", "architectural_consistency", "reasoning_success", "token_efficiency", "total_cost_usd")]
    assert got == [0.5, 0.5, 0.5, 0.5, 1.0, 0.4286, 0.008]
    assert (r["prompt_tokens"], r["completion_tokens"], r["total_tokens"]) == (200.0, 260.0, 460.0)
    assert r["feedback_incorrect_rate"] == r["feedback_xml_missing_rate"] == 1.0 and r["feedback_correct_rate"] == 0.0


def test_diagnosis_of_the_known_usage(spark):
    usage = spark.createDataFrame(
        [(0, True, False, [], ["classic-x"] * 26, ["data/talkactions/a"] * 5, [], (1900,))],
        "selected_count int, xml_focus boolean, xml_selected boolean, relevant_systems array<string>, dependencies array<string>, top_sources array<string>, risks array<string>, compression struct<dropped_count:int>",
    )
    counts = quality.failure_counts(usage)
    feedback = spark.createDataFrame([(1, ["xml_missing", "hallucination"])], "seq int, issues array<string>")
    got = {r["failure_type"]: r["count"] for r in quality.diagnose(counts, feedback).collect()}
    assert got == {
        "xml_missing": 2, "semantic_misdirection": 2, "graph_underexpansion": 1, "compression_loss": 1, "dependency_noise": 1, "ranking_collision": 1,
        "stale_summary": 0, "wrong_module": 0, "graph_overexpansion": 0, "wrong_generation": 0,
    }


def _snapshot(spark, files):
    return spark.createDataFrame([("p", path, h) for path, h in files.items()], "project string, path string, hash string")


def test_watch_sequence(spark):
    states = [{}, {"a.py": "1"}, {"a.py": "1"}, {"a.py": "2"}, {"b.py": "2"}]
    seen = []
    for before, now in zip(states, states[1:]):
        events = diff.resolve_changes(diff.snapshot_diff(_snapshot(spark, now), _snapshot(spark, before))).collect()
        seen.append([(e["event_type"], e["path"], e["previous_path"]) for e in events])
    assert seen == [[("created", "a.py", None)], [], [("modified", "a.py", None)], [("renamed", "b.py", "a.py")]]


def test_merkle_root_and_generation(spark):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    files = {"x.py": "h0", "a/b/y.py": "h1", "a/z.py": "h2"}
    rows = hierarchy.merkle_hash(_snapshot(spark, files)).collect()
    got = {r["node_id"]: r["source_hash"] for r in rows}
    b = digest("file:a/b/y.py:h1")
    a = digest(f"file:a/z.py:h2|folder:a/b:{b}")
    module, root = digest(f"folder:a:{a}"), digest("file:x.py:h0")
    project = digest(f"module:a:{module}|module:root:{root}")
    assert got == {
        "folder:a/b": b, "folder:a": a, "module:a": module, "module:root": root, "project:p": project, "global:default": digest(f"project:p:{project}"),
    }
    changed = hierarchy.merkle_hash(_snapshot(spark, {**files, "a/b/y.py": "new"})).collect()
    before = spark.createDataFrame([("p", k, v, 4) for k, v in got.items()], "project string, node_id string, source_hash string, generation int")
    now = spark.createDataFrame([("p", r["node_id"], r["source_hash"]) for r in changed], "project string, node_id string, source_hash string")
    bumped = {r["node_id"]: r["generation"] for r in diff.bump_generation(now, before, "project").collect()}
    assert bumped == {"folder:a/b": 5, "folder:a": 5, "module:a": 5, "module:root": 4, "project:p": 5, "global:default": 5}


def test_markers_and_purposes(spark):
    xml = '<actions>\n<action itemid="2420" actionid="7546" script="tools/machete.lua" />\n<action fromaid="5000" toaid="5003" /></actions>'
    lua = "local tmTeachAction = Action()\nfunction tmTeachAction.onUse(player)\nend\ntmTeachAction:id(3)\ntmTeachAction:allowFarUse(true)\ntmTeachAction:register()"
    rows = [("p", "data/actions/actions.xml", xml), ("p", "data/scripts/s/tm.lua", lua), ("p", "data/actions/scripts/t/m.lua", "function onUse(p)\nend")]
    files = describe_files(spark.createDataFrame(rows, "project string, path string, content string")).withColumn("hash", F.lit("h"))
    got = {r["path"]: r for r in summarize_files(files).collect()}
    assert {"itemid", "actionid", "fromaid", "toaid", "script", "script:tools/machete.lua", "classic-action-bind"} <= set(got["data/actions/actions.xml"]["dependencies"])
    assert {"Action()", ":id", ":allowFarUse", ":register", "onUse", "revscripts-action"} <= set(got["data/scripts/s/tm.lua"]["dependencies"])
    assert {"onUse", "classic-action-script"} <= set(got["data/actions/scripts/t/m.lua"]["dependencies"])
    assert "classic Action XML binds" in got["data/actions/actions.xml"]["summary"]
    assert "Revscripts Action" in got["data/scripts/s/tm.lua"]["summary"]
    assert got["data/scripts/s/tm.lua"]["symbols"] == ["tmTeachAction", "tmTeachAction.onUse"]


def test_scan_and_incremental_rebuild(spark, tmp_path):
    root = tmp_path / "in"
    for name, body in {"P/src/a.py": b"import os\n", "P/node_modules/b.py": b"x", "P/c.bin": b"x", "P/d.txt": "é".encode("latin-1"), "P/big.xml": b"<a/>" * 100_000}.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    got = {r["path"]: r for r in readers.scan_corpus(spark, str(root)).collect()}
    assert set(got) == {"src/a.py", "d.txt", "big.xml"}
    assert got["d.txt"]["content"] == "é" and got["src/a.py"]["language"] == "python" and got["d.txt"]["module"] == "root"
    assert set(r["path"] for r in readers.scan_corpus(spark, str(root), variant="knowledge").collect()) == {"src/a.py", "d.txt"}

    rebuild = incremental_rebuild(str(tmp_path / "out"))
    batch = readers.scan_corpus(spark, str(root))
    rebuild(batch, 0)
    rebuild(batch, 0)
    (root / "P/src/a.py").write_bytes(b"import sys\n")
    rebuild(readers.scan_corpus(spark, str(root)), 1)
    events = spark.read.parquet(str(tmp_path / "out/events")).groupBy("epoch", "event_type").count().collect()
    assert sorted((e["epoch"], e["event_type"], e["count"]) for e in events) == [(0, "created", 3), (1, "modified", 1)]
    assert sinks.snapshot_versions(spark, commit_path(str(tmp_path / "out"))) == [0, 1]


def test_patches_apply_in_order(spark):
    step = "struct<find:string,replace:string,replace_all:boolean,use_regex:boolean>"
    rows = [
        ("a", "one two one", [("one", "1", False, False), ("two", "one", False, False), ("one", "X", True, False)]),
        ("b", "k=1; k=2", [(r"k=(\d)", r"v\1", False, True), ("k", "K", True, False)]),
        ("c", "zzz", [("q", "r", True, False)]),
    ]
    frame = spark.createDataFrame(rows, f"id string, body string, patches array<{step}>")
    got = {r["id"]: (r["p"]["content"], r["p"]["matched"]) for r in frame.select("id", edits.patch_text(F.col("body"), F.col("patches")).alias("p")).collect()}
    assert got == {"a": ("1 X X", True), "b": ("v1; K=2", True), "c": ("zzz", False)}


def test_numbers_in_prompts(spark):
    prompts = ["set rate to 1.5", "taxa da bola para 3", "use 4 and 7", "none", "add +2", "increase by 3"]
    frame = spark.createDataFrame([(p,) for p in prompts], "p string")
    got = [(r["r"], r["i"]) for r in frame.select(edits.parse_rate(F.col("p")).alias("r"), edits.is_increment(F.col("p")).alias("i")).collect()]
    assert got == [("1.5", False), ("3", False), ("7", False), (None, False), ("2", True), ("3", True)]


def test_extraction_survives_long_prose(spark):
    prose = "word " * 20_000
    frame = spark.createDataFrame([("x.py", "python", prose)], "path string, language string, content string")
    assert extract_files(frame).first()["symbols"] == []


def test_tasks_list_folders_and_open_only_what_is_kept(spark, tmp_path):
    root = tmp_path / "tree"
    names = ["top.py", "p/a.py", "p/a b%20é.py", "p/deep/er/x.lua", "p/_hidden.py", "p/_k=1/y.py", "p/.dot.py", "p/._COPYING_", "_q/z.py", "r/empty.py", "r/big.xml", "r/other.bin", "r/node_modules/m.py"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if "empty" in name else b"x" * 400_000 if "big" in name else name.encode("latin-1"))
    columns = ["project", "path", "size", "modified_at"]
    want = sorted(tuple(r) for r in readers.list_files(spark, str(root)).select(*columns).collect())
    for place in (str(root), f"file://{root}/"):
        walked = readers.walk_files(spark, place)
        assert sorted(tuple(r) for r in walked.select(*columns).collect()) == want
    contents = {(r["project"], r["path"]): bytes(r["content"]) for r in readers.list_files(spark, str(root)).collect()}
    assert {(r["project"], r["path"]): bytes(r["content"]) for r in readers.with_contents(walked, f"file://{root}").collect()} == contents
    found = readers.scan_corpus(spark, str(root))
    assert {r["path"] for r in found.collect()} == {"top.py", "a.py", "a b%20é.py", "deep/er/x.lua", "_k=1/y.py", "big.xml"}
    assert "binaryFile" not in found._jdf.queryExecution().toString()  # no index of all files on the driver, no task for every 32 of them
    assert readers.walk_files(spark, f"unknown://{root}") is None
