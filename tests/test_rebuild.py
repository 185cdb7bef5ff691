"""The incremental rebuild against a full one, and after a run that dies between its writes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import diff, files, hierarchy
from corpusloom.operators.files import describe_files
from corpusloom.sources import sinks
from corpusloom.streaming import rebuild as rb


def _listing(spark, state):
    rows = [(project, path, body) for (project, path), body in state.items()]
    frame = spark.createDataFrame(rows, "project string, path string, content string")
    return describe_files(frame).withColumn("hash", F.sha2("content", 256))


def _states():
    """Three states: files appear, change, move and vanish, a module and a root file with them; project q is not named in the third."""
    rng = random.Random(5)
    names = [f"{m}/{f}x{i}.py" for m in ("a", "b", "c/d", "7") for f in ("", "k/") for i in range(2)] + ["root.py", "other.md"]
    body = lambda n, v: f"import os\nfrom {n.replace('/', '_').split('.')[0]} import event_{v}\n" + "line\n" * (len(n) % 3)
    first = {(p, n): body(n, 0) for p in ("p", "q") for n in names}
    second = dict(first)
    second["p", "a/x0.py"] = body("a/x0.py", 1)
    second["p", "a/k/new.py"] = body("new", 0)
    second["p", "b/moved.py"] = second.pop(("p", "b/x1.py"))
    for n in [n for p, n in first if p == "p" and n.startswith("7/")]:
        del second["p", n]  # a whole module goes
    third = {k: v for k, v in second.items() if k[0] == "p"}
    third.pop(("p", "root.py"))
    third["p", "c/d/k/x0.py"] = body("c", rng.randrange(9) + 2)
    third["p", "z/only.py"] = "x = 1\n"
    return [first, second, third]


def _full(spark, state, projects, before):
    """Nodes of a rebuild from nothing, generations counted on from ``before``."""
    listing = _listing(spark, {k: v for k, v in state.items() if k[0] in projects})
    leaves = hierarchy.file_nodes(files.parse_knowledge_files(listing))
    inner = hierarchy.rollup_levels(leaves, hierarchy.build_hierarchy(listing))
    got = {(r["project"], r["node_id"]): (r["parent_id"], r["source_hash"], round(r["confidence"], 2)) for part in (leaves, inner) for r in part.collect()}
    return {k: (*v, before[k][3] + (before[k][1] != v[1]) if k in before else 1) for k, v in got.items()}


def _nodes(spark, root):
    return {(r["project"], r["node_id"]): (r["parent_id"], r["source_hash"], round(r["confidence"], 2), r["generation"]) for r in rb.read_state(spark, root, "nodes").collect()}


def _rest(spark, root):
    edges = sorted(tuple(str(x) for x in r) for r in rb.read_state(spark, root, "edges").drop("epoch").collect())
    lines = sorted(tuple(str(x) for x in r) for r in rb.read_state(spark, root, "folders").drop("epoch").collect())
    return edges, lines


def test_rebuild_equals_a_full_one_and_survives_a_dying_run(spark, tmp_path, monkeypatch):
    root, clean, want = str(tmp_path / "state"), {}, {}
    run = rb.incremental_rebuild(root)
    for epoch, state in enumerate(_states()):
        projects = {p for p, _ in state}
        want = {**{k: v for k, v in want.items() if k[0] not in projects}, **_full(spark, state, projects, want)}
        if epoch == 1:  # the run dies after its last write before the commit
            for broken in (3,):
                calls = []

                def dying(frame, *args, broken=broken, calls=calls, write=sinks.write_partitions, **kwargs):
                    write(frame, *args, **kwargs)
                    calls.append(1)
                    if len(calls) == broken:
                        raise RuntimeError("lost")

                monkeypatch.setattr(sinks, "write_partitions", dying)
                with pytest.raises(RuntimeError):
                    run(_listing(spark, state), epoch)
                monkeypatch.undo()
                assert _nodes(spark, root) == clean  # nothing of it is visible
        run(_listing(spark, state), epoch)
        run(_listing(spark, state), epoch)
        clean = _nodes(spark, root)
        assert clean == want
    # The other tables are those of a state built at once from what each project last was.
    states = _states()
    last = {**{k: v for k, v in states[1].items() if k[0] == "q"}, **states[2]}
    fresh = str(tmp_path / "fresh")
    rb.incremental_rebuild(fresh)(_listing(spark, last), 0)
    assert _rest(spark, root) == _rest(spark, fresh)
    assert sinks.snapshot_versions(spark, rb.commit_path(root)) == [0, 1, 2]


def test_untouched_modules_are_not_written_again(spark, tmp_path):
    root = str(tmp_path / "state")
    run = rb.incremental_rebuild(root)
    first, *_ = _states()
    run(_listing(spark, first), 0)
    run(_listing(spark, {**first, ("p", "a/x0.py"): "changed\n"}), 1)
    run(_listing(spark, {**first, ("p", "a/x0.py"): "changed\n"}), 2)
    written = spark.read.schema(rb.SCHEMAS["nodes"]).parquet(f"{root}/nodes").filter("epoch > 0").select("project", "module", "epoch").distinct()
    assert sorted(tuple(r) for r in written.collect()) == [("p", "/", 1), ("p", "a", 1)]
    parsed = spark.read.parquet(f"{root}/events/epoch=1")
    assert [(r["path"], r["event_type"]) for r in parsed.collect()] == [("a/x0.py", "modified")]
    assert spark.read.parquet(f"{root}/events/epoch=2").count() == 0
    plan = rb.read_state(spark, root, "nodes")._jdf.queryExecution().optimizedPlan().toString()
    assert "module" in plan and diff.drift_count(*[rb.read_state(spark, root, "nodes").select("project", "node_id", "source_hash")] * 2, "project").agg(F.sum("drift")).first()[0] == 0


def test_a_hot_parent_is_sorted_in_parts(spark):
    rows = [("p", f"hot/f{i * 7919 % 20011:05d}.py", f"h{i}") for i in range(20_000)] + [("p", f"d{i % 50}/f{i}.py", f"h{i}") for i in range(20_000)]
    listed = spark.createDataFrame(rows, "project string, path string, hash string")
    leaves = hierarchy.file_nodes(listed.withColumn("confidence", F.lit(0.6)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = hierarchy.child_pieces(leaves).withColumn("task", F.spark_partition_id())
        sizes = parts.groupBy("task").agg(F.sum(F.size(F.split("piece", r"\|"))).alias("n")).collect()
        hot = parts.filter("parent_id = 'folder:hot'").select("task").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["n"] for r in sizes) == 40_000 and max(r["n"] for r in sizes) < 10_000 and hot >= 4
    text = "|".join(f"file:{path}:{h}" for _, path, h in sorted(rows) if path.startswith("hot/"))
    got = hierarchy.merkle_hash(listed).filter("node_id = 'folder:hot'").first()["source_hash"]
    assert got == hashlib.sha256(text.encode()).hexdigest()
