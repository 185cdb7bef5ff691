"""Fan-out of a stream, merged KPI parts, tenancy and bounded matching."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import quality
from corpusloom.operators.relevance import lexical_match
from corpusloom.sources import readers, sinks
from corpusloom.sources.tables import SPREAD, read_table
from corpusloom.streaming.traces import compact_kpis, fan_out, land_kpis, read_kpis


def test_a_failing_consumer_is_repeated_alone(spark, tmp_path):
    seen, broken = Counter(), {"b": 2}

    def consumer(name):
        def run(batch, epoch):
            if broken.get(name):
                broken[name] -= 1
                raise OSError(name)
            seen[name, epoch] += batch.count()

        return run

    deliver = fan_out({name: consumer(name) for name in "abc"}, str(tmp_path / "marks"))
    batch = spark.range(5)
    for _ in range(2):
        with pytest.raises(RuntimeError, match="epoch 7: b"):
            deliver(batch, 7)
        assert seen == {("a", 7): 5, ("c", 7): 5}
    deliver(batch, 7)
    deliver(batch, 7)
    assert seen == {(name, 7): 5 for name in "abc"}
    deliver(batch, 8)
    assert sum(seen.values()) == 30


def test_parts_merge_to_the_report_of_all_rows(spark, tmp_path):
    rng = random.Random(2)
    kinds = ("retrieval.assembly", "route.decision", "cognitive.feedback", "other")
    rows = [
        {
            "created_at": f"2024-03-0{rng.randint(1, 4)}T05:00:00Z", "event_type": rng.choice(kinds),
            "payload": {
                "confidence": rng.choice([None, 0.5, 0.9]), "verdict": rng.choice([None, " Correct", "partial"]), "issues": rng.choice([None, [], ["Hallucination "]]),
                "retrieval": rng.choice([None, {"avg_context_score": 0.25, "context_count": 3, "dropped_by_budget": 1, "used_chars": 500, "max_chars": 1000}]),
                "usage": rng.choice([None, {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7, "cost_usd": 0.1}]), "risks": rng.choice([None, ["may be STALE"]]),
            },
        }
        for _ in range(200)
    ]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, rows)))
    traces = spark.read.schema(readers.TRACE_SCHEMA).json(str(tmp_path / "t.json"))
    land = land_kpis(str(tmp_path / "kpis"))
    for epoch in range(3):
        land(traces.filter(F.pmod(F.xxhash64(F.to_json("payload"), "created_at"), F.lit(3)) == epoch), epoch)
    whole = traces.withColumn("window_start", F.window("created_at", "1 day")["start"]).groupBy("window_start").agg(*quality.kpi_columns())
    want = sorted(map(str, whole.collect()))
    assert sorted(map(str, read_kpis(spark, str(tmp_path / "kpis")).select(whole.columns).collect())) == want
    compact_kpis(spark, str(tmp_path / "kpis"), str(tmp_path / "less"))
    assert sorted(map(str, read_kpis(spark, str(tmp_path / "less")).select(whole.columns).collect())) == want
    assert spark.read.parquet(f"{tmp_path}/less/epoch=-1").count() == len(want)


def test_tenants_prune_partitions(spark, tmp_path):
    rows = [(f"w{i % 6}", f"p{i % 5}", i) for i in range(90)]
    sinks.write_partitions(spark.createDataFrame(rows, "workspace_id string, project_id string, n int"), str(tmp_path / "t"), "workspace_id", "project_id")
    asked = [("w1", "p1"), ("w2", "p2"), ("w2", "p2"), ("w3", ""), (None, "p4")]
    spark.createDataFrame(asked, "workspace_id string, project_id string").write.parquet(str(tmp_path / "asked"))
    found = readers.tenant_rows(spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "asked")))
    assert sorted(r["n"] for r in found.collect()) == sorted(n for w, p, n in rows if (w, p) in asked)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        again = readers.tenant_rows(spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "asked")))
        plan = again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert any("dynamicpruning" in line.split("PartitionFilters", 1)[1] for line in plan.split("\n") if "PartitionFilters" in line)


@pytest.mark.parametrize("block", [{}, {"block_entries": 40}, {"block_chars": 5}])
def test_the_best_of_all_are_among_the_best_of_tasks(spark, block):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=12))) for i in range(300)]
    asked = [(f"r{i}", rng.sample(words, 6) + ["t1"]) for i in range(20)]
    d = spark.createDataFrame(docs, "id long, body string").repartition(5)
    q = spark.createDataFrame(asked, "request_id string, terms array<string>")
    pairs = lexical_match(q, d, haystack=F.col("body"), keep=["id"], best=(3, "id"), **block).collect()
    got = {}
    for r in pairs:
        got.setdefault(r["request_id"], []).append((-r["hits"], r["id"]))
    want = {r: sorted((-sum(t in b for t in ts), i) for i, b in docs)[:3] for r, ts in asked}
    assert {r: sorted(x)[:3] for r, x in got.items()} == want
    assert max(map(len, got.values())) <= 3 * 5
    assert not any("Exchange" in line for line in lexical_match(q, spark.range(3).withColumn("body", F.lit("t1")), haystack=F.col("body"))._jdf.queryExecution().executedPlan().toString().split("\n"))


def test_spread_is_a_parameter(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "x.parquet"))
    assert read_table(spark, str(tmp_path), "x").rdd.getNumPartitions() == 1
    spark.conf.set(SPREAD, "7")
    try:
        assert read_table(spark, str(tmp_path), "x").rdd.getNumPartitions() == 7
    finally:
        spark.conf.unset(SPREAD)
