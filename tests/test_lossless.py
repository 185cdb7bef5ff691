"""Results that must not depend on how the input is dealt out, and input that must not end a job."""

import json

from pyspark.sql import functions as F

from corpusloom.functions.text import chunk_text
from corpusloom.operators import quality
from corpusloom.operators.edits import patch_text
from corpusloom.operators.hierarchy import merkle_hash
from corpusloom.session import shared_dir
from corpusloom.sources.readers import TRACE_SCHEMA, latest_usage
from corpusloom.streaming.traces import land_kpis, read_kpis, stream_traces


def test_kpi_stream_is_the_same_for_any_number_of_files(spark, tmp_path):
    rows = [
        {"created_at": f"2024-03-0{1 + (i * 7) % 5}T{i % 24:02d}:00:00Z", "event_type": "route" if i % 2 else "feedback", "payload": {"confidence": 0.1 * (i % 10), "verdict": "correct"}}
        for i in range(60)
    ]
    for n in range(6):  # each file spans all days
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows[n::6]))
    tables = []
    for max_files in (1, 100):
        base = f"{tmp_path}/{max_files}"
        job = (
            stream_traces(spark, f"{tmp_path}/in", max_files).writeStream.foreachBatch(land_kpis(f"{base}/kpis"))
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        )
        job.awaitTermination()
        tables.append(read_kpis(spark, f"{base}/kpis"))
    batch = spark.read.schema(TRACE_SCHEMA).json(f"{tmp_path}/in").filter("payload is not null").withColumn("window_start", F.window("created_at", "1 day")["start"])
    whole = batch.groupBy("window_start").agg(*quality.kpi_columns())
    assert tables[0].count() == 5 and whole.agg(F.sum("sample_size")).first() == tables[0].agg(F.sum("sample_size")).first()
    for table in tables:
        assert table.select(whole.columns).exceptAll(whole).count() == 0 == whole.exceptAll(table.select(whole.columns)).count()


def test_replayed_epoch_changes_nothing(spark):
    base = f"{shared_dir(spark)}/replayed"
    rows = spark.createDataFrame([("2024-01-01 05:00:00", "route")], "at string, event_type string").select(
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("created_at", "event_type", "payload") else
          {"created_at": F.col("at").cast("timestamp"), "event_type": F.col("event_type"), "payload": F.from_json(F.lit("{}"), f.dataType) if f.name == "payload" else None}[f.name].alias(f.name)
          for f in spark.createDataFrame([], TRACE_SCHEMA).schema]
    )
    land = land_kpis(f"{base}/kpis")
    for epoch in (0, 0, 1):
        land(rows, epoch)
    assert [r["sample_size"] for r in read_kpis(spark, f"{base}/kpis").collect()] == [2]


def test_a_bad_pattern_fails_its_own_edit(spark):
    step = "array<struct<find:string,replace:string,use_regex:boolean,replace_all:boolean>>"
    rows = [(0, "aab", [("a+", "x", True, True)]), (1, "aab", [("a", "y", False, True), ("(", "x", True, True)]), (2, "aab", [("a", "z", False, False)])]
    got = spark.createDataFrame(rows, f"n int, body string, patches {step}").select("n", patch_text(F.col("body"), F.col("patches")).alias("r")).collect()
    assert {r["n"]: tuple(r["r"]) for r in got} == {0: ("xb", True), 1: ("aab", False), 2: ("zab", True)}


def test_empty_tables_and_counts_over_the_list_limit(spark):
    files = spark.createDataFrame([], "project string, path string, hash string")
    assert merkle_hash(files).count() == 0


def test_chunks_are_linear_and_whole(spark):
    text = "é" * 1000 + "\n" + "b" * 400_000
    got = spark.createDataFrame([(text,), ("  ",), (None,)], "t string").select(chunk_text(F.col("t"), 260).alias("c")).collect()
    assert "".join(got[0]["c"]) == text and {len(x) for x in got[0]["c"][:-1]} == {260} and got[1]["c"] == []


def test_latest_usage_reads_the_last_file(spark, tmp_path):
    for name, n in (("20260101", 3), ("20260201", 1)):
        (tmp_path / f"cognitive-usage-{name}.jsonl").write_text("{}\n" * n)
    assert latest_usage(spark, str(tmp_path)).count() == 1


def test_latest_usage_reads_every_part_of_the_last_run(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('d', id) AS domain").repartition(4)
    rows.limit(3).write.json(f"{tmp_path}/cognitive-usage-20260101.jsonl")
    rows.write.json(f"{tmp_path}/cognitive-usage-20260201.jsonl")
    assert latest_usage(spark, str(tmp_path)).distinct().count() == 40
