"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.plans.catalog import QUERIES  # noqa: E402
from corpusloom.session import build_session, configure, release_stages  # noqa: E402
from corpusloom.sources.tables import SPREAD  # noqa: E402

HEADLINE = (
    "lexical_topk", "candidate_ranking", "context_pack", "context_packets", "hybrid_score", "file_summaries", "file_confidence_risk",
    "hierarchy_rollup", "snapshot_changes", "memory_search", "graph_expand", "eval_by_project", "diagnosis", "route_cost", "bulk_edit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # The test tables are files of one row group, which is one task each; BENCH_SPREAD=0 measures them so.
    spread = os.environ.get("BENCH_SPREAD", str(int(cpus) * 2 if cpus.isdigit() else 16))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.sql.shuffle.partitions": str(int(cpus) * 2 if cpus.isdigit() else 16), SPREAD: spread,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()  # start the JVM before timing
    seconds: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    prompts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    result = {
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"), "prompts": prompts, "spread": int(spread),
    }
    if "context_packets" in seconds and prompts:
        result["seconds_per_prompt"] = round(seconds["context_packets"] / prompts, 4)
    print(json.dumps(result), flush=True)
    release_stages(spark)
    spark.stop()


if __name__ == "__main__":
    main()
