"""Streaming trace log: source, windowed KPIs, reflection, change feed, cache fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embeddings, quality
from ..session import stage
from ..sources import sinks
from ..sources.readers import TRACE_SCHEMA


def stream_traces(spark: SparkSession, directory: str, max_files: int = 1000) -> DataFrame:
    """Append-only trace directory as a stream."""
    return spark.readStream.schema(TRACE_SCHEMA).option("maxFilesPerTrigger", max_files).json(directory)


def land_kpis(path: str, window: str = "1 day") -> Callable[[DataFrame, int], None]:
    """foreachBatch function: the parts of every window's report, from the epoch's own rows alone.

    Parts merge by adding, so no row is late, an epoch reads nothing that came before, and the report is the same for any number, size or
    order of files.  An epoch replaces its own folder: repeated, it adds nothing.
    """

    def land(batch: DataFrame, epoch: int) -> None:
        rows = batch.filter("payload is not null").withColumn("window_start", F.window("created_at", window)["start"])
        parts = rows.groupBy("window_start").agg(*[part.alias(name) for name, part in quality.kpi_parts().items()])
        parts.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return land


def read_kpis(spark: SparkSession, path: str) -> DataFrame:
    """The report of every window, from the parts of all epochs."""
    return quality.merged_kpis(spark.read.option("basePath", path).parquet(f"{path}/epoch=*"), "window_start")


def compact_kpis(spark: SparkSession, path: str, into: str) -> None:
    """Write the parts of all epochs as one row per window under ``into``, where later epochs may go on."""
    parts = spark.read.option("basePath", path).parquet(f"{path}/epoch=*").drop("epoch")
    summed = parts.groupBy("window_start").agg(*[F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in parts.columns if c != "window_start"])
    summed.write.mode("overwrite").parquet(f"{into}/epoch=-1")


def fan_out(consumers: dict[str, Callable[[DataFrame, int], None]], marks: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: one stream, several consumers.

    Every consumer leaves a mark when it is done with an epoch.  If one fails the others still run, then the epoch fails; repeated,
    it goes only to consumers without a mark.  The batch is staged once, so its source is read once.
    """

    def deliver(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        left = {name: f for name, f in consumers.items() if epoch not in sinks.snapshot_versions(spark, f"{marks}/{name}")}
        if not left:
            return
        rows, failed = stage(batch, "fan-out"), []
        for name, consume in left.items():
            try:
                consume(rows, epoch)
            except Exception as error:  # the epoch fails below, once all have had their turn
                failed.append((name, error))
            else:
                sinks.commit_snapshot(spark.range(1).select(F.lit(epoch).alias("epoch")), f"{marks}/{name}", epoch)
        if failed:
            raise RuntimeError(f"consumers failed in epoch {epoch}: {', '.join(name for name, _ in failed)}") from failed[0][1]

    return deliver


def run_reflection_stream(stream: DataFrame, reflect: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None):
    """Reflect on every micro-batch: at an interval of at least 60 s, or once over what is there."""
    writer = stream.writeStream.foreachBatch(reflect).option("checkpointLocation", checkpoint)
    if seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{max(60, seconds)} seconds").start()


def fill_embedding_cache(cache_path: str, embed: embeddings.Embedder, model: str, batch_size: int = 10) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: embed the texts the cache lacks and append them."""

    def fill(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        schema = "cache_key string, embedding array<float>"
        cache = sinks.read_snapshot_tree(spark, cache_path, schema)
        fresh = embeddings.embed_texts(embeddings.cache_misses(batch, cache, model), embed, model, batch_size)
        fresh.write.mode("overwrite").parquet(f"{cache_path}/epoch={epoch}")

    return fill
