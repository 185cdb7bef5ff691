"""Session defaults and lineage cutting."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job of this package relies on.  Partition counts are
# left to AQE, which coalesces or splits from the measured shuffle sizes.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session carrying the settings above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def raise_group_limit(spark: SparkSession, limit: int) -> None:
    """Let Catalyst push ``row_number() <= limit`` below the shuffle for this limit."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(key, "1000")) < limit:
        spark.conf.set(key, str(limit))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a master that runs in this one process may fall back to a temporary folder, as tests do.
    """
    conf = spark.sparkContext.getConf()
    configured = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    fallback = tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def _stage_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpusloom-stages/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage between the rounds of an iterative plan; the files outlive lost
    executors, and their sizes give the planner real statistics.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for what one run writes; ``release_stages`` deletes it."""
    return f"{_stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def release_stages(spark: SparkSession) -> None:
    """Delete what this application staged, once no result that reads it is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stage_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The driver may have found it through its own sys.path, which workers do not share.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="corpusloom-py-")) / root.name), "zip", root.parent, root.name
    )
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
