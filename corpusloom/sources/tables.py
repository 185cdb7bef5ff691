"""Reading column tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Session setting: deal the rows of every table read into so many partitions.  Off unless set; see :func:`read_table`.
SPREAD = "spark.corpusloom.spread"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Plain parquet scan; filters and column pruning reach it.

    A file with one row group is one task, whatever its size.  Large tables have many; for a small test table the setting
    ``spark.corpusloom.spread`` shuffles its rows into that many partitions before work on them begins.  No size is looked at.
    """
    table = spark.read.parquet(f"{directory}/{name}.parquet")
    parts = int(spark.conf.get(SPREAD, "0"))
    return table.repartition(parts) if parts else table
