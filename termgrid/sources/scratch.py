"""Materialised intermediate tables.

A table that several later jobs read (the aggregated panel, the edges of a
report) is written once as parquet to the shared folder the cluster names in
``spark.checkpoint.dir``.  That cuts the lineage, survives lost executors, and
later reads stay columnar.  Only where no folder is named and Spark runs in
local mode (tests) does the library make a temporary one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="termgrid-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark).rstrip('/')}/termgrid/{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Rows over all cores, for CPU-heavy work on an input of only a few partitions.

    An input that already has a partition per core is left alone, so a large
    table is never shuffled for this.  With ``task_rows`` the rows are counted, and
    the partitions follow them, so that no task grows with the table.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if task_rows:
        wanted = max(wanted, -(-df.count() // task_rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
