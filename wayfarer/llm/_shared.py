"""Paths and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows (of a few numbers each) that are broadcast at most.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where a session on one machine leaves it unset, as in tests, is a
    temporary folder made and set as the checkpoint folder; a cluster must name
    one that all its machines see.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="wayfarer-")
    context.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayfarer/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Like ``written``, in buckets by ``keys``: joins by just these keys, in this order, leave its rows where they are.

    ``df`` should come out of a shuffle by the same keys, so that a task writes few files.
    """
    spark = df.sparkSession
    run = uuid.uuid4().hex
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/wayfarer/{run}/{name}"
    df.write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(f"wayfarer_{name}_{run}")
    return spark.table(f"wayfarer_{name}_{run}")


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table), to be broadcast if it was counted and has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
