"""Where jobs put intermediate tables: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
# Texts of a bucket, and the most buckets that a table may have.
BUCKET_TEXTS, MOST_BUCKETS = 5_000, 10_000


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    A folder of our own is made only for a local master that names none, as in tests; on a
    cluster a missing setting is an error, since no executor could read a driver-local folder.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a written table that survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_by(
    df: DataFrame, name: str, key: str, buckets: int | None = None
) -> DataFrame:
    """``materialise`` in ``buckets`` of the key: whatever is grouped by the key reads it without an
    exchange. Without ``buckets`` the rows are spread by their number; a table derived row by row
    from another one with its number of buckets is written where its rows are."""
    spark = df.sparkSession
    if buckets is None:
        buckets = bucket_count(df)
        df = df.repartition(buckets, key)
    table = f"corpusloom_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option(
        "path", scratch_path(spark, name)
    ).saveAsTable(table)
    return spark.table(table)


def bucket_count(df: DataFrame) -> int:
    """Buckets for a table of texts: work for every core, and a bounded number of texts in each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return min(max(2 * cores, -(-df.count() // BUCKET_TEXTS)), MOST_BUCKETS)
