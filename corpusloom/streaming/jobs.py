"""Running streams to the end of their input, with sinks in the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpusloom.operators.skew import last_per_key
from corpusloom.sources.shared import scratch_path

_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keep streaming state in RocksDB, as arbitrary state needs, while the block runs."""
    before = spark.conf.get(_PROVIDER_KEY, None)
    spark.conf.set(_PROVIDER_KEY, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER_KEY)
        else:
            spark.conf.set(_PROVIDER_KEY, before)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Append everything available to a Parquet table and return it."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    with rocksdb_state(spark):
        query = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", scratch_path(spark, f"{name}-state"))
            .trigger(availableNow=True)
            .start(path)
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, key: list[str], name: str) -> DataFrame:
    """Run an update-mode aggregate and return its newest row per key.

    Each micro-batch writes its own folder, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", scratch_path(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return last_per_key(spark.read.schema(schema).parquet(path), key, ["batch"]).drop("batch")


def job_progress(log: DataFrame, terminal: list[str]) -> DataFrame:
    """Counters and current status per job over a stream of ``(job_id, status, ts, seq)``."""
    newest = F.max(F.struct("ts", "seq", "status"))
    return log.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("status") == "error").alias("errors"),
        newest.alias("newest"),
    ).select(
        "job_id",
        "entries",
        "errors",
        F.col("newest.status").alias("status"),
        F.col("newest.ts").alias("updated_at"),
        F.col("newest.status").isin(terminal).alias("is_done"),
    )
