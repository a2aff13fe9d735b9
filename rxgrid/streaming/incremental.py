"""Incremental loads as Structured Streaming jobs.

Both run with ``trigger(availableNow=True)``: every file present is processed
in bounded micro-batches and the query stops, so the same job serves backfills
and periodic incremental runs.  Stream checkpoints live in the session's shared
checkpoint directory, so a restarted job resumes exactly where it stopped; a
micro-batch that is run again replaces its own earlier output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rxgrid.operators.bronze import hashed
from rxgrid.session import path_exists
from rxgrid.sources import ledger


def split_by_day(df: DataFrame, ts_col: str, out_dir: str) -> str:
    """Lay a table out as one folder of files per day - a replayable feed."""
    df.withColumn("day", F.to_date(ts_col)).write.mode("overwrite").partitionBy("day").parquet(out_dir)
    return out_dir


def incremental_insert_only(spark: SparkSession, source_dir: str, schema: StructType, target_dir: str,
                            checkpoint_dir: str, ignore_cols=("day",), name: str = "feed") -> None:
    """New files -> record hash (B5) -> each micro-batch is one epoch of the insert-only ledger."""

    def merge(batch: DataFrame, epoch: int) -> None:
        ledger.append(hashed(batch, ignore_cols), target_dir, f"{name}-{epoch:09d}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(source_dir)
    q = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def incremental_daily_summary(spark: SparkSession, source_dir: str, schema: StructType, target_dir: str,
                              checkpoint_dir: str, ts_col: str = "ts", key: str = "user_id",
                              value_col: str = "value", name: str = "feed") -> None:
    """Per key and day, event count and value sum.

    Each micro-batch adds its own sums to the target as one epoch, and a reader adds the epochs up.  Sums
    need no state between batches and no watermark, so a row counts however late it comes, and memory does
    not grow with open days.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        part = batch.groupBy(F.col(key), F.date_trunc("day", ts_col).cast(batch.schema[ts_col].dataType).alias("day_start")).agg(
            F.count(F.lit(1)).alias("events"), F.sum(value_col).alias("value_sum"))
        part.write.mode("overwrite").parquet(f"{target_dir}/epoch={name}-{epoch:09d}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(source_dir)
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def daily_summary(spark: SparkSession, target_dir: str, key: str = "user_id") -> DataFrame:
    """Current P2 result: the epochs' sums added up."""
    if not path_exists(spark, target_dir):
        raise FileNotFoundError(target_dir)
    return spark.read.option("basePath", target_dir).parquet(target_dir).groupBy(key, "day_start").agg(
        F.sum("events").alias("events"), F.sum("value_sum").alias("value_sum"))
